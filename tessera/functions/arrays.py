"""Column functions on token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad(a: Column, n: int, value, left: bool = False) -> Column:
    """a with value put behind it (or before) up to length n; a longer one stays."""
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(0), F.lit(n) - F.size(a)))
    return F.concat(fill, a) if left else F.concat(a, fill)


def fit(a: Column, n: int, value, pad_left: bool = True, cut: str = "right") -> Column:
    """a at length n: padded, or cut at the right or left end; cut='error' raises for a longer one."""
    if cut == "error":
        a = F.when(F.size(a) > n, F.raise_error(F.lit(f"longer than {n}"))).otherwise(a)
    short = F.slice(a, 1, n) if cut == "right" else F.when(F.size(a) > n, F.slice(a, -n, n)).otherwise(a) if cut == "left" else a
    return pad(short, n, value, pad_left)


def masked_sum(values: Column, mask: Column) -> Column:
    return F.aggregate(F.zip_with(values, mask, lambda v, m: v * m), F.lit(0.0), lambda a, x: a + x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))


def masked_mean(values: Column, mask: Column, eps: float = 1e-8) -> Column:
    return masked_sum(values, mask) / (total(mask) + eps)


def times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def response_mask(ids: Column, ends: list[int]) -> Column:
    """1 up to and including the first end token, then 0."""
    first = F.array_min(F.filter(F.transform(ids, lambda x, i: F.when(x.isin(ends), i)), lambda i: i.isNotNull()))
    return F.transform(ids, lambda x, i: F.when(first.isNull() | (i <= first), F.lit(1)).otherwise(F.lit(0)))


def position_ids(mask: Column) -> Column:
    """Running count of valid tokens less one, not below 0."""
    return F.transform(mask, lambda x, i: F.greatest(F.lit(0), total(F.slice(mask, F.lit(1), i + 1)) - 1))


def response_positions(prompt_positions: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.element_at(prompt_positions, -1) + i)


def place_score(n: Column, length: Column, score: Column) -> Column:
    """n zeros with score at the last valid place; at the last place of all if the length is 0."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == F.pmod(length - 1, n), score).otherwise(F.lit(0.0)))


def prompt_part(mask: Column, response_length: int) -> Column:
    return F.slice(mask, F.lit(1), F.greatest(F.lit(0), F.size(mask) - response_length))


def response_part(mask: Column, response_length: int) -> Column:
    return F.slice(mask, -response_length, response_length)


def segment_tokens(mask: Column, cut: Column, first: Column, second: Column) -> Column:
    """first up to the cut, second behind it, by the mask; a cut below 0 or beyond the end is the middle."""
    n = F.size(mask)
    at = F.when((cut < 0) | (cut > n), F.floor(n / 2)).otherwise(cut)
    return F.transform(mask, lambda m, i: F.when(i < at, first).otherwise(second) * m)


def roll_left(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.concat(F.slice(a, F.lit(2), F.size(a)), F.slice(a, 1, 1))).otherwise(a)
