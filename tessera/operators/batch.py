"""Batch algebra on DataFrames whose column pos numbers the rows from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

BUCKET_ROWS = 50_000


def with_pos(df: DataFrame, *keys: str, name: str = "pos") -> DataFrame:
    """df with row numbers from 0 in the order of keys.

    With a whole-number first key, rows are numbered inside ranges of it, and a running count over the (few) ranges
    gives their starts, so no task sorts all rows. Other keys are numbered in one sorted window.
    """
    if not isinstance(df.schema[keys[0]].dataType, IntegralType):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*keys)).cast("long") - 1)
    low, high, n = df.agg(F.min(keys[0]), F.max(keys[0]), F.count("*")).first()
    width = max(1, ((high or 0) - (low or 0) + 1) * BUCKET_ROWS // max(n, 1))
    bucket = F.coalesce(F.floor((F.col(keys[0]) - (low or 0)) / width), F.lit(-1))
    if (high or 0) - (low or 0) < width:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(bucket).orderBy(*keys)).cast("long") - 1)
    sizes = df.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    starts = sizes.select("_bucket", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_bucket")) - F.col("_n")).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys))
    return df.withColumn("_bucket", bucket).join(starts, "_bucket").withColumn(name, F.col("_start") + own - 1).drop("_bucket", "_start")


def select(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns that exist, and pos."""
    return df.select("pos", *(c for c in names if c in df.columns and c != "pos"))


def pop(df: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the named columns, the others); both keep pos."""
    return select(df, names), df.drop(*(c for c in names if c != "pos"))


def rename(df: DataFrame, old: list[str] | str, new: list[str] | str) -> DataFrame:
    old, new = ([x] if isinstance(x, str) else list(x) for x in (old, new))
    if len(old) != len(new):
        raise ValueError(f"{len(old)} old names, {len(new)} new ones")
    return df.withColumnsRenamed(dict(zip(old, new)))


def union_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """The columns of both, row by row; columns that both have must be equal, and so must the row counts."""
    shared = [c for c in b.columns if c in a.columns and c != "pos"]
    if a.count() != b.count():
        raise ValueError("batches of different length")
    both = a.join(b.withColumnsRenamed({c: f"_other_{c}" for c in shared}), "pos")
    for c in shared:
        if not both.where(~F.col(c).eqNullSafe(F.col(f"_other_{c}"))).isEmpty():
            raise ValueError(f"column {c} differs")
    return both.drop(*(f"_other_{c}" for c in shared))


def concat(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts, one after the other; pos numbered on by the sizes of the parts before."""
    out, start = None, 0
    for part in parts:
        moved = part.withColumn("pos", F.col("pos") + start)
        out = moved if out is None else out.unionByName(moved)
        start += part.count()
    return out


def chunk_id(n: int, chunks: int) -> Column:
    """The chunk of a row when n rows are cut into equal runs; n must divide."""
    if n % chunks:
        raise ValueError(f"{n} rows in {chunks} chunks")
    return F.floor(F.col("pos") / (n // chunks))


def split_id(size: int) -> Column:
    return F.floor(F.col("pos") / size)


def fold(df: DataFrame, n: int, rows: int, column: str) -> DataFrame:
    """(fold, values): n rows of arrays of equal length, in order."""
    parts = df.withColumn("fold", chunk_id(rows, n)).groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("pos", column))).alias("v"))
    return parts.select("fold", F.transform("v", lambda x: x[column]).alias("values"))


def repeat(df: DataFrame, n: int, interleave: bool = True, rows: int | None = None) -> DataFrame:
    """Each row n times: a a b b, or a b a b."""
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = df.count() if rows is None and not interleave else rows
    return df.withColumn("_k", k).withColumn("pos", F.col("pos") * n + F.col("_k") if interleave else F.col("_k") * rows + F.col("pos")).drop("_k")


def pad_to_divisor(df: DataFrame, divisor: int, rows: int | None = None) -> tuple[DataFrame, int]:
    """(df with rows from its head put behind, again and again, up to a multiple of divisor; how many)."""
    rows = df.count() if rows is None else rows
    extra = -rows % divisor if rows else 0
    if not extra:
        return df, 0
    # row p comes again at p + rows, p + 2 rows, ... as far as the padding reaches
    again = F.sequence(F.col("pos") + rows, F.lit(rows + extra - 1).cast("long"), F.lit(rows).cast("long"))
    more = df.where(F.col("pos") < extra).withColumn("pos", F.explode(again))
    return df.unionByName(more), extra


def unpad(df: DataFrame, extra: int, rows: int | None = None) -> DataFrame:
    rows = df.count() if rows is None else rows
    return df.where(F.col("pos") < rows - extra)


def gather(df: DataFrame, order: DataFrame) -> DataFrame:
    """Rows by order(ord, idx): the row at idx comes to pos ord; an idx may come twice or not at all."""
    return df.withColumnRenamed("pos", "idx").join(order, "idx").withColumnRenamed("ord", "pos").drop("idx")


def mask_select(df: DataFrame, mask: Column) -> DataFrame:
    return df.where(mask)


def inverse(order: DataFrame) -> DataFrame:
    """order(ord, idx) the other way round."""
    return order.select(F.col("idx").alias("ord"), F.col("ord").alias("idx"))


def slice_rows(df: DataFrame, start: int | None, end: int | None, step: int = 1, rows: int | None = None) -> DataFrame:
    """Rows start to end by step, as in a Python slice."""
    rows = df.count() if rows is None else rows
    taken = range(rows)[slice(start, end, step)]
    if not len(taken):
        return df.where("false")
    lo, hi = min(taken[0], taken[-1]), max(taken[0], taken[-1])
    p = F.col("pos")
    return df.where((p >= lo) & (p <= hi) & (F.pmod(p - taken[0], F.lit(abs(step))) == 0)).withColumn("pos", (p - taken[0]) / step).withColumn("pos", F.col("pos").cast("long"))


def check_lengths(df: DataFrame, *arrays: str) -> DataFrame:
    """df; reading it fails if the arrays of a row differ in length."""
    same = [F.size(arrays[0]) == F.size(c) for c in arrays[1:]]
    return df.where(F.assert_true(F.forall(F.array(*same), lambda x: x)).isNull()) if same else df


def flatten(df: DataFrame, separator: str = "/") -> DataFrame:
    """Nested fields as columns named by their path."""
    def walk(schema, path):
        for f in schema.fields:
            if hasattr(f.dataType, "fields"):
                yield from walk(f.dataType, [*path, f.name])
            else:
                yield [*path, f.name]

    return df.select(*(F.col(".".join(f"`{x}`" for x in p)).alias(separator.join(p)) for p in walk(df.schema, [])))


def unflatten(df: DataFrame, separator: str = "/") -> DataFrame:
    """The other way: columns with a separator in their names become structs."""
    def build(items):
        tree: dict[str, list] = {}
        for path, name in items:
            tree.setdefault(path[0], []).append((path[1:], name))
        for key, inner in tree.items():
            yield F.col(f"`{inner[0][1]}`").alias(key) if not inner[0][0] else F.struct(*build(inner)).alias(key)

    return df.select(*build([(c.split(separator), c) for c in df.columns]))


def stored_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of df."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
