"""Reverse scans over token arrays, masked moments and whitening."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


def _back(columns: list[pd.Series]) -> tuple[list[np.ndarray], np.ndarray, int]:
    sizes = columns[0].map(len).to_numpy()
    width = int(sizes.max()) if len(sizes) else 0
    return [_matrix(c, width) for c in columns], sizes, width


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Struct(advantages, returns): generalised advantage estimates by one reverse pass, rows of a batch side by side."""

    @F.pandas_udf("struct<advantages:array<double>,returns:array<double>>")
    def scan(r: pd.Series, v: pd.Series) -> pd.DataFrame:
        (rs, vs), sizes, width = _back([r, v])
        out, last = np.zeros_like(rs), np.zeros(len(rs))
        after = np.zeros(len(rs))
        for t in range(width - 1, -1, -1):
            here = t < sizes
            delta = rs[:, t] + gamma * after - vs[:, t]
            last = np.where(here, delta + gamma * lam * last, 0.0)
            after = np.where(here, vs[:, t], 0.0)
            out[:, t] = last
        return pd.DataFrame({"advantages": [a[:n] for a, n in zip(out, sizes)], "returns": [a[:n] for a, n in zip(out + vs, sizes)]})

    return scan(rewards, values)


def discounted(rewards: Column, mask: Column, gamma: float) -> Column:
    """Returns by a reverse pass in which the running sum is cut where the mask is 0."""

    @F.pandas_udf("array<double>")
    def scan(r: pd.Series, m: pd.Series) -> pd.Series:
        (rs, ms), sizes, width = _back([r, m])
        out, run = np.zeros_like(rs), np.zeros(len(rs))
        for t in range(width - 1, -1, -1):
            run = rs[:, t] + gamma * run
            out[:, t] = run
            run = run * ms[:, t]
        return pd.Series([a[:n] for a, n in zip(out, sizes)])

    return scan(rewards, mask)


def masked_moments(df: DataFrame, values: str, mask: str) -> DataFrame:
    """One row: n, s1, s2 over the unmasked elements, from one partial sum for each row."""
    pairs = F.zip_with(values, mask, lambda v, m: F.when(m > 0, v))
    kept = F.filter(pairs, lambda v: v.isNotNull())
    zero = F.lit(0).cast("decimal(38,0)")
    exact = dict(df.dtypes)[values] in ("array<bigint>", "array<int>")
    start = zero if exact else F.lit(0.0)
    add = lambda square: F.aggregate(kept, start, lambda a, x: (a + ((x * x) if square else x)).cast("decimal(38,0)" if exact else "double"))
    rows = df.select(F.size(kept).cast("long").alias("n"), add(False).alias("s1"), add(True).alias("s2"))
    return rows.agg(F.sum("n").alias("n"), F.sum("s1").cast("double").alias("s1"), F.sum("s2").cast("double").alias("s2"))


def whiten(df: DataFrame, values: str, mask: str, eps: float = 1e-8, out: str = "whitened") -> DataFrame:
    """(value - mean) / sqrt(variance + eps) at all places, the moments over the unmasked ones of all rows."""
    m = masked_moments(df, values, mask)
    n = F.col("n") + eps
    mean = F.col("s1") / n
    centred = (F.col("s2") - 2 * mean * F.col("s1") + mean * mean * F.col("n")) / n
    m = m.select(mean.alias("_mean"), F.when(F.col("n") <= 1, centred).otherwise(centred * F.col("n") / (F.col("n") - 1)).alias("_var"))
    return df.crossJoin(F.broadcast(m)).withColumn(out, F.transform(values, lambda v: (v - F.col("_mean")) / F.sqrt(F.col("_var") + eps))).drop("_mean", "_var")  # one row of moments

