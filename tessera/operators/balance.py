"""Partitions of equal load: largest differencing, greedy dealing and micro-batches."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differencing(sizes: list[int], k: int, equal: bool) -> list[list[int]]:
    """Karmarkar and Karp's method for k parts; equal: parts of the same number of items.

    A candidate is k parts, each (sum, number, (index, size) pairs in the order they came); the two candidates that are
    most uneven are joined, the fullest part of one with the emptiest of the other. Ties go by the fullest part.
    """
    ranked = sorted((s, i) for i, s in enumerate(sizes))
    if equal and len(sizes) % k:
        raise ValueError(f"{len(sizes)} items in {k} equal parts")
    groups = [ranked[a : a + k] for a in range(0, len(ranked), k)] if equal else [[x] for x in ranked]

    class Rank:
        """Heap order: the most uneven first."""

        def __init__(self, parts):
            self.parts = sorted(parts, reverse=True)

        def __lt__(self, other):
            mine, its = self.parts[0][0] - self.parts[-1][0], other.parts[0][0] - other.parts[-1][0]
            return mine > its if mine != its else self.parts[0] > other.parts[0]

    empty = (0, 0, ())
    heap: list[Rank] = []
    for group in groups:
        parts = [(s, 1, ((i, s),)) for s, i in group]
        heapq.heappush(heap, Rank(parts + [empty] * (k - len(parts))))
    while len(heap) > 1:
        a, b = heapq.heappop(heap).parts, heapq.heappop(heap).parts
        heapq.heappush(heap, Rank([(x[0] + y[0], x[1] + y[1], x[2] + y[2]) for x, y in zip(a, reversed(b))]))
    return [[i for i, _ in part[2]] for part in heap[0].parts] if heap else [[] for _ in range(k)]


def greedy(sizes: list[int], k: int, equal: bool) -> list[list[int]]:
    """Items in their order, each to the part with the least load; equal: by the number of items first."""
    more = sum(sizes) + 1 if equal else 0
    loads = [(0, j) for j in range(k)]
    out: list[list[int]] = [[] for _ in range(k)]
    for i, s in enumerate(sizes):
        load, j = heapq.heappop(loads)
        out[j].append(i)
        heapq.heappush(loads, (load + s + more, j))
    return out


def balanced(sizes: list[int], k: int, equal: bool) -> list[list[int]]:
    """Checked parts, each in ascending order."""
    if len(sizes) < k:
        raise ValueError(f"{len(sizes)} items in {k} parts")
    parts = [sorted(p) for p in differencing(sizes, k, equal)]
    if sorted(i for p in parts for i in p) != list(range(len(sizes))) or not all(parts):
        raise ValueError("parts do not cover the items, or one is empty")
    return parts


def micro_batches(sizes: list[int], most: int) -> list[list[int]]:
    """As few parts as the token budget asks for, those with most quadratic work first."""
    n = min(len(sizes), -(-sum(sizes) // most))
    return sorted(balanced(sizes, n, False), key=lambda p: (sum(sizes[i] ** 2 for i in p), min(p)), reverse=True) if sizes else []


def _each_batch(df: DataFrame, batch: str, size: str, plan) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        part, ord_ = [0] * len(pdf), [0] * len(pdf)
        for k, members in enumerate(plan([int(x) for x in pdf[size]])):
            for n, i in enumerate(members):
                part[i], ord_[i] = k, n
        return pd.DataFrame({batch: pdf[batch], "pos": pdf["pos"], size: pdf[size], "part": part, "ord": ord_})

    kinds = dict(df.dtypes)
    return df.select(batch, "pos", size).groupBy(batch).applyInPandas(run, f"{batch} {kinds[batch]}, pos long, {size} {kinds[size]}, part long, ord long")


def partition(df: DataFrame, batch: str, size: str, k: int, equal: bool = True) -> DataFrame:
    """(batch, pos, size, part, ord): the rows of each batch in k parts of even load. A batch is what one task holds."""
    return _each_batch(df, batch, size, lambda sizes: balanced(sizes, k, equal))


def dynamic(df: DataFrame, batch: str, size: str, most: int) -> DataFrame:
    """(batch, pos, size, part, ord): micro-batches of about most tokens. Ordered by pos, the rows are as before."""
    return _each_batch(df, batch, size, lambda sizes: micro_batches(sizes, most))


def load_stats(df: DataFrame, size: str, parts: int, rows: int, part: str = "part") -> DataFrame:
    """One row: least and greatest load of contiguous chunks before, and of parts after, their differences and the mean."""
    run = max(1, rows // parts)
    before = df.groupBy(F.floor(F.col("pos") / run)).agg(F.sum(size).alias("s")).agg(F.min("s").alias("before_min"), F.max("s").alias("before_max"))
    after = df.groupBy(part).agg(F.sum(size).alias("s")).agg(F.min("s").alias("after_min"), F.max("s").alias("after_max"), (F.sum("s") / parts).alias("mean"))
    return before.crossJoin(after).withColumn("before_diff", F.col("before_max") - F.col("before_min")).withColumn("after_diff", F.col("after_max") - F.col("after_min"))  # one row each
