"""External models behind interfaces: judges, generators and feature extractors, with rule-based stand-ins."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_retry(call: Callable[[str], str | None], tries: int, pause: float = 0.0) -> Callable[[str], str | None]:
    """call until it answers; None after so many tries (0: without end)."""

    def asked(prompt: str) -> str | None:
        n = 0
        while not tries or n < tries:
            n += 1
            try:
                if (said := call(prompt)) is not None:
                    return said
            except Exception:  # a judge that fails is asked again, whatever the reason
                time.sleep(pause)
        return None

    return asked


def answers(prompts: Column, call: Callable[[str], str | None], tries: int = 3) -> Column:
    """A judge's answers, each distinct prompt of a batch asked once."""

    @F.pandas_udf("string")
    def ask(s: pd.Series) -> pd.Series:
        asked = with_retry(call, tries)
        known = {p: asked(p) for p in s.dropna().unique()}
        return pd.Series([known.get(p) for p in s], dtype=object)

    return ask(prompts)


def generate(df: DataFrame, prompt: str, n: int, call: Callable[[str, int], str | None], valid: str = r"(?s).+", tries: int = 3) -> DataFrame:
    """Up to n valid texts for each row: columns of df, number and text."""
    columns = df.schema.simpleString()[7:-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                for i in range(n):
                    for k in range(tries):
                        said = call(row[prompt], i * tries + k)
                        if said is not None and re.fullmatch(valid, said):
                            rows.append(row | {"number": i, "generated": said})
                            break
            yield pd.DataFrame(rows, columns=[*pdf.columns, "number", "generated"])

    return df.mapInPandas(run, f"{columns},number int,generated string")


def judge_mean(scores: Column, most: int = 4) -> Column:
    """The mean of the first parsed scores, 0 without any."""
    known = F.slice(F.filter(scores, lambda x: x.isNotNull()), 1, most)
    return F.coalesce(F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known)), F.lit(0.0))


def best_step(df: DataFrame, step: str, score: str) -> DataFrame:
    """The best score so far and its step, the first of equals, for each step; steps are few."""
    w = Window.partitionBy(F.lit(0)).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    best = F.max(F.struct(F.col(score).alias("score"), (-F.col(step)).alias("negative_step"))).over(w)
    return df.withColumn("best_score", best["score"]).withColumn("best_step", -best["negative_step"])


def resume(df: DataFrame, batch: str, last: int | None) -> DataFrame:
    """The batches behind the last one done."""
    return df if last is None else df.where(F.col(batch) > last)
