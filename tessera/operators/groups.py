"""Grouped normalisation: advantages relative to a group, online filters, best rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from ..functions import arrays

ESTIMATORS: dict = {}


def estimator(name: str):
    """Register an advantage estimator under a name."""

    def keep(f):
        ESTIMATORS[name] = f
        return f

    return keep


def moments(df: DataFrame, uid: str, score: str) -> tuple[Column, Column, Column]:
    """(count, mean, unbiased deviation) over the group; whole-number scores are summed exactly."""
    w = Window.partitionBy(uid)
    n, s = F.count(score).over(w), F.sum(score).over(w)
    if isinstance(df.schema[score].dataType, IntegralType):
        squares = F.sum(F.col(score) * F.col(score)).over(w)
        spread = F.sqrt((n * squares - s * s).cast("double") / F.nullif(n * (n - 1), F.lit(0)).cast("double"))
    else:
        spread = F.stddev_samp(score).over(w)
    return n, s.cast("double") / n.cast("double"), spread


@estimator("grpo")
def grpo(df: DataFrame, uid: str, score: str, eps: float = 1e-6, out: str = "advantage") -> DataFrame:
    """(score - mean) / (deviation + eps) in each group; a group of one fails."""
    n, mean, spread = moments(df, uid, score)
    value = (F.col(score).cast("double") - mean) / (spread + eps)
    return df.withColumn(out, F.when(n > 1, value).otherwise(F.raise_error(F.lit("a group of one row")).cast("double")))


@estimator("rloo")
def rloo(df: DataFrame, uid: str, score: str, out: str = "advantage") -> DataFrame:
    """The score less the mean of the others of the group; a group of one fails."""
    w = Window.partitionBy(uid)
    n, s = F.count(score).over(w), F.sum(score).over(w)
    value = F.col(score).cast("double") - (s - F.col(score)).cast("double") / F.nullif(n - 1, F.lit(0)).cast("double")
    return df.withColumn(out, F.when(n > 1, value).otherwise(F.raise_error(F.lit("a group of one row")).cast("double")))


@estimator("remax")
def remax(df: DataFrame, score: str, baseline: str, out: str = "advantage") -> DataFrame:
    return df.withColumn(out, F.col(score) - F.col(baseline))


@estimator("segment_grpo")
def segment_grpo(df: DataFrame, uid: str, first: str | None, second: str | None, cut: str, mask: str, score: str | None = None, eps: float = 1e-6, out: str = "advantages") -> DataFrame:
    """Two scores normalised apart (a group of one: mean itself, deviation 1) and dealt to the tokens before and behind the cut.

    Without both of them, one normalised score for all tokens.
    """
    if first is None or second is None:
        return grpo(df, uid, score, eps, "_a").withColumn(out, F.transform(mask, lambda m: m * F.col("_a"))).drop("_a")
    for name, column in (("_a1", first), ("_a2", second)):
        n, mean, spread = moments(df, uid, column)
        df = df.withColumn(name, F.when(n > 1, (F.col(column).cast("double") - mean) / (spread + eps)).otherwise(F.lit(0.0)))
    return df.withColumn(out, arrays.segment_tokens(F.col(mask), F.col(cut), F.col("_a1"), F.col("_a2"))).drop("_a1", "_a2")


def online_filter(df: DataFrame, uid: str, score: str, low: float, high: float) -> DataFrame:
    """Rows of groups whose mean score lies strictly between low and high."""
    mean = F.avg(score).over(Window.partitionBy(uid))
    return df.withColumn("_mean", mean).where((F.col("_mean") > low) & (F.col("_mean") < high)).drop("_mean")


def top_one(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The row with the greatest value of each key; the first in order wins ties."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), *order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def running_best(df: DataFrame, key: str, accuracy: str, value: str, step: str, known: Column | None = None) -> DataFrame:
    """Column best: the greatest (accuracy, value) of the key so far, the first of equals; rows where known is false don't count."""
    entry = F.struct(F.col(accuracy).alias("accuracy"), F.col(value).alias("value"), (-F.col(step)).alias("negative_step"))
    w = Window.partitionBy(key).orderBy(step).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("best", F.max(entry if known is None else F.when(known, entry)).over(w))


def imputed(df: DataFrame, uid: str, boxes: Column, fmt: Column, acc: Column, iou: Column, valid: Column, overall: Column, out: str = "overall") -> DataFrame:
    """Overall of rows without boxes from the means of the group's rows with boxes, where both kinds exist."""
    w = Window.partitionBy(uid)
    with_box = boxes > 0
    both = (F.count_if(with_box).over(w) > 0) & (F.count_if(~with_box).over(w) > 0)
    guess = 1.5 * acc + fmt + acc * F.avg(F.when(with_box, iou)).over(w) + acc * F.avg(F.when(with_box, valid)).over(w)
    return df.withColumn(out, F.when(both & ~with_box, guess).otherwise(overall))
