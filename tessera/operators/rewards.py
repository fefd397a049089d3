"""Rule scoring of responses, and the batch reward of paired groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, text
from . import curation, groups

SCORERS: dict[str, Callable[[Column, Column], Column]] = {}


def scorer(name: str):
    """Register a function (answer, ground truth) -> score."""

    def keep(f):
        SCORERS[name] = f
        return f

    return keep


@scorer("equal")
def equal(answer: Column, truth: Column) -> Column:
    """1 for equal numbers, or texts that are equal without case and outer space."""
    a, b = F.lower(text.strip(answer)), F.lower(text.strip(truth))
    same = (a == b) | (a.try_cast("double") == b.try_cast("double"))
    return F.coalesce(same, F.lit(False)).cast("double")


def load_scorer(place: str, **bound) -> Callable:
    """The function of 'file.py:name', with keyword arguments bound."""
    import functools
    import importlib.util

    path, _, name = place.rpartition(":")
    spec = importlib.util.spec_from_file_location("scorer_module", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return functools.partial(getattr(module, name), **bound)


def overall(group: Column, fmt: Column, valid: Column, box: Column, acc: Column, cons: Column) -> Column:
    return F.when(group == "A", fmt + valid + box + acc).when(group == "B", fmt + acc + cons).otherwise(fmt + 1.5 * acc)


def score(df: DataFrame, judge: str = "equal", consistency: Callable[[Column, Column], Column] | None = None, state: DataFrame | None = None) -> DataFrame:
    """Scores of rollouts (original_idx, group, response, ground_truth, target_boxes, step, pos).

    Rows of group B are held against the best qualified A row of their key up to the same step (or in state, a table
    (original_idx, accuracy, value, think) of an earlier run).
    """
    said = text.tidy_tags(F.col("response"))
    rows = df.withColumn("group", F.coalesce("group", F.lit("A"))).withColumn("original_idx", F.coalesce("original_idx", "pos"))
    rows = rows.withColumn("think", text.tag(said, "think")).withColumn("answer", text.tag(said, "answer")).withColumn("format", text.well_formed(said).cast("double"))
    accuracy = text.guarded(F.col("answer"), SCORERS[judge](F.col("answer"), F.col("ground_truth"))).cast("double")
    share, _ = geometry.box_validity(said)
    is_a = F.col("group") == "A"
    rows = rows.withColumn("accuracy", F.coalesce(accuracy, F.lit(0.0))).withColumn("box_valid", F.when(is_a, share).otherwise(F.lit(0.0))).withColumn("box_reward", F.when(is_a, geometry.box_reward(said, F.col("target_boxes"))).otherwise(F.lit(0.0)))
    rows = rows.withColumn("_order", F.col("step") * (1 << 32) + F.col("pos"))
    fit = is_a & curation.qualified(F.col("accuracy"), F.col("box_reward")) & F.col("think").isNotNull()
    # group A of a step is scored before group B, so the frame takes in the whole step
    from pyspark.sql.window import Window

    entry = F.struct("accuracy", F.col("box_reward").alias("value"), (-F.col("_order")).alias("negative_order"), "think")
    best = F.max(F.when(fit, entry)).over(Window.partitionBy("original_idx").orderBy("step").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    if state is not None:
        # the earlier entry comes before all rows, so it stays where it is equal
        before = F.struct(F.col("accuracy").cast("double").alias("accuracy"), F.col("value").cast("double").alias("value"), F.lit(1).cast("long").alias("negative_order"), "think")
        rows = rows.withColumn("_best", best).join(state.select("original_idx", before.alias("_earlier")), "original_idx", "left")
        rows = rows.withColumn("reference", F.greatest("_best", "_earlier")["think"]).drop("_best", "_earlier")
    else:
        rows = rows.withColumn("reference", best["think"])
    cons = F.when(F.col("group") == "B", F.coalesce(consistency(F.col("reference"), F.col("think")), F.lit(0.0)) if consistency else F.lit(0.0)).otherwise(F.lit(0.0))
    rows = rows.withColumn("consistency", cons)
    total = overall(F.col("group"), F.col("format"), F.col("box_valid"), F.col("box_reward"), F.col("accuracy"), F.col("consistency"))
    return rows.withColumn("overall", total).drop("_order")


def references(scored: DataFrame) -> DataFrame:
    """(original_idx, accuracy, value, think, step): the best qualified A row of each key, the state of a later run."""
    fit = scored.where((F.col("group") == "A") & curation.qualified(F.col("accuracy"), F.col("box_reward")) & F.col("think").isNotNull())
    return groups.top_one(fit.withColumn("value", F.col("box_reward")), ["original_idx"], "value", ["step", "pos"]).select("original_idx", "accuracy", "value", "think", "step")
