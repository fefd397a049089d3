"""Curation of rollout logs into training samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# The tasks by group.
TASKS = {"A": "grounding", "B": "math_nobox", "single": "math_single"}


def allow(df: DataFrame, column: str, names: tuple[str, ...]) -> DataFrame:
    return df.where(F.col(column).isin(*names))


def task_filter(df: DataFrame, targets: str, kind: str, excluded: tuple[str, ...]) -> DataFrame:
    """Rows with targets whose kind is not excluded; all rows if there is no column of kinds."""
    return df.where((F.size(targets) > 0) & ~F.col(kind).isin(*excluded)) if kind in df.columns else df


def fan_out(df: DataFrame, single: Column) -> DataFrame:
    """Each row once as group single, or twice as A and B, with its task."""
    groups = F.when(single, F.array(F.lit("single"))).otherwise(F.array(F.lit("A"), F.lit("B")))
    out = df.withColumn("group", F.explode(groups))
    return out.withColumn("task", F.create_map(*(F.lit(x) for kv in TASKS.items() for x in kv))[F.col("group")])


def defaults(df: DataFrame) -> DataFrame:
    """Derived columns of a data row: kind, targets, ground truth, question, source, with their defaults."""
    has = lambda c: c in df.columns
    out = df
    for name, value in (("question_type", F.lit("validation")), ("datasource", F.lit("unknown"))):
        out = out.withColumn(name, F.coalesce(F.col(name), value) if has(name) else value)
    if not has("target_instances"):
        out = out.withColumn("target_instances", F.array().cast("array<struct<bbox:array<double>>>"))
    if has("answer"):
        out = out.withColumn("ground_truth", F.col("answer"))
    asked = [F.col(c) for c in ("query", "problem", "question") if has(c)]
    return out.withColumn("question", F.coalesce(*asked)) if asked else out


def overlong(df: DataFrame, tokens: Column, most: int) -> DataFrame:
    return df.where(F.coalesce(tokens, F.lit(0)) <= most)


def word_count(s: Column) -> Column:
    """Tokens by white space, the default tokenizer."""
    return F.regexp_count(s, F.lit(r"[^ \t\n\r\f\x0B]+"))


def low_accuracy(df: DataFrame, accuracy: str, order: list[str], most: float = 0.4, limit: int = 200, groups: tuple[str, ...] | None = None) -> DataFrame:
    """The first rows with low accuracy; limit <= 0: all."""
    kept = df.where((F.col(accuracy) <= most) & (F.col("group").isin(*groups) if groups else F.lit(True)))
    return kept.orderBy(*order).limit(limit) if limit > 0 else kept


def qualified(accuracy: Column, box: Column, fmt: Column | None = None, valid: Column | None = None, least: float = 0.3) -> Column:
    """A rollout fit to be a reference; with fmt and valid, by the stricter rule of curation."""
    good = (accuracy == 1) & (box >= least)
    return good if fmt is None else good & (fmt == 1) & (valid == 1)


def lookup(rows: DataFrame, table: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(matched rows, one row with the numbers processed, skipped and total)."""
    marked = rows.join(table.withColumn("_found", F.lit(True)), key, "left")
    counts = marked.agg(F.count_if(F.col("_found").isNotNull()).alias("processed"), F.count_if(F.col("_found").isNull()).alias("skipped"), F.count("*").alias("total"))
    return marked.where(F.col("_found").isNotNull()).drop("_found"), counts


def pool(rows: DataFrame, table: DataFrame, key: str, column: str) -> DataFrame:
    """rows with an array column of the table, empty where the key is missing."""
    kind = dict(table.dtypes)[column]
    return rows.join(table.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.array().cast(kind)))


def pair_index(df: DataFrame, key: str, group: str, at: str) -> DataFrame:
    """(key, a, b): where each key's A and B rows are, the last of several; keys with both only."""
    at_of = lambda g: F.max(F.when(F.col(group) == g, F.col(at)))
    return df.groupBy(key).agg(at_of("A").alias("a"), at_of("B").alias("b")).where("a is not null and b is not null")


def once_per_key(df: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with compute's columns, which run once for each distinct key and fan out to its rows."""
    return df.join(compute(df.select(key).distinct()), key)


def sample_record(question: Column, think: Column, answer: Column, images: Column, system: Column, gap: str = "") -> Column:
    """Struct(images, conversations, system) of a training sample."""
    said = F.concat(F.lit("<think>"), text.strip(think), F.lit(f"</think>{gap}<answer>"), text.strip(answer), F.lit("</answer>"))
    turn = lambda who, what: F.struct(F.lit(who).alias("from"), what.alias("value"))
    return F.struct(images.alias("images"), F.array(turn("human", question), turn("gpt", said)).alias("conversations"), system.alias("system"))


def rewrites(df: DataFrame, body: Column, n: int, provider: Callable[[Column, int], Column] | None = None) -> DataFrame:
    """n variants of a text: those of the provider (text, number) without repeats, then the text without boxes."""
    plain = text.without_boxes(body)
    made = F.array_distinct(F.filter(F.array(*(provider(body, i) for i in range(n))), lambda x: x.isNotNull())) if provider else F.array().cast("array<string>")
    return df.withColumn("variants", F.concat(made, F.array_repeat(plain, F.greatest(F.lit(0), F.lit(n) - F.size(made)))))


def retained(steps: DataFrame, current: int, best: int, limit: int) -> DataFrame:
    """The older checkpoints(step) that stay: the newest limit - 1, and the best one."""
    ranked = steps.where(F.col("step") < current).orderBy(F.desc("step")).limit(max(limit - 1, 0))
    kept = steps.where(F.col("step") == best)
    return ranked.where(F.col("step") != best).limit(max(limit - 1 - 1, 0)).unionByName(kept) if limit > 1 else kept
