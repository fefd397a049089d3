"""Metric aggregation: means that skip what doesn't apply, lengths, timings, throughput, group statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sections whose time is held against response tokens, and against all tokens.
BY_RESPONSE = ("gen", "reward")
BY_ALL = ("ref", "old", "values", "adv", "update_critic", "update_actor")


def reduce_means(df: DataFrame, metric: str, value: str) -> DataFrame:
    """(metric, mean): NaN and null are skipped; NaN if nothing is left."""
    known = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(metric).agg(F.coalesce(F.avg(known), F.lit(float("nan"))).alias("mean"))


def length_metrics(df: DataFrame, length: str, longest: Column, prefix: str) -> DataFrame:
    n = F.col(length)
    return df.agg(F.avg(n).alias(f"{prefix}_mean"), F.max(n).alias(f"{prefix}_max"), F.min(n).alias(f"{prefix}_min"), F.avg((n == longest).cast("double")).alias(f"{prefix}_clip_ratio"))


def spread(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.agg(F.avg(column).alias(f"{prefix}_mean"), F.max(column).alias(f"{prefix}_max"), F.min(column).alias(f"{prefix}_min"))


def explained_variance(df: DataFrame, returns: str, values: str) -> DataFrame:
    return df.agg((1 - F.var_samp(F.col(returns) - F.col(values)) / (F.var_samp(returns) + 1e-5)).alias("explained_variance"))


def timing(sections: DataFrame, response_tokens: int, all_tokens: int) -> DataFrame:
    """sections(section, seconds) with milliseconds for each token, where the section has a token count."""
    tokens = F.when(F.col("section").isin(*BY_RESPONSE), F.lit(response_tokens)).when(F.col("section").isin(*BY_ALL), F.lit(all_tokens))
    return sections.select("section", "seconds", F.try_divide(F.col("seconds") * 1000, tokens).alias("ms_per_token"))


def throughput(tokens: Column, seconds: Column, devices: int) -> Column:
    return F.try_divide(tokens.cast("double"), seconds * devices)


def group_stats(df: DataFrame, group: str, values: list[str]) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n"), *(F.avg(v).alias(f"mean_{v}") for v in values))


def prefixed(df: DataFrame, group: str, names: dict[str, str], values: list[str]) -> DataFrame:
    """Columns prefix/value that hold the value in rows of the group only; batch/n_prefix counts all rows of the group."""
    columns = [F.when(F.col(group) == g, F.col(v)).alias(f"{p}/{v}") for g, p in names.items() for v in values]
    counts = df.agg(*(F.count_if(F.col(group) == g).alias(f"batch/n_{p}") for g, p in names.items()))
    return df.select("*", *columns).crossJoin(F.broadcast(counts))  # one row of counts


def drop_internal(m: Column) -> Column:
    """A map without the keys that begin with an underscore."""
    return F.map_filter(m, lambda k, v: ~k.startswith("_"))


def flops(lengths: DataFrame, length: str, hidden: int, layers: int, parameters: int) -> DataFrame:
    """Training work of a batch: 6 for each parameter and token, and 12 * layers * hidden for each pair of tokens of a row."""
    n = F.col(length).cast("decimal(38,0)")
    sums = lengths.agg(F.sum(F.col(length)).alias("tokens"), F.sum(n * n).cast("decimal(38,0)").alias("pairs"))
    return sums.select("tokens", "pairs", (6.0 * parameters * F.col("tokens") + 12.0 * layers * hidden * F.col("pairs").cast("double")).alias("flops"))


def cache_stats(df: DataFrame) -> DataFrame:
    """One row about a table of best references(accuracy, value); zeros if it is empty."""
    return df.agg(F.count("*").alias("size"), F.coalesce(F.avg("accuracy"), F.lit(0.0)).alias("mean_accuracy"), F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean_value"))


def image_stats(df: DataFrame, before: str, after: str) -> DataFrame:
    b, a = F.sum(before), F.sum(after)
    return df.agg(F.count("*").alias("n"), F.avg(before).alias("mean_before"), F.avg(after).alias("mean_after"), (100.0 * (1 - F.try_divide(a.cast("double"), b.cast("double")))).alias("reduction_percent"))
