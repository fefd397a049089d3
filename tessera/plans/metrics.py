"""Queries on losses and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import losses, metrics
from .registry import query, table


def _round(c, digits: int = 4):
    return F.round(c, digits) + F.lit(0.0)


_TOKENS = """(SELECT a.vec_id, t, CAST(a.embedding[t + 1] AS DOUBLE) AS p, CAST(b.embedding[t + 1] AS DOUBLE) AS q, CASE WHEN t <= a.vec_id % 64 THEN 1 ELSE 0 END AS m
 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, range(64) r(t))"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of neighbouring vectors side by side: p, q and a mask m."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("e"))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    both = rows.join(after, "vec_id").select("vec_id", F.posexplode(F.arrays_zip("e", "f")).alias("t", "z"))
    return both.select("vec_id", "t", F.col("z.e").cast("double").alias("p"), F.col("z.f").cast("double").alias("q"), (F.col("t") <= F.col("vec_id") % 64).cast("int").alias("m"))


@query("kl_estimators", f"""
SELECT vec_id, CAST(t AS INTEGER) AS t, round(p - q, 4) + 0.0 AS kl, round(abs(p - q), 4) + 0.0 AS abs_kl, round(0.5 * (p - q) * (p - q), 4) + 0.0 AS mse_kl,
       round(greatest(-10.0, least(10.0, exp(greatest(-20.0, least(20.0, q - p))) - greatest(-20.0, least(20.0, q - p)) - 1)), 4) + 0.0 AS low_var_kl FROM {_TOKENS}""")
def kl_estimators(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = F.col("p"), F.col("q")
    return _tokens(spark, sf_dir).select("vec_id", "t", *(_round(losses.kl(p, q, k)).alias(n) for k, n in (("kl", "kl"), ("abs", "abs_kl"), ("mse", "mse_kl"), ("low_var_kl", "low_var_kl"))))


@query("kl_penalty", f"SELECT vec_id, CAST(t AS INTEGER) AS t, round(p - 0.1 * abs(p - q) * m, 4) + 0.0 AS reward FROM {_TOKENS}")
def kl_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    both = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f")), "vec_id")
    mask = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i <= F.col("vec_id") % 64).cast("int"))
    reward = losses.penalised(F.col("e"), F.zip_with("e", "f", lambda a, b: losses.kl(a, b, "abs")), mask, 0.1)
    return both.select("vec_id", F.posexplode(reward).alias("t", "r")).select("vec_id", "t", _round(F.col("r")).alias("reward"))


_POLICY = f"""(SELECT *, -a * exp(d) AS l1, -a * exp(greatest(ln(0.8), least(ln(1.3), d))) AS l2, -a * 3.0 AS l3 FROM (
 SELECT vec_id, t, m, p, q, greatest(-20.0, least(20.0, p - q)) AS d, p + q AS a FROM {_TOKENS}))"""


@query("ppo_loss", f"""
SELECT vec_id, CAST(t AS INTEGER) AS t, round(CASE WHEN a < 0 THEN least(greatest(l1, l2), l3) ELSE greatest(l1, l2) END, 4) + 0.0 AS loss,
       CAST(l1 < l2 AS DOUBLE) AS clipped_higher, CAST(greatest(l1, l2) > l3 AND a < 0 AS DOUBLE) AS clipped_lower FROM {_POLICY}""")
def ppo_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = losses.policy_loss(F.col("q"), F.col("p"), F.col("p") + F.col("q"), 0.2, 0.3, 3.0)
    return _tokens(spark, sf_dir).select("vec_id", "t", _round(out["loss"]).alias("loss"), out["clipped_higher"].alias("clipped_higher"), out["clipped_lower"].alias("clipped_lower"))


@query("ppo_loss_mean", f"""
WITH l AS (SELECT vec_id, m, CASE WHEN a < 0 THEN least(greatest(l1, l2), l3) ELSE greatest(l1, l2) END AS l FROM {_POLICY})
SELECT 'token' AS mode, round(sum(l * m) / (sum(m) + 1e-8), 4) + 0.0 AS loss FROM l
UNION ALL SELECT 'seq', round(avg(v), 4) + 0.0 FROM (SELECT sum(l * m) / (sum(m) + 1e-8) AS v FROM l GROUP BY vec_id)""")
def ppo_loss_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = losses.policy_loss(F.col("q"), F.col("p"), F.col("p") + F.col("q"), 0.2, 0.3, 3.0)["loss"]
    rows = _tokens(spark, sf_dir).withColumn("l", loss)
    parts = [losses.average(rows, "l", "m", "vec_id", mode).select(F.lit(mode).alias("mode"), _round(F.col("loss")).alias("loss")) for mode in ("token", "seq")]
    return reduce(DataFrame.unionByName, parts)


@query("value_loss", f"""
SELECT vec_id, CAST(t AS INTEGER) AS t, round(0.5 * greatest((p - r) * (p - r), (c - r) * (c - r)), 4) + 0.0 AS loss, CAST((p - r) * (p - r) < (c - r) * (c - r) AS DOUBLE) AS clipped
FROM (SELECT *, greatest(q - 0.05, least(q + 0.05, p)) AS c FROM (SELECT *, 2 * q AS r FROM {_TOKENS}))""")
def value_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = losses.value_loss(F.col("p"), 2 * F.col("q"), F.col("q"), 0.05)
    return _tokens(spark, sf_dir).select("vec_id", "t", _round(out["loss"]).alias("loss"), out["clipped"].alias("clipped"))


@query("length_metrics", "SELECT round(avg(n_chars), 4) + 0.0 AS response_mean, max(n_chars) AS response_max, min(n_chars) AS response_min, round(avg(CASE WHEN n_chars = 1000 THEN 1.0 ELSE 0.0 END), 4) + 0.0 AS response_clip_ratio FROM documents")
def length_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.length_metrics(table(spark, sf_dir, "documents"), "n_chars", F.lit(1000), "response")
    return out.select(_round(F.col("response_mean")).alias("response_mean"), "response_max", "response_min", _round(F.col("response_clip_ratio")).alias("response_clip_ratio"))


@query("data_metrics", """
SELECT round(CAST(sum(v) AS DOUBLE) / count(*), 4) + 0.0 AS advantages_mean, max(v) AS advantages_max, min(v) AS advantages_min FROM (
 SELECT vec_id, t, CAST(round(CAST(embedding[t + 1] AS DOUBLE) * 10000) AS BIGINT) AS v FROM embeddings, range(64) r(t)) WHERE t <= vec_id % 64""")
def data_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("t", "x")).where("t <= vec_id % 64")
    out = metrics.spread(rows.select(F.round(F.col("x").cast("double") * 10000).cast("long").alias("v")), "v", "advantages")
    return out.select(_round(F.col("advantages_mean")).alias("advantages_mean"), "advantages_max", "advantages_min")


@query("explained_variance", f"SELECT round(1 - var_samp(p - q) / (var_samp(p) + 1e-5), 4) + 0.0 AS explained_variance FROM {_TOKENS} WHERE m = 1")
def explained_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.explained_variance(_tokens(spark, sf_dir).where("m = 1"), "p", "q").select(_round(F.col("explained_variance")).alias("explained_variance"))


_SECTION = "CASE event_type WHEN 'view' THEN 'gen' WHEN 'click' THEN 'reward' WHEN 'purchase' THEN 'adv' ELSE event_type END"


@query("timing_metrics", f"""
SELECT section, seconds, round(CASE section WHEN 'gen' THEN seconds * 1000 / 5000 WHEN 'reward' THEN seconds * 1000 / 5000 WHEN 'adv' THEN seconds * 1000 / 20000 END, 4) + 0.0 AS ms_per_token
FROM (SELECT {_SECTION} AS section, CAST(sum(CAST(round(value) AS BIGINT)) AS DOUBLE) AS seconds FROM events GROUP BY 1)""")
def timing_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = table(spark, sf_dir, "events").groupBy(F.expr(_SECTION).alias("section")).agg(F.sum(F.round("value").cast("long")).cast("double").alias("seconds"))
    return metrics.timing(sections, 5000, 20000).select("section", "seconds", _round(F.col("ms_per_token")).alias("ms_per_token"))


@query("throughput", "SELECT event_type, n, round(CAST(n AS DOUBLE) / (s * 8), 4) + 0.0 AS throughput FROM (SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value) AS BIGINT)) AS DOUBLE) AS s FROM events GROUP BY 1)")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.round("value").cast("long")).cast("double").alias("s"))
    return sums.select("event_type", "n", _round(metrics.throughput(F.col("n"), F.col("s"), 8)).alias("throughput"))


@query("reduce_metrics", """
SELECT event_type, round(coalesce(CAST(sum(v) AS DOUBLE) / count(v), -1), 4) + 0.0 AS mean FROM (SELECT event_type, CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) END AS v FROM events) GROUP BY event_type""")
def reduce_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.round(F.col("value") * 100))
    out = metrics.reduce_means(table(spark, sf_dir, "events").select("event_type", value.alias("v")), "event_type", "v")
    return out.select("event_type", _round(F.nanvl("mean", F.lit(-1.0))).alias("mean"))


_GROUP = "CASE role WHEN 'user' THEN 'A' WHEN 'assistant' THEN 'B' ELSE 'single' END"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_GROUP).alias("group"), F.length("text").cast("long").alias("n"))


@query("group_stats", f"SELECT {_GROUP} AS \"group\", count(*) AS n, round(avg(length(text)), 4) + 0.0 AS mean_n FROM conversations GROUP BY 1")
def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.group_stats(_turns(spark, sf_dir), "group", ["n"]).select("group", "n", _round(F.col("mean_n")).alias("mean_n"))


@query("prefixed_metrics", f"""
WITH t AS (SELECT conv_id, turn, {_GROUP} AS g, length(text) AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN g = 'A' THEN n END AS "group_a/n", CASE WHEN g = 'B' THEN n END AS "group_b/n", CASE WHEN g = 'single' THEN n END AS "single/n",
       count(*) FILTER (g = 'A') OVER () AS "batch/n_group_a", count(*) FILTER (g = 'B') OVER () AS "batch/n_group_b", count(*) FILTER (g = 'single') OVER () AS "batch/n_single" FROM t""")
def prefixed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.prefixed(_turns(spark, sf_dir), "group", {"A": "group_a", "B": "group_b", "single": "single"}, ["n"]).drop("group", "n")


@query("flops", "SELECT CAST(sum(n_chars) AS BIGINT) AS tokens, CAST(sum(n_chars * n_chars) AS BIGINT) AS pairs, 6.0::DOUBLE * 7000000 * sum(n_chars)::DOUBLE + 12.0::DOUBLE * 28 * 64 * sum(n_chars * n_chars)::DOUBLE AS flops FROM documents")
def flops(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.flops(table(spark, sf_dir, "documents"), "n_chars", 64, 28, 7_000_000)
    return out.select("tokens", F.col("pairs").cast("long").alias("pairs"), "flops")


@query("cache_stats", "SELECT count(*) AS size, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END), 4) + 0.0 AS mean_accuracy, round(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*), 4) + 0.0 AS mean_value FROM events")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("event_type") == "purchase").cast("double").alias("accuracy"), F.round(F.col("value") * 100).cast("long").alias("value"))
    return metrics.cache_stats(rows).select("size", _round(F.col("mean_accuracy")).alias("mean_accuracy"), _round(F.col("mean_value")).alias("mean_value"))


@query("image_stats", "SELECT count(*) AS n, round(avg(p_size * 100), 4) + 0.0 AS mean_before, round(avg(least(p_size * 100, 2000)), 4) + 0.0 AS mean_after, round(100.0 * (1 - sum(least(p_size * 100, 2000))::DOUBLE / sum(p_size * 100)::DOUBLE), 4) + 0.0 AS reduction_percent FROM part")
def image_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").select((F.col("p_size").cast("long") * 100).alias("before")).withColumn("after", F.least("before", F.lit(2000)))
    out = metrics.image_stats(sizes, "before", "after")
    return out.select("n", *(_round(F.col(c)).alias(c) for c in ("mean_before", "mean_after", "reduction_percent")))
