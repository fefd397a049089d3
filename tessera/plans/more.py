"""Queries on prompts, tokens, providers and validation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, prompts, tokens
from ..operators import curation, providers
from .curations import SOURCES
from .registry import query, table
from .shared import shared_dir


@query("prompt_builders", r"""
SELECT conv_id, turn, CASE role WHEN 'system' THEN 'text' WHEN 'user' THEN 'image,text' ELSE 'text' END AS kinds,
       CASE role WHEN 'assistant' THEN 'Look: ' || text ELSE text END AS said FROM conversations""")
def prompt_builders(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "math").when(F.col("role") == "assistant", "grounding").otherwise("other")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", prompts.messages(kind, F.col("text"), {"grounding": "Look: {{ content }}"})[0]["content"].alias("c"))
    return rows.select("conv_id", "turn", F.array_join(F.transform("c", lambda x: x["type"]), ",").alias("kinds"), F.element_at("c", -1)["text"].alias("said"))


@query("index_counts", "SELECT count(*) FILTER (source IN ('src1', 'src3', 'src5', 'src7', 'src9')) AS single, count(*) FILTER (source NOT IN ('src1', 'src3', 'src5', 'src7', 'src9')) * 2 AS dual FROM documents")
def index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curation.fan_out(table(spark, sf_dir, "documents").select("doc_id", "source"), F.col("source").isin(*SOURCES))
    return rows.agg(F.count_if(F.col("group") == "single").alias("single"), F.count_if(F.col("group") != "single").alias("dual"))


@query("validation_metrics", "SELECT 'val/' || source AS metric, round(avg(quality), 4) + 0.0 AS value FROM labels JOIN documents USING (doc_id) GROUP BY source UNION ALL SELECT 'val/reward_score', round(avg(quality), 4) + 0.0 FROM labels JOIN documents USING (doc_id)")
def validation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    by_source = rows.groupBy("source").agg(F.avg("quality").alias("v")).select(F.concat(F.lit("val/"), "source").alias("metric"), "v")
    whole = rows.agg(F.avg("quality").alias("v")).select(F.lit("val/reward_score").alias("metric"), "v")
    return by_source.unionByName(whole).select("metric", (F.round("v", 4) + F.lit(0.0)).alias("value"))


@query("judge_mean", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE round(((event_id % 5) / 5.0::DOUBLE + (event_id % 7) / 7.0::DOUBLE) / 2, 4) + 0.0 END AS mean FROM events""")
def judge_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.array(F.lit(None).cast("double"), (F.col("event_id") % 5) / 5.0, (F.col("event_id") % 7) / 7.0)
    scores = F.when(F.col("event_id") % 3 == 0, F.array().cast("array<double>")).otherwise(given)
    return table(spark, sf_dir, "events").select("event_id", (F.round(providers.judge_mean(scores), 4) + F.lit(0.0)).alias("mean"))


@query("masked_select", "SELECT vec_id, CAST(t AS INTEGER) AS t, CAST(embedding[t + 1] AS DOUBLE) AS value FROM embeddings, range(64) r(t) WHERE t <= vec_id % 64")
def masked_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid tokens as rows: the padding removed."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("t", "value"))
    return rows.where(F.col("t") <= F.col("vec_id") % 64).select("vec_id", "t", F.col("value").cast("double").alias("value"))


@query("repad", "SELECT vec_id, CAST(64 AS INTEGER) AS n, round(sum(CASE WHEN t <= vec_id % 64 THEN CAST(embedding[t + 1] AS DOUBLE) ELSE 0 END), 4) + 0.0 AS total FROM embeddings, range(64) r(t) GROUP BY vec_id")
def repad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows put together again from their valid tokens and padded."""
    from ..functions import arrays

    valid = masked_select(spark, sf_dir)
    back = valid.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda x: x["value"]).alias("v"))
    padded = back.select("vec_id", arrays.fit(F.col("v"), 64, 0.0, False).alias("v"))
    return padded.select("vec_id", F.size("v").alias("n"), (F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4) + F.lit(0.0)).alias("total"))


@query("best_validation", """
WITH s AS (SELECT CAST(month(o_orderdate) AS INTEGER) AS step, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS score FROM orders GROUP BY 1)
SELECT a.step, a.score, max(b.score) AS best_score, CAST(arg_max(b.step, b.score) AS INTEGER) AS best_step FROM s a JOIN s b ON b.step <= a.step GROUP BY ALL""")
def best_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "orders").groupBy(F.month("o_orderdate").alias("step")).agg(F.sum(F.round("o_totalprice").cast("long")).alias("score"))
    return providers.best_step(scores, "step", "score")


@query("resume", "SELECT doc_id, doc_id // 64 AS batch_id FROM documents WHERE doc_id // 64 > 3")
def resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.resume(table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 64).alias("batch_id")), "batch_id", 3)


@query("point_match", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 50 BETWEEN 10 AND 40 AND l_suppkey % 40 BETWEEN 10 AND 40 AS inside FROM lineitem")
def point_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = F.array(F.array(*(F.lit(v) for v in (10, 10, 40, 40)))).cast("array<array<bigint>>")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", geometry.holds_point(boxes, F.col("l_partkey") % 50, F.col("l_suppkey") % 40).alias("inside"))


@query("best_match", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 4 THEN 1 ELSE -1 END AS match FROM lineitem")
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as boxes of growing width against two fixed ones; only a width of 40 fits one of them well."""
    own = F.array(F.lit(0), F.lit(0), F.col("l_linenumber") * 10, F.lit(10)).cast("array<bigint>")
    others = F.array(F.array(*(F.lit(v) for v in (50, 50, 60, 60))), F.array(*(F.lit(v) for v in (0, 0, 40, 10)))).cast("array<array<bigint>>")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", geometry.best_match(own, others, 0.8).alias("match"))


@query("token_roundtrip", "SELECT doc_id, md5(text) AS digest FROM documents")
def token_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tokens.decode(tokens.encode(F.col("text")))).alias("digest"))


@query("rope_index")
def rope_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of made-up rows: text, an image of one frame and four by four patches, text."""
    n = F.col("vec_id") % 5
    ids = F.concat(F.array_repeat(F.lit(7), (n + 1).cast("int")), F.array_repeat(F.lit(99), 4), F.array(F.lit(8), F.lit(9))).cast("array<bigint>")
    grids = F.array(F.array(F.lit(1), F.lit(4), F.lit(4))).cast("array<array<bigint>>")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", tokens.rope_index(ids, grids, 99).alias("p"))
    return rows.select("vec_id", *(F.array_join(F.transform(F.col("p")[i], lambda x: x.cast("string")), ",").alias(c) for i, c in enumerate(("frames", "rows", "columns"))))


@query("saved_batch", "SELECT n_nationkey, n_name FROM nation")
def saved_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch written to disk and loaded again."""
    place = f"{shared_dir(spark)}/tessera-batch-{uuid.uuid4().hex}"
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.parquet(place)
    return spark.read.parquet(place)
