"""Queries on filters, joins and curation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curation, groups
from ..sources import files, sinks
from .registry import query, table
from .shared import shared_dir

SOURCES = ("src1", "src3", "src5", "src7", "src9")
_IN = "('src1', 'src3', 'src5', 'src7', 'src9')"


@query("allow_list", f"SELECT doc_id, source FROM documents WHERE source IN {_IN}")
def allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.allow(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", SOURCES)


_FAN = f"SELECT doc_id, g AS \"group\" FROM documents, (VALUES ('single'), ('A'), ('B')) v(g) WHERE (g = 'single') = (source IN {_IN})"


def _fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.fan_out(table(spark, sf_dir, "documents").select("doc_id", "source"), F.col("source").isin(*SOURCES))


@query("ab_fanout", f"SELECT doc_id, \"group\", CASE \"group\" WHEN 'A' THEN 'grounding' WHEN 'B' THEN 'math_nobox' ELSE 'math_single' END AS task FROM ({_FAN})")
def ab_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fan(spark, sf_dir).select("doc_id", "group", "task")


@query("pair_index", f"SELECT doc_id, doc_id * 2 AS a, doc_id * 2 + 1 AS b FROM documents WHERE source NOT IN {_IN}")
def pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fan(spark, sf_dir).withColumn("at", F.col("doc_id") * 2 + (F.col("group") == "B").cast("int"))
    return curation.pair_index(rows, "doc_id", "group", "at")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")


@query("low_accuracy_limit", "SELECT doc_id, source FROM labels JOIN documents USING (doc_id) WHERE quality <= 0.4 ORDER BY doc_id LIMIT 200")
def low_accuracy_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.low_accuracy(_labelled(spark, sf_dir), "quality", ["doc_id"]).select("doc_id", "source")


@query("qualified_top1", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
 SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.03) WHERE r = 1""")
def qualified_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_discount")
    fit = rows.where(curation.qualified((F.col("l_returnflag") == "R").cast("int"), F.col("l_discount"), least=0.03))
    return groups.top_one(fit, ["l_orderkey"], "l_quantity", ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("semi_trained", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@query("anti_resume", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("left_pool", "SELECT doc_id, CASE WHEN quality IS NULL THEN 0 ELSE 1 END AS n_pool, coalesce(quality, -1) AS first_pool FROM documents LEFT JOIN labels USING (doc_id)")
def left_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = table(spark, sf_dir, "labels").select("doc_id", F.array("quality").alias("pool"))
    rows = curation.pool(table(spark, sf_dir, "documents").select("doc_id"), pools, "doc_id", "pool")
    return rows.select("doc_id", F.size("pool").alias("n_pool"), F.coalesce(F.get("pool", F.lit(0)), F.lit(-1)).alias("first_pool"))


@query("inner_skip_count", "SELECT count(l.doc_id) AS processed, count(*) - count(l.doc_id) AS skipped, count(*) AS total FROM documents d LEFT JOIN labels l USING (doc_id)")
def inner_skip_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.lookup(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")[1]


@query("dedup_fanout", "SELECT doc_id, md5(text) AS key, length(text) AS n FROM documents WHERE text IS NOT NULL")
def dedup_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value that is computed once for each distinct text and fans out to its copies."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    once = curation.once_per_key(docs, "text", lambda t: t.select("text", F.md5("text").alias("key"), F.length("text").cast("long").alias("n")))
    return once.select("doc_id", "key", "n")


@query("distinct_first", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.first_rows(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"])


@query("sft_pairs", r"""
SELECT u.conv_id, u.turn, u.text AS question, '<think>' || regexp_replace(a.text, '^\s+|\s+$', '', 'g') || '</think><answer>' || a.role || '</answer>' AS reply
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""")
def sft_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("think"), "role")
    record = curation.sample_record(F.col("question"), F.col("think"), F.col("role"), F.array().cast("array<string>"), F.lit(""))
    rows = asked.join(said, ["conv_id", "turn"]).select("conv_id", "turn", record.alias("s"))
    return rows.select("conv_id", "turn", F.col("s.conversations")[0]["value"].alias("question"), F.col("s.conversations")[1]["value"].alias("reply"))


@query("rewrites", r"SELECT doc_id, 3 AS n_variants, md5(regexp_replace(regexp_replace(text, '[ \n]+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents")
def rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return curation.rewrites(docs.select("doc_id", "text"), F.col("text"), 3).select("doc_id", F.size("variants").alias("n_variants"), F.md5(F.col("variants")[2]).alias("digest"))


@query("retention", """
WITH s AS (SELECT DISTINCT year(o_orderdate) * 12 + month(o_orderdate) AS step FROM orders), m AS (SELECT max(step) AS c, min(step) AS b FROM s),
o AS (SELECT step, row_number() OVER (ORDER BY step DESC) AS r FROM s, m WHERE step < c)
SELECT CAST(step AS INTEGER) AS step FROM o, m WHERE r <= 3 AND step <> b UNION SELECT CAST(b AS INTEGER) FROM m""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "orders").select((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("step")).distinct()
    current, best = steps.agg(F.max("step"), F.min("step")).first()
    return curation.retained(steps, current, best, 5)


@query("cache_roundtrip", """
WITH b AS (SELECT user_id AS original_idx, event_type || ' ' || event_id AS think, value, event_id AS step, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events WHERE value IS NOT NULL)
SELECT original_idx, 1.0::DOUBLE AS accuracy, value, think, step FROM b WHERE place = 1""")
def cache_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best reference of each key, written as cache documents and read again as the state of a later run."""
    rows = table(spark, sf_dir, "events").where("value is not null")
    rows = rows.select(F.col("user_id").alias("original_idx"), F.lit(1.0).alias("accuracy"), "value", F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("think"), F.col("event_id").alias("step"))
    place = f"{shared_dir(spark)}/tessera-cache-{uuid.uuid4().hex}"
    sinks.write_cache(groups.top_one(rows, ["original_idx"], "value", ["step"]), place, 7, documents=3)
    return files.reference_state(spark, place)


@query("step_log_roundtrip", "SELECT event_id % 5 AS step, event_id AS index, event_type AS question, props AS response, user_id AS original_idx, value AS overall, 1 AS n_rewards FROM events")
def step_log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as step logs, one file for each step, and read again."""
    rows = table(spark, sf_dir, "events").select(
        (F.col("event_id") % 5).alias("step"), F.col("event_id").alias("index"), F.col("event_type").alias("question"), F.lit("x").alias("ground_truth"), F.col("props").alias("response"), F.lit("A").alias("group"),
        F.col("user_id").alias("original_idx"), F.lit("events").alias("datasource"), F.create_map(F.lit("overall"), F.col("value"), F.lit("_hidden"), F.lit(1.0)).alias("rewards"),
    )
    place = f"{shared_dir(spark)}/tessera-logs-{uuid.uuid4().hex}"
    sinks.write_step_logs(rows, place)
    return files.step_logs(spark, place).select("step", "index", "question", "response", "original_idx", F.col("rewards")["overall"].alias("overall"), F.size("rewards").alias("n_rewards"))
