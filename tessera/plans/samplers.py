"""Queries on samplers, batches and balanced partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import balance, batch, curation, sampling
from .curations import SOURCES
from .registry import query, table

_IN = "('src1', 'src3', 'src5', 'src7', 'src9')"


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")


@query("paired_sampler", f"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS p FROM documents WHERE source NOT IN {_IN})
SELECT doc_id, g AS "group", p * 2 + (CASE g WHEN 'A' THEN 0 ELSE 1 END) AS pos FROM d, (VALUES ('A'), ('B')) v(g)""")
def paired_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = curation.fan_out(_ids(spark, sf_dir).where(~F.col("source").isin(*SOURCES)), F.lit(False))
    return sampling.paired(pairs, "doc_id", "group", 42).select("doc_id", "group", "pos")


@query("mixed_sampler", f"""
WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS n FROM documents WHERE source NOT IN {_IN}),
c AS (SELECT (SELECT count(*) FROM p) // 5 AS nb, (SELECT count(*) FROM documents WHERE source IN {_IN}) AS ns),
s AS (SELECT doc_id, pass * (SELECT ns FROM c) + row_number() OVER (PARTITION BY pass ORDER BY md5('7:' || pass || ':' || doc_id), doc_id) - 1 AS slot
      FROM documents, range(100) r(pass) WHERE source IN {_IN} AND pass * (SELECT ns FROM c) < (SELECT nb * 6 FROM c))
SELECT n // 5 AS batch_id, n % 5 * 2 + m AS slot, doc_id, 'pair' AS kind, CAST(m AS INTEGER) AS member FROM p, range(2) r(m) WHERE n < (SELECT nb * 5 FROM c)
UNION ALL SELECT slot // 6, 10 + slot % 6, doc_id, 'single', 0 FROM s WHERE slot < (SELECT nb * 6 FROM c)""")
def mixed_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, single = _ids(spark, sf_dir), F.col("source").isin(*SOURCES)
    return sampling.mixed(docs.where(~single).select("doc_id"), docs.where(single).select("doc_id"), "doc_id", 7, 16, 0.65)


@query("random_sample", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('3:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 5")
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample(_ids(spark, sf_dir), ["source"], "doc_id", 5, 3).select("source", "doc_id")


@query("validation_sample", "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 20")
def validation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_all(_ids(spark, sf_dir), "doc_id", 20, 42).select("doc_id")


@query("random_sampler", "SELECT doc_id, row_number() OVER (ORDER BY md5('1:' || doc_id), doc_id) - 1 AS pos FROM documents")
def random_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.shuffled(_ids(spark, sf_dir), "doc_id", 1).select("doc_id", "pos")


@query("loader_batches", "SELECT pos, doc_id, pos // 64 AS batch_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) WHERE pos < (SELECT count(*) FROM documents) // 64 * 64")
def loader_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batch.with_pos(_ids(spark, sf_dir).select("doc_id"), "doc_id")
    return sampling.batches(rows, 64, True).select("pos", "doc_id", "batch_id")


@query("epochs", """
WITH d AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents) WHERE p < (SELECT count(*) FROM documents) // 50 * 50)
SELECT epoch, doc_id, pos, pos // 50 AS batch_id FROM (SELECT CAST(e AS INTEGER) AS epoch, doc_id, row_number() OVER (PARTITION BY e ORDER BY md5('5:' || e || ':' || doc_id), doc_id) - 1 AS pos FROM d, range(2) r(e))""")
def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes over the documents, cut to whole mini-batches."""
    rows = batch.with_pos(_ids(spark, sf_dir).select("doc_id"), "doc_id")
    n = rows.count() // 50 * 50
    return sampling.epochs(rows.where(F.col("pos") < n), 50, 2, 5, "doc_id", n).select("epoch", "doc_id", "pos", "batch_id")


@query("batch_accumulate", """
WITH d AS (SELECT doc_id, doc_id // 32 AS batch FROM documents WHERE n_chars % 3 <> 0), n AS (SELECT *, row_number() OVER (ORDER BY batch, doc_id) AS r FROM d)
SELECT doc_id, batch FROM n WHERE r <= 100""")
def batch_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ids(spark, sf_dir).withColumn("batch", F.floor(F.col("doc_id") / 32))
    return sampling.accumulate(rows, "batch", "doc_id", F.col("n_chars") % 3 != 0, 100).select("doc_id", "batch")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(spark, sf_dir).select(F.floor(F.col("doc_id") / 64).alias("batch"), F.col("doc_id").alias("pos"), "n_chars")


@query("kk_partition")
def kk_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced parts of whole batches of 64 documents."""
    rows = _sized(spark, sf_dir)
    whole = rows.groupBy("batch").agg(F.count("*").alias("n")).where("n = 64").select("batch")
    return balance.partition(rows.join(whole, "batch", "left_semi"), "batch", "n_chars", 8, True)


@query("micro_batches")
def micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.dynamic(_sized(spark, sf_dir), "batch", "n_chars", 20_000)


@query("seqlen_stats", """
WITH n AS (SELECT count(*) // 8 AS run FROM documents), d AS (SELECT n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents),
b AS (SELECT sum(n_chars) AS s FROM d, n GROUP BY pos // n.run), a AS (SELECT sum(n_chars) AS s FROM d GROUP BY pos % 8)
SELECT CAST((SELECT min(s) FROM b) AS BIGINT) AS before_min, CAST((SELECT max(s) FROM b) AS BIGINT) AS before_max, CAST((SELECT min(s) FROM a) AS BIGINT) AS after_min, CAST((SELECT max(s) FROM a) AS BIGINT) AS after_max,
 (SELECT sum(s) FROM a)::DOUBLE / 8 AS mean, CAST((SELECT max(s) - min(s) FROM b) AS BIGINT) AS before_diff, CAST((SELECT max(s) - min(s) FROM a) AS BIGINT) AS after_diff""")
def seqlen_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batch.with_pos(_ids(spark, sf_dir), "doc_id")
    return balance.load_stats(rows.withColumn("part", F.col("pos") % 8), "n_chars", 8, rows.count())
