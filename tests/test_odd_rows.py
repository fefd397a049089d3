"""Queries on odd rows, and on cuts so small that a few rows take the paths of large tables."""

import hashlib

import duckdb
from oracle import rows
from pyspark.sql import functions as F

from tessera.plans import catalogue
from tessera.sources import files, sinks


def test_message_parts_of_odd_rows_equal_sql(spark, tmp_path):
    """Empty and null texts, markers alone, and rows that share a doc_id or have none."""
    said = [(1, ""), (2, None), (3, "\n\n"), (4, "a\nb"), (4, "a\nb"), (5, "x\r\ny\0z\n"), (6, "\\E\n."), (None, "q\nr"), (None, "q\nr"), (7, None), (7, "\nk"), (8, "\U0001f600\n\u2028é"), (9, " "), (10, ""), (10, "\n"), (None, None), (11, "a\na"), (11, "a\na\na")]
    spark.createDataFrame(said, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    mine, theirs = catalogue.QUERIES["message_parts"](spark, str(tmp_path)).toPandas(), c.execute(catalogue.ORACLES["message_parts"]).df()
    assert rows(mine) == rows(theirs)


def test_message_parts_of_equal_place_stand_in_the_order_of_rows(spark, tmp_path):
    said = [(1, "z\ny"), (2, "p"), (1, "b\n\nc"), (2, "o")]
    spark.createDataFrame(said, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: (r.n_media, r.n_text, r.digest) for r in catalogue.QUERIES["message_parts"](spark, str(tmp_path)).collect()}
    assert out == {1: (3, 4, hashlib.md5(b"z|b|y|c").hexdigest()), 2: (0, 2, hashlib.md5(b"p|o").hexdigest())}


def _scored(rows, length):
    return rows.select(
        "step", F.col("id").alias("index"), F.lit('q\u00e9 \\"{,').alias("question"), F.lit("g").alias("ground_truth"), F.repeat(F.lit("x"), length).alias("response"), F.lit("A").alias("group"),
        F.col("id").alias("original_idx"), F.lit("d").alias("datasource"), F.create_map(F.lit("overall"), F.when(F.col("id") % 3 > 0, F.col("id") / 3), F.lit("_hidden"), F.lit(1.0)).alias("rewards"),
    )


def test_no_task_holds_a_large_step(spark):
    scored = _scored(spark.range(120_000).withColumn("step", F.lit(7).cast("long")), 500)
    sizes = [r.n for r in sinks.step_documents(scored).select(F.octet_length("document").alias("n")).collect()]
    assert sum(sizes) > 70_000_000
    assert max(sizes) < 33_000_000


def test_parts_of_large_steps_keep_all_samples_in_order(spark, tmp_path):
    """Steps 1 and 3 are cut, 2 and 4 are whole; one index comes often."""
    few = spark.range(3).withColumn("step", F.lit(2).cast("long")).unionByName(spark.range(1).withColumn("step", F.lit(4).cast("long")))
    many = spark.range(900).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id") * 1000).alias("id"), (F.col("id") % 2 * 2 + 1).alias("step"))
    scored = _scored(few.unionByName(many), 50)
    names = [r.name for r in sinks.step_documents(scored, 5000).collect()]
    assert len(set(names)) == len(names)
    assert {n for n in names if n.count(".") == 1} == {"step_000002.json", "step_000004.json"}
    assert min(sum(n.startswith(f"step_00000{k}.") for n in names) for k in (1, 3)) > 10
    sinks.write_step_logs(scored, str(tmp_path / "logs"), 5000)
    back = files.step_logs(spark, str(tmp_path / "logs")).orderBy("step", "part", "place").collect()
    assert [(r.step, r["index"]) for r in back] == sorted((r.step, r["index"]) for r in scored.collect())
    kept = lambda r, m: (r.step, r["index"], r.question, r.ground_truth, r.response, r.group, r.original_idx, r.datasource, m)
    assert sorted(map(repr, (kept(r, r.rewards) for r in back))) == sorted(map(repr, (kept(r, {"overall": r.rewards["overall"]}) for r in scored.collect())))
