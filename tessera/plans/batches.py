"""Queries on the batch algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batch
from .registry import query, table

_ORDERS = "SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders"


def _orders(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return batch.with_pos(table(spark, sf_dir, "orders").select("o_orderkey", *columns), "o_orderkey")


@query("select_pop_rename", f"SELECT pos, o_orderkey AS key, o_orderstatus AS status FROM ({_ORDERS})")
def select_pop_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = batch.select(_orders(spark, sf_dir, "o_orderstatus", "o_totalprice"), ["o_orderkey", "o_orderstatus", "o_totalprice", "missing"])
    _, rest = batch.pop(kept, ["o_totalprice"])
    return batch.rename(rest, ["o_orderkey", "o_orderstatus"], ["key", "status"])


@query("positional_union", f"SELECT pos, o_orderkey, o_orderstatus, o_totalprice FROM ({_ORDERS})")
def positional_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir, "o_orderstatus", "o_totalprice")
    return batch.union_columns(rows.select("pos", "o_orderkey", "o_orderstatus"), rows.select("pos", "o_orderkey", "o_totalprice"))


@query("concat", """
SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, c_custkey AS key, c_name AS name FROM customer
UNION ALL SELECT (SELECT count(*) FROM customer) + row_number() OVER (ORDER BY s_suppkey) - 1, s_suppkey, s_name FROM supplier""")
def concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return batch.concat([batch.with_pos(customers, "key"), batch.with_pos(suppliers, "key")]).select("pos", "key", "name")


@query("chunk", f"SELECT pos, o_orderkey, pos // ((SELECT count(*) FROM orders) // 8) AS chunk FROM ({_ORDERS}) WHERE pos < (SELECT count(*) FROM orders) // 8 * 8")
def chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    n = table(spark, sf_dir, "orders").count() // 8 * 8
    return rows.where(F.col("pos") < n).withColumn("chunk", batch.chunk_id(n, 8)).select("pos", "o_orderkey", "chunk")


@query("split", f"SELECT pos, o_orderkey, pos // 1000 AS part FROM ({_ORDERS})")
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("pos", "o_orderkey", batch.split_id(1000).alias("part"))


@query("fold", f"""
SELECT pos // ((SELECT count(*) FROM orders) // 10) AS fold, string_agg(o_orderkey::VARCHAR, ',' ORDER BY pos) AS keys FROM ({_ORDERS})
WHERE pos < (SELECT count(*) FROM orders) // 10 * 10 GROUP BY 1""")
def fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").count() // 10 * 10
    folded = batch.fold(_orders(spark, sf_dir).where(F.col("pos") < n), 10, n, "o_orderkey")
    return folded.select("fold", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("keys"))


_NATION = "SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS pos FROM nation"


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.with_pos(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")


@query("repeat_interleave", f"SELECT pos * 3 + k AS pos, n_name FROM ({_NATION}), range(3) r(k)")
def repeat_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.repeat(_nation(spark, sf_dir), 3, True).select("pos", "n_name")


@query("repeat_tile", f"SELECT k * (SELECT count(*) FROM nation) + pos AS pos, n_name FROM ({_NATION}), range(3) r(k)")
def repeat_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.repeat(_nation(spark, sf_dir), 3, False).select("pos", "n_name")


_SUPPLIER = "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier"


@query("pad_divisor", f"""
WITH s AS ({_SUPPLIER}), n AS (SELECT count(*) AS n, (7 - count(*) % 7) % 7 AS extra FROM supplier)
SELECT pos, s_suppkey FROM s UNION ALL SELECT n.n + i, s.s_suppkey FROM n, range(7) r(i) JOIN s ON s.pos = i % (SELECT count(*) FROM supplier) WHERE i < n.extra""")
def pad_divisor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batch.with_pos(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey")
    return batch.pad_to_divisor(rows, 7)[0].select("pos", "s_suppkey")


@query("unpad", _SUPPLIER)
def unpad(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded, extra = batch.pad_to_divisor(batch.with_pos(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey"), 7)
    return batch.unpad(padded, extra).select("pos", "s_suppkey")


def _order(rows: DataFrame, n: int) -> DataFrame:
    return rows.select(F.col("pos").alias("ord"), F.pmod(F.col("pos") * 7 + 3, F.lit(n)).alias("idx"))


@query("reorder", f"WITH n AS ({_NATION}) SELECT o.pos, n.n_name FROM n AS o JOIN n ON n.pos = (o.pos * 7 + 3) % (SELECT count(*) FROM nation)")
def reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nation(spark, sf_dir)
    return batch.gather(rows, _order(rows, table(spark, sf_dir, "nation").count())).select("pos", "n_name")


@query("reorder_inverse", _NATION)
def reorder_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nation(spark, sf_dir)
    order = _order(rows, table(spark, sf_dir, "nation").count())
    return batch.gather(batch.gather(rows, order), batch.inverse(order)).select("pos", "n_nationkey", "n_name")


@query("gather", f"WITH n AS ({_NATION}) SELECT r.i AS pos, n.n_name FROM range(10) r(i) JOIN n ON n.pos = (r.i * r.i) % 5")
def gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = spark.range(10).select(F.col("id").alias("ord"), (F.col("id") * F.col("id") % 5).alias("idx"))
    return batch.gather(_nation(spark, sf_dir), order).select("pos", "n_name")


@query("slice", f"SELECT (pos - 2) // 3 AS pos, n_name FROM ({_NATION}) WHERE pos >= 2 AND pos < (SELECT count(*) FROM nation) - 1 AND (pos - 2) % 3 = 0")
def slice_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.slice_rows(_nation(spark, sf_dir), 2, -1, 3).select("pos", "n_name")


@query("flatten_columns", "SELECT o_orderkey AS \"order/key\", o_custkey AS \"order/customer/key\", o_orderstatus AS status FROM orders")
def flatten_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = table(spark, sf_dir, "orders").select(F.struct(F.col("o_orderkey").alias("key"), F.struct(F.col("o_custkey").alias("key")).alias("customer")).alias("order"), F.col("o_orderstatus").alias("status"))
    return batch.flatten(batch.unflatten(batch.flatten(nested)))
