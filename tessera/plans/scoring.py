"""Queries on boxes and the batch reward."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import rewards
from .registry import query, table

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
# a box from whole-number columns of a line; some are empty, some are written with a space
_BOXES = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 50 AS x1, l_suppkey % 40 AS y1, l_partkey % 50 + l_linenumber * 10 - 10 AS x2, l_suppkey % 40 + 30 AS y2, l_linenumber FROM lineitem"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x1, y1 = F.col("l_partkey") % 50, F.col("l_suppkey") % 40
    return table(spark, sf_dir, "lineitem").select(*KEY, F.array(x1, y1, x1 + F.col("l_linenumber") * 10 - 10, y1 + 30).cast("array<bigint>").alias("b"))


def _written(b):
    return F.concat(F.lit("<box>["), F.array_join(F.transform(b, lambda v: v.cast("string")), ","), F.lit("]</box>"))


@query("box_parse", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(x1 AS BIGINT) AS x1, CAST(y2 AS BIGINT) AS y2, x1 < x2 AND y1 < y2 AS valid FROM ({_BOXES})""")
def box_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir).select(*KEY, text.box(text.tags(_written(F.col("b")), "box")[0]).alias("b"))
    return rows.select(*KEY, F.col("b")[0].alias("x1"), F.col("b")[3].alias("y2"), geometry.is_box(F.col("b")).alias("valid"))


_IOU = """CASE WHEN least({a}.x2, {b}.x2) > greatest({a}.x1, {b}.x1) AND least({a}.y2, {b}.y2) > greatest({a}.y1, {b}.y1)
 THEN CAST((least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * (least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)) AS DOUBLE)
  / CAST(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - (least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * (least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)) AS DOUBLE) ELSE 0.0 END"""


@query("box_iou", f"""
SELECT t.l_orderkey, t.l_linenumber, t.l_partkey, t.l_suppkey, round({_IOU.format(a='t', b='f')}, 4) + 0.0 AS iou FROM ({_BOXES}) t, (SELECT 10 AS x1, 10 AS y1, 40 AS x2, 40 AS y2) f""")
def box_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = F.array(F.lit(10), F.lit(10), F.lit(40), F.lit(40)).cast("array<bigint>")
    return _boxes(spark, sf_dir).select(*KEY, (F.round(geometry.iou(F.col("b"), fixed), 4) + F.lit(0.0)).alias("iou"))


def _per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir)
    return rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "b"))), lambda x: x["b"]).alias("boxes"))


@query("box_valid", f"""
WITH b AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS total FROM ({_BOXES}) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
g AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY i) - 1 AS k FROM b WHERE x1 < x2 AND y1 < y2),
d AS (SELECT DISTINCT p.l_orderkey FROM g p JOIN g q ON p.l_orderkey = q.l_orderkey AND p.k <> q.k AND p.k < p.total // 2 WHERE {_IOU.format(a='p', b='q')} > 0.9),
n AS (SELECT l_orderkey, count(*) AS good FROM g GROUP BY 1)
SELECT t.l_orderkey, CASE WHEN d.l_orderkey IS NOT NULL THEN 0.0 ELSE round(CAST(coalesce(n.good, 0) AS DOUBLE) / t.total, 4) + 0.0 END AS validity, CASE WHEN d.l_orderkey IS NOT NULL THEN 0 ELSE CAST(t.total AS INTEGER) END AS n_boxes
FROM (SELECT DISTINCT l_orderkey, total FROM b) t LEFT JOIN d USING (l_orderkey) LEFT JOIN n USING (l_orderkey)""")
def box_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _per_order(spark, sf_dir).select("l_orderkey", F.array_join(F.transform("boxes", _written), " and ").alias("said"))
    share, n = geometry.box_validity(F.col("said"))
    return rows.select("l_orderkey", (F.round(share, 4) + F.lit(0.0)).alias("validity"), n.alias("n_boxes"))


@query("box_reward", f"""
WITH g AS (SELECT *, row_number() OVER () AS r FROM ({_BOXES}) WHERE x1 < x2 AND y1 < y2), f(j, x1, y1, x2, y2) AS (VALUES (0, 10, 10, 40, 40), (1, 0, 0, 60, 20)),
m AS (SELECT g.*, f.j, {_IOU.format(a='g', b='f')} AS v FROM g, f),
p AS (SELECT l_orderkey, avg(v) AS p FROM (SELECT l_orderkey, r, max(v) AS v FROM m GROUP BY ALL) GROUP BY 1),
r AS (SELECT l_orderkey, avg(v) AS r FROM (SELECT l_orderkey, j, max(v) AS v FROM m GROUP BY 1, 2) GROUP BY 1)
SELECT o.l_orderkey, round(CASE WHEN p.p IS NULL THEN 0.0 ELSE 0.5 * (p.p + r.r) END, 4) + 0.0 AS reward
FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN p USING (l_orderkey) LEFT JOIN r USING (l_orderkey)""")
def box_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _per_order(spark, sf_dir).select("l_orderkey", F.array_join(F.transform("boxes", _written), " and ").alias("said"))
    targets = F.array(F.array(*(F.lit(v) for v in (10, 10, 40, 40))), F.array(*(F.lit(v) for v in (0, 0, 60, 20)))).cast("array<array<bigint>>")
    return rows.select("l_orderkey", (F.round(geometry.box_reward(F.col("said"), targets), 4) + F.lit(0.0)).alias("reward"))


@query("box_rescale", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round_even(CAST(x1 AS DOUBLE) * 0.5::DOUBLE, 0) AS BIGINT) AS x1, CAST(round_even(CAST(y2 AS DOUBLE) * 0.25::DOUBLE, 0) AS BIGINT) AS y2 FROM ({_BOXES})")
def box_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir).select(*KEY, geometry.rescale(F.col("b"), F.lit(0.5), F.lit(0.25)).alias("b"))
    return rows.select(*KEY, F.col("b")[0].alias("x1"), F.col("b")[3].alias("y2"))


@query("resize_dims", """
SELECT p_partkey, CAST(floor(w * f) AS BIGINT) AS width, CAST(floor(h * f) AS BIGINT) AS height, w * h < 5000 OR w * h > 20000 AS moved FROM (
 SELECT p_partkey, w, h, sqrt(CAST(CASE WHEN w * h > 20000 THEN 20000 WHEN w * h < 5000 THEN 5000 ELSE w * h END AS DOUBLE) / (w * h)) AS f
 FROM (SELECT p_partkey, CAST(p_size AS BIGINT) * 7 AS w, CAST(floor(p_retailprice) AS BIGINT) % 200 + 20 AS h FROM part))""")
def resize_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size").cast("long") * 7).alias("w"), (F.floor("p_retailprice").cast("long") % 200 + 20).alias("h"))
    width, height = geometry.resized(F.col("w"), F.col("h"), 5000, 20000)
    return part.select("p_partkey", width.alias("width"), height.alias("height"), geometry.out_of_range(F.col("w"), F.col("h"), 5000, 20000).alias("moved"))


@query("batch_reward", """
WITH r AS (SELECT event_id, user_id, event_type, CASE event_type WHEN 'purchase' THEN 'A' WHEN 'click' THEN 'B' ELSE 'single' END AS grp,
  CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END AS fmt, CASE WHEN event_type = 'error' THEN 0.0 WHEN value < 50 THEN 1.0 ELSE 0.0 END AS acc, CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END AS box FROM events)
SELECT event_id, acc AS accuracy, round(CASE grp WHEN 'A' THEN fmt + box + box + acc WHEN 'B' THEN fmt + acc ELSE fmt + 1.5 * acc END, 4) + 0.0 AS overall,
  CASE WHEN grp = 'B' AND EXISTS (SELECT 1 FROM r a WHERE a.user_id = r.user_id AND a.grp = 'A' AND a.acc = 1 AND a.event_id <= r.event_id) THEN 1 ELSE 0 END AS has_reference
FROM r""")
def batch_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full reward over made-up responses: errors are malformed, small values answer right, purchases bring a box."""
    kind = F.col("event_type")
    answer = F.when(F.col("value") < 50, "yes").otherwise("no")
    box = F.when(kind == "purchase", "<box>[1,1,5,5]</box>").otherwise("")
    said = F.when(kind == "error", "oops").otherwise(F.concat(F.lit("<think>t"), box, F.lit("</think><answer>"), answer, F.lit("</answer>")))
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("original_idx"), F.when(kind == "purchase", "A").when(kind == "click", "B").otherwise("single").alias("group"), said.alias("response"), F.lit("Yes ").alias("ground_truth"),
        F.array(F.array(*(F.lit(v) for v in (1, 1, 5, 5)))).cast("array<array<bigint>>").alias("target_boxes"), F.col("event_id").alias("step"), F.lit(0).cast("long").alias("pos"),
    )
    scored = rewards.score(rows)
    known = (F.col("group") == "B") & F.col("reference").isNotNull()
    return scored.select("event_id", "accuracy", (F.round("overall", 4) + F.lit(0.0)).alias("overall"), known.cast("int").alias("has_reference"))
