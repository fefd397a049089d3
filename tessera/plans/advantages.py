"""Queries on advantages, token scans and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays
from ..operators import groups, scans
from .registry import query, table

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders with several lines; the score is the price in cents."""
    rows = table(spark, sf_dir, "lineitem").select(*KEY, F.round(F.col("l_extendedprice") * 100).cast("long").alias("score"))
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey"))).where("n > 1").drop("n")


_SCORES = """WITH s AS (
  SELECT *, count(*) OVER w AS n, sum(score) OVER w AS s1, sum(score * score) OVER w AS s2 FROM (
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS score FROM lineitem)
  WINDOW w AS (PARTITION BY l_orderkey))
"""


def _round(c, digits: int = 4):
    return F.round(c, digits) + F.lit(0.0)


@query("grpo_advantage", _SCORES + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       round((CAST(score AS DOUBLE) - CAST(s1 AS DOUBLE) / n) / (sqrt(CAST(n * s2 - s1 * s1 AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE)) + 1e-6), 4) + 0.0 AS advantage
FROM s WHERE n > 1""")  # fmt: skip
def grpo_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.grpo(_scores(spark, sf_dir), "l_orderkey", "score").select(*KEY, _round(F.col("advantage")).alias("advantage"))


@query("rloo_advantage", _SCORES + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CAST(score AS DOUBLE) - CAST(s1 - score AS DOUBLE) / CAST(n - 1 AS DOUBLE), 4) + 0.0 AS advantage
FROM s WHERE n > 1""")  # fmt: skip
def rloo_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.rloo(_scores(spark, sf_dir), "l_orderkey", "score").select(*KEY, _round(F.col("advantage")).alias("advantage"))


@query("remax_advantage", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CAST(round(l_extendedprice * 100) AS BIGINT) - CAST(round(p_retailprice * 100) AS BIGINT) AS advantage
FROM lineitem JOIN part ON l_partkey = p_partkey""")  # fmt: skip
def remax_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.round(F.col("p_retailprice") * 100).cast("long").alias("baseline"))
    lines = table(spark, sf_dir, "lineitem").select(*KEY, F.round(F.col("l_extendedprice") * 100).cast("long").alias("score"))
    return groups.remax(lines.join(part, "l_partkey"), "score", "baseline").select(*KEY, "advantage")


def _ints(scale: int = 10_000):
    """An embedding as whole numbers, so that sums are exact in any order."""
    return F.transform("embedding", lambda x: F.round(x.cast("double") * scale).cast("long"))


_INTS = "list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 10000) AS BIGINT))"


@query("segment_grpo", f"""
WITH e AS (SELECT vec_id, label, (vec_id % 67) - 1 AS cut, CAST(list_sum(v[1:32]) AS BIGINT) AS a, CAST(list_sum(v[33:64]) AS BIGINT) AS b
           FROM (SELECT vec_id, label, {_INTS} AS v FROM embeddings)),
g AS (SELECT *, count(*) OVER w AS n, sum(a) OVER w AS a1, sum(a * a) OVER w AS a2, sum(b) OVER w AS b1, sum(b * b) OVER w AS b2 FROM e WINDOW w AS (PARTITION BY label)),
z AS (SELECT vec_id, CASE WHEN cut < 0 OR cut > 64 THEN 32 ELSE cut END AS cut,
        CASE WHEN n > 1 THEN (CAST(a AS DOUBLE) - CAST(a1 AS DOUBLE) / n) / (sqrt(CAST(n * a2 - a1 * a1 AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE)) + 1e-6) ELSE 0.0 END AS x,
        CASE WHEN n > 1 THEN (CAST(b AS DOUBLE) - CAST(b1 AS DOUBLE) / n) / (sqrt(CAST(n * b2 - b1 * b1 AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE)) + 1e-6) ELSE 0.0 END AS y FROM g)
SELECT vec_id, CAST(t AS INTEGER) AS t, round((CASE WHEN t < cut THEN x ELSE y END) * (CASE WHEN t <= vec_id % 64 THEN 1 ELSE 0 END), 4) + 0.0 AS advantage
FROM z, range(64) r(t)""")  # fmt: skip
def segment_grpo(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = lambda at: F.aggregate(F.slice("v", at, 32), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", _ints().alias("v"))
    rows = rows.select("vec_id", "label", half(1).alias("a"), half(33).alias("b"), (F.col("vec_id") % 67 - 1).alias("cut"), _mask())
    out = groups.segment_grpo(rows, "label", "a", "b", "cut", "mask")
    return out.select("vec_id", F.posexplode("advantages").alias("t", "a")).select("vec_id", "t", _round(F.col("a")).alias("advantage"))


def _mask():
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i <= F.col("vec_id") % 64).cast("int")).alias("mask")


_TOKENS = "(SELECT vec_id, t, CAST(embedding[t + 1] AS DOUBLE) AS x FROM embeddings, range(64) r(t))"


@query("gae", f"""
WITH x AS (SELECT vec_id, t, x, x / 2 AS v, coalesce(lead(x / 2) OVER (PARTITION BY vec_id ORDER BY t), 0) AS v1 FROM {_TOKENS}),
d AS (SELECT vec_id, t, v, x + 0.99 * v1 - v AS delta FROM x)
SELECT a.vec_id, CAST(a.t AS INTEGER) AS t, round(sum(power(0.99 * 0.95, b.t - a.t) * b.delta), 4) + 0.0 AS advantage,
       round(sum(power(0.99 * 0.95, b.t - a.t) * b.delta) + any_value(a.v), 4) + 0.0 AS returns
FROM d a JOIN d b ON a.vec_id = b.vec_id AND b.t >= a.t GROUP BY a.vec_id, a.t""")  # fmt: skip
def gae(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", scans.gae(x, F.transform(x, lambda v: v / 2), 0.99, 0.95).alias("s"))
    both = rows.select("vec_id", F.posexplode(F.arrays_zip("s.advantages", "s.returns")).alias("t", "z"))
    return both.select("vec_id", "t", _round(F.col("z.advantages")).alias("advantage"), _round(F.col("z.returns")).alias("returns"))


@query("reinforce_pp", f"""
SELECT a.vec_id, CAST(a.t AS INTEGER) AS t, round(sum(power(0.9, b.t - a.t) * b.x * CASE WHEN b.t = a.t OR b.t <= a.vec_id % 64 THEN 1 ELSE 0 END), 4) + 0.0 AS returns
FROM {_TOKENS} a JOIN {_TOKENS} b ON a.vec_id = b.vec_id AND b.t >= a.t GROUP BY a.vec_id, a.t""")  # fmt: skip
def reinforce_pp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards stand behind the mask too, so that the cut at the mask is seen."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"), _mask())
    run = rows.select("vec_id", F.posexplode(scans.discounted(F.col("x"), F.col("mask").cast("array<double>"), 0.9)).alias("t", "r"))
    return run.select("vec_id", "t", _round(F.col("r")).alias("returns"))


_MOMENTS = f"""WITH x AS (SELECT vec_id, t, CAST(round(x * 10000) AS BIGINT) AS v, t <= vec_id % 64 AS m FROM {_TOKENS}),
s AS (SELECT CAST(count(*) FILTER (m) AS DOUBLE) AS n, CAST(sum(v) FILTER (m) AS DOUBLE) AS s1, CAST(sum(v * v) FILTER (m) AS DOUBLE) AS s2 FROM x),
q AS (SELECT n, s1 / (n + 1e-8) AS mean, (s2 - 2 * (s1 / (n + 1e-8)) * s1 + (s1 / (n + 1e-8)) * (s1 / (n + 1e-8)) * n) / (n + 1e-8) * n / (n - 1) AS var FROM s)
"""


@query("masked_whiten", _MOMENTS + "SELECT vec_id, CAST(t AS INTEGER) AS t, round((v - mean) / sqrt(var + 1e-8), 4) + 0.0 AS whitened FROM x, q")
def masked_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", _ints().alias("v"), _mask())
    return scans.whiten(rows, "v", "mask").select("vec_id", F.posexplode("whitened").alias("t", "w")).select("vec_id", "t", _round(F.col("w")).alias("whitened"))


@query("masked_stats", f"""
SELECT vec_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(v) AS BIGINT) AS total, round(CAST(sum(v) AS DOUBLE) / (count(*) + 1e-8), 4) + 0.0 AS mean
FROM (SELECT vec_id, t, CAST(round(x * 10000) AS BIGINT) AS v FROM {_TOKENS}) WHERE t <= vec_id % 64 GROUP BY vec_id""")
def masked_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", _ints().alias("v"), _mask())
    both = arrays.times(F.col("v"), F.col("mask"))
    return rows.select("vec_id", arrays.total(F.col("mask")).alias("n"), arrays.total(both).alias("total"), _round(arrays.masked_mean(F.col("v"), F.col("mask"))).alias("mean"))


_EVENTS = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place FROM events"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


def _of_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


_IDS = f"(SELECT vec_id, t, CAST(round(x * 10000) AS BIGINT) % 7 AS id FROM {_TOKENS})"  # id 0 ends a response


def _ids():
    return F.transform(_ints(), lambda v: v % 7).alias("ids")


@query("response_mask", f"""
WITH x AS {_IDS}, f AS (SELECT vec_id, min(t) FILTER (id = 0) AS first FROM x GROUP BY vec_id)
SELECT vec_id, CAST(t AS INTEGER) AS t, CASE WHEN first IS NULL OR t <= first THEN 1 ELSE 0 END AS mask FROM x JOIN f USING (vec_id)""")
def response_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", _ids())
    return rows.select("vec_id", F.posexplode(arrays.response_mask(F.col("ids"), [0])).alias("t", "mask"))


@query("position_ids", f"""
SELECT vec_id, CAST(t AS INTEGER) AS t, CAST(greatest(sum(CASE WHEN id <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY t) - 1, 0) AS BIGINT) AS position FROM {_IDS}""")
def position_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", _ids()).withColumn("mask", F.transform("ids", lambda i: (i != 0).cast("int")))
    return rows.select("vec_id", F.posexplode(arrays.position_ids(F.col("mask"))).alias("t", "position"))


@query("response_positions", "SELECT vec_id, CAST(t AS INTEGER) AS t, CAST(vec_id % 9 + t + 1 AS BIGINT) AS position FROM embeddings, range(5) r(t)")
def response_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = F.sequence(F.lit(0).cast("long"), F.col("vec_id") % 9)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(arrays.response_positions(prompt, 5)).alias("t", "position"))


@query("prompt_response_parts", f"""
SELECT vec_id, CAST(sum(id) FILTER (t < 44) AS BIGINT) AS prompt_sum, CAST(sum(id) FILTER (t >= 44) AS BIGINT) AS response_sum FROM {_IDS} GROUP BY vec_id""")
def prompt_response_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", _ids())
    return rows.select("vec_id", arrays.total(arrays.prompt_part(F.col("ids"), 20)).alias("prompt_sum"), arrays.total(arrays.response_part(F.col("ids"), 20)).alias("response_sum"))


@query("token_reward", """
SELECT vec_id, CAST(t AS INTEGER) AS t, CASE WHEN t = (vec_id % 65 + 63) % 64 THEN CAST(label AS DOUBLE) ELSE 0.0 END AS reward FROM embeddings, range(64) r(t)""")
def token_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = arrays.place_score(F.size("embedding"), F.col("vec_id") % 65, F.col("label").cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(placed).alias("t", "reward"))


@query("segment_bounds", f"""
WITH e AS ({_EVENTS}), s AS (SELECT user_id, place FROM e WHERE event_type = 'signup'), n AS (SELECT user_id, count(*) AS n FROM e GROUP BY user_id),
l AS (SELECT s.user_id, s.place AS start, coalesce(lead(s.place) OVER (PARTITION BY s.user_id ORDER BY s.place), n.n) - s.place AS length FROM s JOIN n USING (user_id))
SELECT user_id, start, length, max(length) OVER (PARTITION BY user_id) AS longest FROM l""")  # fmt: skip
def segment_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("user_id")
    rows = _events(spark, sf_dir).withColumn("place", F.row_number().over(_of_user()).cast("long") - 1).withColumn("n", F.count("*").over(own))
    starts = rows.where("event_type = 'signup'")
    length = F.coalesce(F.lead("place").over(own.orderBy("place")), F.col("n")) - F.col("place")
    return starts.select("user_id", F.col("place").alias("start"), length.alias("length")).withColumn("longest", F.max("length").over(own))


@query("roll_labels", f"SELECT vec_id, CAST((t + 63) % 64 AS INTEGER) AS t, id AS label FROM {_IDS}")
def roll_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", _ids())
    return rows.select("vec_id", F.posexplode(arrays.roll_left(F.col("ids"))).alias("t", "label"))


def _rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", F.col("user_id").alias("key"), (F.col("event_type") == "purchase").cast("double").alias("accuracy"), "value", F.col("event_id").alias("step"))


@query("running_best", """
WITH r AS (SELECT event_id, user_id AS key, CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS accuracy, value FROM events),
b AS (SELECT a.event_id, a.key, b.accuracy, b.value, b.event_id AS step,
        row_number() OVER (PARTITION BY a.event_id ORDER BY b.accuracy DESC, b.value DESC, b.event_id) AS place
      FROM r a JOIN r b ON a.key = b.key AND b.event_id <= a.event_id)
SELECT event_id, key, accuracy, value, step FROM b WHERE place = 1""")  # fmt: skip
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = groups.running_best(_rollouts(spark, sf_dir), "key", "accuracy", "value", "step")
    return out.select("event_id", "key", F.col("best.accuracy").alias("accuracy"), F.col("best.value").alias("value"), (-F.col("best.negative_step")).alias("step"))


@query("best_reference_join", """
WITH a AS (SELECT user_id AS key, event_id AS step, value FROM events WHERE event_type = 'purchase'),
b AS (SELECT b.event_id, b.user_id AS key, a.value, a.step, row_number() OVER (PARTITION BY b.event_id ORDER BY a.value DESC NULLS LAST, a.step) AS place
      FROM events b LEFT JOIN a ON a.key = b.user_id AND a.step <= b.event_id WHERE b.event_type <> 'purchase')
SELECT event_id, key, value AS reference_value, step AS reference_step FROM b WHERE place = 1""")  # fmt: skip
def best_reference_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.col("accuracy") == 1
    out = groups.running_best(_rollouts(spark, sf_dir), "key", "accuracy", "value", "step", known).where("accuracy = 0")
    return out.select("event_id", "key", F.col("best.value").alias("reference_value"), (-F.col("best.negative_step")).alias("reference_step"))


@query("online_filter", """
WITH j AS (SELECT doc_id, source, quality FROM labels JOIN documents USING (doc_id)), g AS (SELECT *, avg(quality) OVER (PARTITION BY source) AS m FROM j)
SELECT doc_id, source, quality FROM g WHERE m > 0.7 AND m < 0.95""")  # fmt: skip
def online_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return groups.online_filter(rows, "source", "quality", 0.7, 0.95).select("doc_id", "source", "quality")


@query("group_imputation", """
WITH r AS (SELECT *, l_linenumber % 2 AS boxes, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS acc, CAST(round(l_quantity) AS BIGINT) AS iou, CAST(round(l_discount * 100) AS BIGINT) AS valid FROM lineitem),
g AS (SELECT *, count(*) FILTER (boxes > 0) OVER w AS nb, count(*) OVER w AS n, CAST(sum(iou) FILTER (boxes > 0) OVER w AS DOUBLE) AS si, CAST(sum(valid) FILTER (boxes > 0) OVER w AS DOUBLE) AS sv FROM r WINDOW w AS (PARTITION BY l_orderkey))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       round(CASE WHEN boxes = 0 AND nb > 0 THEN 1.5 * acc + 1 + acc * (si / nb) + acc * (sv / nb) ELSE l_tax END, 4) + 0.0 AS overall FROM g""")  # fmt: skip
def group_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(*KEY, "l_returnflag", "l_quantity", "l_discount", "l_tax")
    acc = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)
    out = groups.imputed(rows, "l_orderkey", F.col("l_linenumber") % 2, F.lit(1.0), acc, F.round("l_quantity").cast("long"), F.round(F.col("l_discount") * 100).cast("long"), F.col("l_tax"))
    return out.select(*KEY, _round(F.col("overall")).alias("overall"))


@query("stream_best", """
WITH r AS (SELECT user_id AS key, CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS accuracy, value, event_id AS step FROM events WHERE value IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY accuracy DESC, value DESC, step) AS place FROM r)
SELECT key, accuracy, value, step FROM b WHERE place = 1""")
def stream_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming form of running_best: the state after all events, which is its last row of each key."""
    import uuid

    from ..streaming import state
    from .shared import shared_dir

    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    rollouts = stream.select(F.col("user_id").alias("key"), (F.col("event_type") == "purchase").cast("double").alias("accuracy"), "value", F.col("event_id").alias("step"))
    place = f"{shared_dir(spark)}/tessera-stream-{uuid.uuid4().hex}"
    sink = f"{place}/out"

    def keep(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(sink)

    state.best_stream(rollouts).writeStream.outputMode("update").option("checkpointLocation", f"{place}/check").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    out = spark.read.schema("key long, accuracy double, value double, step long, batch int").parquet(sink)
    return groups.first_rows(out.withColumn("_late", -F.col("batch")), ["key"], ["_late"]).select("key", "accuracy", "value", "step")
