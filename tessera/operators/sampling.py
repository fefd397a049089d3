"""Samplers and batches. The order of a seed is that of md5(seed:key), the same in any partitioning and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ticket(seed: int, *key: str | Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key)))


BUCKET_ROWS = 50_000


def ranked(df: DataFrame, draw: Column, key: str, name: str, rows: int, group: list[str] | None = None) -> DataFrame:
    """Row numbers from 0 in the order of (draw, key), for each group or over all; rows: about how many a group has.

    Draws are hexadecimal digests, so their first digits cut many rows into even buckets: rows are numbered inside buckets,
    and a running count over the buckets gives their starts.
    """
    digits, keys = 0, list(group or [])
    while rows / 16**digits > BUCKET_ROWS:
        digits += 1
    drawn = df.withColumn("_draw", draw)
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    if not digits:
        return drawn.withColumn(name, F.row_number().over(whole.orderBy("_draw", key)).cast("long") - 1).drop("_draw")
    drawn = drawn.withColumn("_bucket", F.substring("_draw", 1, digits))
    sizes = drawn.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    starts = sizes.select(*keys, "_bucket", (F.sum("_n").over(whole.orderBy("_bucket")) - F.col("_n")).alias("_start"))
    own = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("_draw", key))
    return drawn.join(starts, [*keys, "_bucket"]).withColumn(name, F.col("_start") + own - 1).drop("_draw", "_bucket", "_start")


def shuffled(df: DataFrame, key: str, seed: int, name: str = "pos") -> DataFrame:
    return ranked(df, ticket(seed, key), key, name, df.count())


def paired(df: DataFrame, pair: str, member: str, seed: int, size: int = 2) -> DataFrame:
    """Pairs in the order of the seed, the members of each side by side: column pos. Only the pair keys are ordered as a whole."""
    pairs = shuffled(df.select(pair).distinct(), pair, seed, "_pair")
    own = F.row_number().over(Window.partitionBy(pair).orderBy(member)) - 1
    return df.join(pairs, pair).withColumn("pos", F.col("_pair") * size + own).drop("_pair")


def mixed(pairs: DataFrame, singles: DataFrame, key: str, seed: int, batch: int, ratio: float) -> DataFrame:
    """(batch_id, slot, key, kind, member): whole pairs up to the ratio of each batch, single rows for the rest.

    Left-over pairs are dropped; single rows come again in a new order for each pass. pairs(key) and singles(key) have a row
    for each key.
    """
    per_batch = int(batch * ratio) // 2
    if per_batch < 1:
        raise ValueError("no room for a pair in a batch")
    rest = batch - 2 * per_batch
    n_batches, n_single = pairs.count() // per_batch, singles.count()
    ordered = shuffled(pairs, key, seed, "_n").where(F.col("_n") < n_batches * per_batch)
    first = ordered.select((F.col("_n") / per_batch).cast("long").alias("batch_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("member"), "_n", key)
    first = first.select("batch_id", (F.pmod("_n", F.lit(per_batch)) * 2 + F.col("member")).cast("long").alias("slot"), key, F.lit("pair").alias("kind"), "member")
    if not n_single or not rest:
        return first
    passes = -(-n_batches * rest // n_single) or 1
    again = singles.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    turns = ranked(again, ticket(seed, F.col("_pass"), F.col(key)), key, "_turn", n_single, ["_pass"])
    slots = turns.withColumn("_slot", F.col("_pass") * n_single + F.col("_turn")).where(F.col("_slot") < n_batches * rest)
    second = slots.select((F.col("_slot") / rest).cast("long").alias("batch_id"), (F.lit(2 * per_batch) + F.pmod("_slot", F.lit(rest))).cast("long").alias("slot"), key, F.lit("single").alias("kind"), F.lit(0).alias("member"))
    return first.unionByName(second)


def batches(df: DataFrame, size: int, drop_last: bool, rows: int | None = None) -> DataFrame:
    """Column batch_id by pos; size -1: one batch. drop_last leaves out an incomplete one."""
    rows = df.count() if rows is None else rows
    size = max(rows, 1) if size == -1 else size
    out = df.withColumn("batch_id", F.floor(F.col("pos") / size))
    return out.where(F.col("pos") < rows // size * size) if drop_last else out


def epochs(df: DataFrame, size: int, n: int, seed: int, key: str, rows: int | None = None) -> DataFrame:
    """Mini-batches of n passes, each in an order of its own: epoch, batch_id, pos."""
    rows = df.count() if rows is None else rows
    if rows % size:
        raise ValueError(f"{rows} rows in batches of {size}")
    each = df.drop("pos").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return ranked(each, ticket(seed, F.col("epoch"), F.col(key)), key, "pos", rows, ["epoch"]).withColumn("batch_id", F.floor(F.col("pos") / size))


def sample(df: DataFrame, keys: list[str], row: str, n: int, seed: int) -> DataFrame:
    """n rows of each key, all if there are fewer."""
    w = Window.partitionBy(*keys).orderBy(ticket(seed, row), row)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def sample_all(df: DataFrame, row: str, n: int, seed: int) -> DataFrame:
    """n rows of all; none for n <= 0."""
    return df.orderBy(ticket(seed, row), row).limit(max(n, 0))


def accumulate(df: DataFrame, batch: str, uid: str, kept: Column, goal: int, tries: int = 0) -> DataFrame:
    """Kept rows of the first batches that together hold goal kept uids, cut to the first goal uids; at most tries batches if that is positive."""
    alive = df.where(kept).where(F.col(batch) < tries) if tries > 0 else df.where(kept)
    uids = alive.groupBy(batch, uid).agg(F.lit(1).alias("_one"))
    sizes = uids.groupBy(batch).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy(batch)) - F.col("_n")).where(F.col("_before") < goal)
    place = F.row_number().over(Window.partitionBy(batch).orderBy(uid))
    chosen = uids.join(before, batch).withColumn("_place", F.col("_before") + place).where(F.col("_place") <= goal).select(batch, uid)
    return alive.join(chosen, [batch, uid], "left_semi")
