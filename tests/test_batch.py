"""Golden values and properties of the batch algebra."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import batch


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, i + 1, c) for i, c in enumerate("abcdef")], "pos long, obs long, labels string")


def obs(df):
    return [r.obs for r in df.orderBy("pos").collect()]


def labels(df):
    return [r.labels for r in df.orderBy("pos").collect()]


def test_slice_and_gather(spark, rows):
    part = batch.slice_rows(rows, 1, 3)
    assert (obs(part), labels(part)) == ([2, 3], ["b", "c"])
    picked = batch.gather(rows, spark.createDataFrame([(0, 0), (1, 2), (2, 2)], "ord long, idx long"))
    assert obs(picked) == [1, 3, 3]
    for args in ((None, None, 2), (-3, None, 1), (4, 1, -1), (None, None, -2), (5, 2, 1), (0, 100, 4)):
        assert obs(batch.slice_rows(rows, *args)) == [1, 2, 3, 4, 5, 6][slice(*args)]


def test_chunk_split_concat(rows):
    first = rows.where(batch.chunk_id(6, 2) == 0)
    assert obs(first) == [1, 2, 3]
    with pytest.raises(ValueError):
        batch.chunk_id(6, 5)
    second = rows.where(batch.chunk_id(6, 2) == 1).withColumn("pos", F.col("pos") - 3)
    assert obs(batch.concat([first, second])) == [1, 2, 3, 4, 5, 6]
    assert obs(rows.where(batch.split_id(2) == 0)) == [1, 2]


def test_reorder_and_inverse(spark, rows):
    order = spark.createDataFrame(list(enumerate([3, 4, 2, 0, 1, 5])), "ord long, idx long")
    moved = batch.gather(rows, order)
    assert (obs(moved), labels(moved)) == ([4, 5, 3, 1, 2, 6], ["d", "e", "c", "a", "b", "f"])
    assert obs(batch.gather(moved, batch.inverse(order))) == [1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize("interleave,expected", [(True, [1, 1, 2, 2]), (False, [1, 2, 1, 2])])
def test_repeat(rows, interleave, expected):
    assert obs(batch.repeat(rows.where("pos < 2"), 2, interleave)) == expected


@pytest.mark.parametrize("divisor,extra,expected", [(2, 1, [1, 2, 3, 1]), (3, 0, [1, 2, 3]), (8, 5, [1, 2, 3, 1, 2, 3, 1, 2])])
def test_pad(rows, divisor, extra, expected):
    padded, n = batch.pad_to_divisor(rows.where("pos < 3"), divisor)
    assert (obs(padded), n) == (expected, extra)
    assert obs(batch.unpad(padded, n)) == [1, 2, 3]


def test_union(rows):
    a, b = rows.select("pos", "obs", "labels"), rows.select("pos", "obs", (F.col("obs") * 2).alias("rew"))
    assert batch.union_columns(a, b).columns == ["pos", "obs", "labels", "rew"]
    with pytest.raises(ValueError):
        batch.union_columns(a, b.withColumn("obs", F.col("obs") + 1))
    with pytest.raises(ValueError):
        batch.union_columns(a, b.where("pos > 0"))


def test_select_pop_rename(rows):
    assert batch.select(rows, ["obs", "missing"]).columns == ["pos", "obs"]
    popped, rest = batch.pop(rows, ["obs"])
    assert (popped.columns, rest.columns) == (["pos", "obs"], ["pos", "labels"])
    assert batch.rename(rows, "obs", "seen").columns == ["pos", "seen", "labels"]
    with pytest.raises(ValueError):
        batch.rename(rows, ["obs", "labels"], ["x"])


@pytest.mark.parametrize("parts", [1, 8])
@pytest.mark.parametrize("bucket", [10, 50_000])
def test_with_pos(spark, monkeypatch, parts, bucket):
    monkeypatch.setattr(batch, "BUCKET_ROWS", bucket)
    df = spark.range(100).select((F.col("id") * 37 % 101 * 5).alias("k")).repartition(parts)
    out = batch.with_pos(df, "k").orderBy("pos").collect()
    assert [r.pos for r in out] == list(range(100))
    assert [r.k for r in out] == sorted(r.k for r in out)
    assert batch.with_pos(df.where("false"), "k").count() == 0


def test_flatten_unflatten(spark):
    df = spark.createDataFrame([(1, (2, (3,)))], "a long, b struct<c:long,d:struct<e:long>>")
    flat = batch.flatten(df)
    assert flat.columns == ["a", "b/c", "b/d/e"]
    assert batch.unflatten(flat).first().asDict(True) == {"a": 1, "b": {"c": 2, "d": {"e": 3}}}


def test_check_lengths(spark):
    good = spark.createDataFrame([([1, 2], [3, 4])], "a array<long>, b array<long>")
    assert batch.check_lengths(good, "a", "b").count() == 1
    with pytest.raises(Exception):
        batch.check_lengths(good.withColumn("b", F.array(F.lit(1))), "a", "b").collect()
