"""Every registered query with SQL gives the rows of its SQL; every other one gives rows."""

import pytest
from oracle import connect, rows

import __spark_entry__ as entry
from tessera.plans import catalogue

NAMES = sorted(catalogue.QUERIES)


@pytest.fixture(scope="module")
def sql(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", [n for n in NAMES if n in catalogue.ORACLES])
def test_query_equals_sql(spark, sf_dir, sql, name):
    mine, theirs = catalogue.QUERIES[name](spark, sf_dir).toPandas(), sql.execute(catalogue.ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", [n for n in NAMES if n not in catalogue.ORACLES])
def test_query_gives_rows(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_equals_window(spark, sf_dir):
    from pyspark.sql import functions as F

    q = catalogue.QUERIES
    window = q["running_best"](spark, sf_dir)
    last = window.groupBy("key").agg(F.max_by(F.struct("accuracy", "value", "step"), "event_id").alias("b")).select("key", "b.*")
    assert rows(q["stream_best"](spark, sf_dir).toPandas()) == rows(last.toPandas())


def test_micro_batches_keep_all_rows(spark, sf_dir):
    from tessera.plans.registry import table

    out = catalogue.QUERIES["micro_batches"](spark, sf_dir)
    assert sorted(r.pos for r in out.select("pos").collect()) == sorted(r[0] for r in table(spark, sf_dir, "documents").select("doc_id").collect())
