"""Streams with timers: batches cut anywhere give the same alerts, and state goes with its timer."""

import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from echoloom.streaming.lifecycle import PROVIDER, revivals, stale_items

CONF = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(CONF)
    spark.conf.set(CONF, PROVIDER)
    yield spark
    spark.conf.set(CONF, before)


def feed(spark, batches, schema, make, place):
    """All rows that ``make`` gives, a run over each batch in turn from one checkpoint."""
    types = schema.replace("t string", "t timestamp")
    for rows in batches:
        spark.createDataFrame(rows, schema).withColumn("t", F.col("t").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{place}/in")
        out = make(spark.readStream.schema(types).parquet(f"{place}/in"))
        out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination(120)
    return sorted(tuple(r) for r in spark.read.schema(out.schema).parquet(f"{place}/out").collect())


ITEMS = [
    ("a", "2024-01-01", "open"), ("b", "2024-01-02", "open"), ("c", "2024-01-03", "done"), ("e", "2024-01-04", None),
    ("b", "2024-02-20", "open"), ("a", "2024-03-20", "open"), ("b", "2024-04-01", "done"), ("d", None, "open"), ("z", "2025-01-01", "other"),
]


@pytest.mark.parametrize("cuts", [(9,), (4, 9), (1, 2, 3, 5, 6, 9)])
def test_stale_items(rocks, tmp_path, cuts):
    """Each pause of an open item once; the last one of ``a`` is told though no further row of ``a`` comes."""
    batches = [ITEMS[a:b] for a, b in zip((0, *cuts), cuts)]
    got = feed(rocks, batches, "k string, t string, s string", lambda s: stale_items(s, "k", "t", "s", ("open",), late="0 seconds"), tmp_path)
    assert [(k, s, u) for k, s, u, _ in got] == [("a", "open", datetime(2024, 1, 1)), ("a", "open", datetime(2024, 3, 20))]
    assert got[0][3] == datetime(2024, 2, 26)


def test_stale_by_the_wall_clock(rocks, tmp_path):
    """No row comes after the first batch: the timer alone tells."""
    rocks.createDataFrame([("a", "2024-01-01", "open"), ("b", "2024-01-01", "done")], "k string, t string, s string").withColumn("t", F.col("t").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    stream = rocks.readStream.schema("k string, t timestamp, s string").parquet(f"{tmp_path}/in")
    q = stale_items(stream, "k", "t", "s", ("open",), clock="processingtime").writeStream.format("memory").queryName("wall").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
    try:
        end = time.time() + 60
        while time.time() < end and not rocks.table("wall").count():
            time.sleep(0.5)
        assert [(r["k"], r["status"]) for r in rocks.table("wall").collect()] == [("a", "open")]
    finally:
        q.stop()


def test_revivals(rocks, tmp_path):
    rows = [
        ("a", "2024-01-01", "evidence", 2), ("a", "2024-01-02", "dismissed", None), ("a", "2024-01-03", "evidence", 3), ("b", "2024-01-03", "evidence", 9), ("a", "2024-01-04", "evidence", 1),
        ("a", "2024-01-05", "evidence", 50), ("a", "2024-01-06", "refused", None), ("a", "2024-01-07", "evidence", 111), ("a", "2024-01-08", "evidence", 1), ("y", "2024-01-09", "evidence", 1), ("z", "2027-01-01", "evidence", 1),
    ]
    start = rocks.createDataFrame([("y", 5, 2, True, "2024-01-01")], "k string, total long, base long, dismissed boolean, t string")
    make = lambda s: revivals(s, "k", "t", "kind", "n", initial=start, late="0 seconds")
    got = feed(rocks, [rows[:3], rows[3:7], rows[7:10], rows[10:]], "k string, t string, kind string, n long", make, tmp_path)
    assert [x[:4] for x in got] == [("a", "archived", 168, 56), ("a", "revive", 6, 2), ("a", "revive", 168, 56), ("y", "archived", 6, 2), ("y", "revive", 6, 2)]


def test_provider_is_checked(spark):
    stream = spark.readStream.format("rate").load().selectExpr("value AS k", "timestamp AS t", "'x' AS s")
    before = spark.conf.get(CONF)
    spark.conf.set(CONF, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    with pytest.raises(RuntimeError, match="RocksDB"):
        stale_items(stream, "k", "t", "s", ("x",))
    spark.conf.set(CONF, before)
