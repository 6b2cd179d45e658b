"""Kept slots are filtered in their row: no slot meets the slots of other rows, however many copies a text has."""

from pyspark.sql import functions as F

from echoloom.llm.common import settle
from echoloom.llm.toxicity import only


def test_only_kept_slots(spark):
    rows = spark.createDataFrame([(i, [7, 3, i + 100, 5]) for i in range(50)] + [(50, []), (51, [1048575, 0])], "row long, slots array<int>")
    for kept, want in (([3, 7, 120, 1048575], {20: [7, 3, 120], 51: [1048575]}), ([], {})):
        table = settle(spark.createDataFrame([(k,) for k in kept], "slot int"), "kept-test")
        got = rows.select("row", only(F.col("slots"), table).alias("slots"))
        assert "Join" not in got._jdf.queryExecution().toString()
        assert {r["row"]: r["slots"] for r in got.collect()} == {i: want.get(i, [7, 3] if kept and i < 50 else []) for i in range(52)}
