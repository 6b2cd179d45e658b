import statistics

import pytest
from pyspark.sql import functions as F

from echoloom.operators.core import folded, most_frequent
from echoloom.operators.rank import medians
from echoloom.sources.settled import stored


@pytest.mark.parametrize("values", [[], [None], [3.0], [1.0, None, 4.0], [5.0, 1.0, 1.0, 9.0, 1.0], [float(i * 7919 % 101) for i in range(100)]])
def test_medians(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known = [v for v in values if v is not None]
    got = medians(df, one=F.col("v"), twice=F.col("v") * 2)
    assert got == {"one": statistics.median(known) if known else None, "twice": statistics.median(known) * 2 if known else None}


def test_most_frequent(spark):
    df = spark.createDataFrame([("a", "x", 2), ("a", "w", 2), ("a", None, 9), ("b", None, 1)], "k string, v string, n long")
    assert {r["k"]: r["m"] for r in df.groupBy("k").agg(most_frequent("v", "n").alias("m")).collect()} == {"a": "w", "b": None}


def test_folded(spark):
    df = spark.createDataFrame([(1, "Ａ B"), (2, None), (3, "Ａ B"), (4, "")], "i int, t string")
    got = folded(df, F.col("t"), "f")
    assert got.columns == ["i", "t", "f"] and got.count() == 4
    texts = {r["i"]: r["f"] for r in got.collect()}
    assert texts[1] == texts[3] and texts[1] is not None


def test_stored_tables_follow_their_sources(spark, tmp_path):
    source = str(tmp_path / "tables")
    write = lambda n: spark.range(n).write.mode("overwrite").parquet(f"{source}/t.parquet")
    build = lambda: spark.read.parquet(f"{source}/t.parquet")
    write(3)
    first = stored(spark, source, "t", build)
    assert first.count() == 3 and stored(spark, source, "t", build).inputFiles() == first.inputFiles()
    write(5)
    assert stored(spark, source, "t", build).count() == 5
