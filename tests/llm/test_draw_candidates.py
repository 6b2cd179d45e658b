"""How many terms reach the minimum of a draw, where words are said several times."""

from pyspark.sql import functions as F

from echoloom.llm.fingerprint import MISSED, candidates, weighted_words


def test_few_candidates_of_repeated_words(spark):
    df = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(400) for _ in range(k))) for k in (1, 2, 3)], "row int, text string")
    words = weighted_words(df, {"text": "weight"}, ["row"])
    rows = candidates(words, ["row"], {"weight": "fingerprint"}, 64).where(F.col("a0").isNotNull())
    for r in rows.groupBy("row").count().collect():
        assert 0.9 * MISSED < r["count"] / 64 < 1.1 * MISSED
