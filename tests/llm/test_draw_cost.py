"""What a draw costs: a text is split once, and what cannot win goes by one comparison, whatever the columns."""

from pyspark.sql import functions as F

from echoloom.llm.fingerprint import candidates, weighted_words


def test_split_once_and_one_bound(spark):
    df = spark.createDataFrame([(1, "a b b c", "a b d"), (2, "", None)], "row int, text string, edited string")
    prints = {"weight": "fingerprint", "edited_weight": "edited_fingerprint"}
    words = weighted_words(df, {"text": "weight", "edited": "edited_weight"}, ["row"])
    plan = words._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    rows = candidates(words, ["row"], prints, 8)
    filters = [x for x in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x and "task" in x]
    assert len(filters) == 2 and filters[1].count("<=") == 1
    limits = {r["row"]: r for r in words.groupBy("row").agg(F.max("weight_limit").alias("a"), F.max("edited_weight_limit").alias("b")).collect()}
    assert (limits[1]["a"], limits[1]["b"], limits[2]["a"], limits[2]["b"]) == (10.0, 40 / 3, None, None)
