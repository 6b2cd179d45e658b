"""The fitted intent classifier: by hand, on held-out labels, and on languages without cue words."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from echoloom.operators import intent_model as N
from echoloom.operators.manage import intent_gate
from echoloom.sources.fixtures import read

ROWS = [
    ("gap", "Gibt es eine Version für die A7M4?"), ("gap", "Wird es eine Halterung geben?"), ("gap", "Có thể làm loại kẹp lớn không?"), ("gap", "Có loại cả điện thoại không?"), ("gap", "能不能出个黑色的"), ("gap", "什么时候能出白色款"),
    ("praise", "Sehr gut, ich liebe die Kamera"), ("praise", "rất đẹp và rất tốt"), ("praise", "非常好用，很喜欢"), ("praise", "great, love it"), ("ad", "buy now"), (None, "x"),
]


def by_hand(rows, classes, text):
    def feats(t):
        words = set(re.findall(N.WORD, (t or "").translate({i: i + 32 for i in range(65, 91)})))
        return words | {"#" + w[i : i + 2] for w in words if not w.isascii() for i in range(max(1, len(w) - 1))}

    seen = {c: Counter(f for k, t in rows if k == c for f in feats(t)) for c in classes}
    size = sum(sum(x.values()) for x in seen.values())
    mine = feats(text) & set().union(*seen.values())
    expected = lambda f, c: sum(x[f] for x in seen.values()) * sum(seen[c].values()) / size
    n = sum(k in classes for k, _ in rows)
    score = [math.log((sum(k == c for k, _ in rows) + 1) / (n + len(classes))) + sum(math.log((seen[c][f] + 1) / (expected(f, c) + 1)) for f in mine) for c in classes]
    best = max(range(len(classes)), key=lambda i: score[i])
    return (classes[best], 1 / sum(math.exp(s - score[best]) for s in score)) if mine else ("other", 0.0)


def test_by_hand(spark):
    classes = ("gap", "praise")
    model = N.fit(spark.createDataFrame(ROWS, "label string, text string"), "text", "label", classes, 0)
    texts = [(1, "Wird es eine Version für die A7M4 geben?"), (2, "Có thể làm loại kẹp cả điện thoại không?"), (3, "能不能出个白色的"), (4, "I LOVE it"), (5, None), (6, ""), (7, "zzz"), (8, "出 " * 30_000)]
    asked = spark.createDataFrame(texts + texts[:3], "id long, text string").withColumn("key", F.lit(1)).withColumn("feature", F.lit(1))
    out = intent_gate(N.classify(asked, "id", "text", model), F.col("found"))
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(texts) == out.count()
    for i, text in texts:
        intent, confidence = by_hand(ROWS, classes, text)
        assert got[i]["intent"] == intent and abs(got[i]["confidence"] - confidence) < 2e-6
    assert [got[i]["passes"] for i in range(1, 8)] == [True, True, True, False, False, False, False]
    assert not N.classify(asked.limit(0), "id", "text", model).collect()
    empty = N.fit(asked.limit(0).withColumn("label", F.lit("gap")), "text", "label", classes)
    assert {r["found"]["intent"] for r in N.classify(asked, "id", "text", empty).collect()} == {"other"}


def test_shuffled_weights(spark, monkeypatch):
    """The same result where the weights are too many to broadcast."""
    model = N.fit(spark.createDataFrame(ROWS, "label string, text string"), "text", "label", ("gap", "praise"), 0)
    asked = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(ROWS)], "id long, text string")
    near = sorted(N.classify(asked, "id", "text", model).collect())
    monkeypatch.setattr(N, "BROADCAST_FEATURES", 0)
    far = sorted(N.classify(asked, "id", "text", model).collect())
    assert [(r["id"], r["found"]["intent"], round(r["found"]["confidence"], 9)) for r in near] == [(r["id"], r["found"]["intent"], round(r["found"]["confidence"], 9)) for r in far]


def test_held_out(spark):
    """Labels stand for intents. The deviation was chosen on the documents of sf0.01, so none of their texts are among these."""
    sf = "/root/testdata/sf0.1"
    seen = read(spark, "/root/testdata/sf0.01", "documents").select("text")
    rows = read(spark, sf, "documents").select("doc_id", "text").join(seen, "text", "left_anti").join(read(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "gap").otherwise("other").alias("label")), "doc_id")
    model = N.fit(rows.where("doc_id % 2 = 0"), "text", "label", ("gap", "other"))
    test = rows.where("doc_id % 2 = 1")
    judged = N.classify(test, "doc_id", "text", model).join(test, "doc_id")
    right = (F.col("found.intent") == F.col("label")).cast("double")
    got = judged.select(F.avg(right).alias("share"), F.avg(F.when(F.col("label") == "gap", right)).alias("recall"), F.avg(F.when(F.col("label") == "other", right)).alias("spared"), F.count(F.lit(1)).alias("n")).first()
    print("held out:", got)
    assert got["n"] > 1000 and got["share"] > 0.9
