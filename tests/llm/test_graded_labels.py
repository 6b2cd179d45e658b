import random

from pyspark.sql import functions as F

from echoloom.llm.toxicity import score, train

from .helpers import docs


def test_expected_severity_rises_with_the_grade(spark):
    """Labels of four grades, end to end: shared weights, three cuts, and expected severity in the order of the grades."""
    rng = random.Random(4)
    plain = [f"w{i}" for i in range(300)]
    cues = [f"bad{i}" for i in range(12)]
    rows, grades = [], []
    for i in range(1600):
        g = rng.choice([0, 0, 1, 2, 3])
        words = rng.choices(plain, k=40) + rng.sample(cues, 3 * g)
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        grades.append((i, g))
    df, labels = docs(spark, rows), spark.createDataFrame(grades[:1200], "doc_id long, grade int")
    model = train(df, labels, grade=F.col("grade"))
    assert len(model.cuts) == 3 and (model.cuts[1:] > model.cuts[:-1]).all()
    got = {r["doc_id"]: r for r in score(df, model).collect()}
    held = [(got[i]["expected_severity"], got[i]["severity"], g) for i, g in grades[1200:]]
    mean = [sum(e for e, _, g in held if g == k) / sum(g == k for *_, g in held) for k in range(4)]
    assert mean == sorted(mean) and all(b - a > 0.5 for a, b in zip(mean, mean[1:], strict=False))
    assert sum(s == g for _, s, g in held) > 0.8 * len(held)


def test_long_texts_bring_kept_slots_only(spark):
    """A labelled text of many words nobody else uses adds nothing to what the model is fitted on."""
    rows = [(i, ("vile rotten " if i % 3 == 0 else "") + f"w{i % 7} w{i % 11} fine") for i in range(300)] + [(500, " ".join(f"only{i}" for i in range(50_000)))]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)] + [(500, 1, 0)], "doc_id long, quality int, toxic int")
    model = train(docs(spark, rows), labels)
    assert 0 < len(model.slots) < 40
    assert {r["doc_id"] for r in score(docs(spark, rows), model).where("toxic").collect()} == {i for i in range(0, 300, 3)}
