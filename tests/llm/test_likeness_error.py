from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from echoloom.llm.fingerprint import SAMPLES, fingerprints, likeness


def test_likeness_error(spark):
    """The registered number of draws keeps the error of a likeness within the bound that more draws are held to."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 150) % 60)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints(df).collect()}
    assert {len(x) for x in got.values()} == {4 * SAMPLES}
    pairs = [(i, j) for i in range(40) for j in range(i)]
    est = [r[0] for r in spark.createDataFrame([(got[i], got[j]) for i, j in pairs], "a string, b string").select(likeness(F.col("a"), F.col("b"))).collect()]
    words = [Counter(t.split()) for _, t in rows]
    true = [sum((words[i] & words[j]).values()) / sum((words[i] | words[j]).values()) for i, j in pairs]
    error = np.array(est) - np.array(true)
    print("likeness error at", SAMPLES, error.mean(), error.std(), np.mean(true))
    assert abs(error.mean()) < 0.03 and error.std() < 0.06
