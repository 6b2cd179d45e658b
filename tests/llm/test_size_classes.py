import random

import pytest
from pyspark.sql import functions as F

from echoloom.llm import near_dup
from echoloom.llm.near_dup import near_duplicates, size_class

from .helpers import docs
from .test_near_and_models import components_by_force


@pytest.mark.parametrize("percent", [80, 85, 99])
def test_sizes_that_can_be_similar_are_neighbours(spark, percent):
    n = 4000
    got = [r[0] for r in spark.range(1, n).orderBy("id").select(size_class(F.col("id"), percent)).collect()]
    for low in range(1, n):
        high = min(100 * low // percent, n - 1)  # the largest set that a set of ``low`` can be similar to
        assert 0 <= got[high - 1] - got[low - 1] <= 1
    assert got[-1] > 20


@pytest.mark.parametrize("block", [256, 3])
def test_buckets_of_unlike_sizes(spark, monkeypatch, block):
    """Texts of many sizes share a passage, and so buckets; each has a near twin that its bucket's first member is not."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for k in range(30):
        tail = [f"t{k}_{i}" for i in range(rng.randrange(0, 160))]
        rows.append((2 * k, " ".join(passage + tail)))
        near = passage + tail
        near[rng.randrange(len(near))] = "x"
        rows.append((2 * k + 1, " ".join(near)))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(docs(spark, rows), size=3, percent=85).collect())
    assert got == sorted(components_by_force(rows, 3, 85)) and len({c for _, _, c in got}) > 10
