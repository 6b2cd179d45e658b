"""Very long and periodic texts, and tables whose other columns have the names that operators use themselves."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoloom.llm.decontaminate import decontaminate
from echoloom.llm.fixity import fixity
from echoloom.llm.near_dup import near_duplicates
from echoloom.llm.suffix_dedup import suffix_dedup
from echoloom.llm.url_filter import url_filter

from .helpers import docs
from .test_text_operators import hits_by_force


def test_long_and_periodic_bytes(spark):
    rng = np.random.default_rng(8)
    noise = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    passage = noise(900)
    texts = ["ab" * 150_000, noise(300_000) + passage + noise(200_000), passage, "abc" * 40_000 + noise(500), "x" * 60_000]
    got = {r["doc_id"]: r for r in suffix_dedup(docs(spark, list(enumerate(texts)))).collect()}
    data = [t.encode() for t in texts]
    seen = Counter(hashlib.blake2b(b[i : i + 200], digest_size=12).digest() for b in data for i in range(len(b) - 199))
    for d, b in enumerate(data):
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 199):
            if seen[hashlib.blake2b(b[i : i + 200], digest_size=12).digest()] > 1:
                gone[i] += 1
                gone[i + 200] -= 1
        held = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~held])
        assert (got[d]["n_removed"], got[d]["kept_sha256"]) == (int(held.sum()), hashlib.sha256(kept).hexdigest())


def test_long_words(spark):
    """Megabyte texts: near-duplicates and benchmark windows in them are found, and periodic ones have few shingles."""
    rng = np.random.default_rng(9)
    words = [f"w{x}" for x in rng.integers(0, 50_000, 150_000)]
    edited = list(words)
    edited[70_000] = "edited"
    rows = [(0, " ".join(words)), (1, " ".join(edited)), (2, "tick tock " * 100_000), (3, "tick tock " * 50_000), (4, "y" * 1_000_000)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs(spark, rows), size=3, percent=85).collect()}
    assert {d: c for d, (_, c) in got.items()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4} and got[2][0] == 2 and got[4][0] == 1
    items = [(1, " ".join(words[149_980:149_995])), (2, "tick tock " * 6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    hit = {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_hit", "n_items")) for r in decontaminate(docs(spark, rows), bench).collect()}
    assert hit == {0: (150_000, 15, 1), 1: (150_000, 15, 1), 2: (200_000, 200_000, 1), 3: (100_000, 100_000, 1), 4: (1, 0, 0)}


@pytest.mark.parametrize("text", ["one two three four five six seven eight nine ten eleven", "tick tock " * 12])
def test_near_places(spark, text):
    """n_near counts windows whose two rarest words stand about as far apart as in the window, the exact places included."""
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    words = text.split()
    rows = [(0, text), (1, " ".join(words[:5] + ["more"] + words[5:])), (2, " ".join(reversed(words))), (3, "none of them"), (4, None)]
    got = {r["doc_id"]: (r["n_near"], r["n_hit"]) for r in decontaminate(docs(spark, rows), bench).collect()}
    assert got[0][0] == len({tuple(words[i : i + 10]) for i in range(len(words) - 9)}) and got[0][1] == hits_by_force(text, [(1, text)])[1]
    assert got[1][0] >= 1 and got[3] == got[4] == (0, 0)


def test_clashing_page_columns(spark):
    rows = [(i, f"http://shop{i}.net/es/", "<p>" * (i % 4) + "y" * (200_000 if i == 3 else 1)) for i in range(20)]
    plain = spark.createDataFrame(rows, "page_id long, url string, html string")
    names = ["id", "node", "hash", "archive", "offset", "length", "digest", "gap", "state", "host", "path", "alias", "own", "part", "component", "rule", "verdict", "a", "b", "to"]
    busy = plain.select("*", *[F.lit("x").alias(n) for n in names])
    same = lambda f: (sorted(map(tuple, f(plain).collect()), key=repr), sorted(map(tuple, f(busy).collect()), key=repr))
    for f in (url_filter, lambda df: fixity(df, df)):
        one, two = same(f)
        assert one == two and len(one) == 20
