"""SimHash components, held against all pairs of fingerprints made in plain Python."""

import random

import numpy as np
import pytest
import xxhash

from echoloom.llm import simhash
from echoloom.llm.queries import QUERIES
from echoloom.llm.simhash import byte_masks, half_byte_masks, simhash_duplicates, simhash_links

from .helpers import corpus, docs, solid

SF = "/root/testdata/sf0.001"


def fingerprint(text, size=4):
    w = solid(text)
    runs = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, prints, bits=4):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                parent[root(i)] = root(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [low.get(root(i)) for i in range(len(ids))]


def check(rows, got):
    prints = [fingerprint(t) for _, t in rows]
    want = zip([d for d, _ in rows], prints, components([d for d, _ in rows], prints), strict=True)
    assert sorted(map(str, got)) == sorted(map(str, want))


def near_texts(n=120, seed=2):
    """Long texts with one or two words changed: fingerprints a few bits apart."""
    rng = random.Random(seed)
    base = [f"v{rng.randrange(500)}" for _ in range(700)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(i % 5):
            words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
        out.append((1000 + i, " ".join(words)))
    return out


def test_simhash(spark):
    rows = corpus(8, 80) + near_texts() + [(None, "a text without id"), (None, "five words of some text"), (5000, "FIVE  words\tof some text"), (5001, "long " * 30_000 + "tail"), (5002, "été Straße " * 9)]
    got = [(r["doc_id"], r["print"] % (1 << 64), r["component_id"]) for r in simhash_duplicates(docs(spark, rows)).collect()]
    check(rows, got)
    assert simhash_duplicates(docs(spark, [])).count() == 0
    assert [(r["print"], r["component_id"]) for r in simhash_duplicates(docs(spark, [(None, None)])).collect()] == [(0, None)]


def test_bits_are_counted_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TOGETHER", 7)
    import pyarrow as pa

    rng = np.random.default_rng(1)
    lists = [rng.integers(-(2**63), 2**63, k).tolist() for k in (0, 3, 0, 0, 50, 1, 7, 14, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(lists, pa.list_(pa.int64()))], names=["id", "hashes"])
    for part, rows in ((batch, lists), (batch.slice(3, 4), lists[3:7])):
        got = next(iter(simhash.majority(iter([part])))).column(1).to_pylist()
        assert [x % (1 << 64) for x in got] == [sum(1 << b for b in range(64) if 2 * sum(h % (1 << 64) >> b & 1 for h in hs) > len(hs)) for hs in rows]


@pytest.mark.parametrize("long_list", [512, 6, 2])
@pytest.mark.parametrize("bits", [4, 2])
def test_links(spark, long_list, bits):
    """Dense and sparse fingerprints; lists of more than ``long_list`` are intersected by half bytes as well."""
    rng = random.Random(3)
    prints = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(40):
            x = centre
            for b in rng.sample(range(64), rng.randrange(0, 9)):
                x ^= 1 << b
            prints.add(x)
    prints |= {0xABCDEF0123450000 | i for i in rng.sample(range(1 << 16), 150)}
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash.signed(x),) for x in prints], "print long")
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash_links(df, bits, long_list).collect()]
    assert all((a ^ b).bit_count() <= bits for a, b in links)
    want = components(prints, prints, bits)
    low = {x: x for x in prints}
    for _ in prints:
        before = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            break
    assert [low[x] for x in prints] == want


def test_masks():
    masks = byte_masks(4)
    assert len(set(masks)) == 70 and all(m.bit_count() == 32 for m in masks)
    finer = half_byte_masks(masks[9], 4)
    assert len(set(finer)) == 70 and all(m & masks[9] == masks[9] and m.bit_count() == 48 for m in finer)
    with pytest.raises(ValueError, match="agree"):
        simhash_links(None, 8)


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(rows, [(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in QUERIES["op13_simhash"](spark, SF).collect()])
