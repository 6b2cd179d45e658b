"""What SQL cannot say, worked out once more in plain Python."""

import math
import struct

import pytest
import xxhash

from echoloom.llm.line_dedup import line_dedup
from echoloom.llm.queries import QUERIES
from echoloom.llm.toxicity import CUT, SLOTS, STEMS, score, train

from .helpers import alnum, docs

SF = "/root/testdata/sf0.001"


def slots_by_hand(text):
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    out = set()
    for w in set(alnum(text)):
        out.add(signed(xxhash.xxh64_intdigest(w.encode(), 42)) % SLOTS)
        for n in STEMS:
            seed = xxhash.xxh64_intdigest(struct.pack("<i", n), 42)
            out.add(signed(xxhash.xxh64_intdigest(w[:n].encode(), seed)) % SLOTS)
    return out


def test_op3_scores(spark):
    """The registered query against sums of the fitted weights, word by word."""
    tables = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")}
    model = train(tables["documents"].select("doc_id", "text"), tables["labels"])
    weight = dict(zip(model.slots.tolist(), model.weights.tolist(), strict=True))
    got = {r["doc_id"]: r for r in QUERIES["op3_toxicity"](spark, SF).collect()}
    rows = tables["documents"].collect()
    assert len(got) == len(rows) and any(r["toxic"] for r in got.values())
    for r in rows:
        s = sum(weight.get(k, 0.0) for k in slots_by_hand(r["text"]))
        reach = [1 - 1 / (1 + math.exp(s - c)) for c in model.cuts]
        if min(abs(p - CUT) for p in reach) > 1e-4:
            assert got[r["doc_id"]]["severity"] == sum(p >= CUT for p in reach)
            assert got[r["doc_id"]]["toxic"] == (reach[0] >= CUT)
        assert got[r["doc_id"]]["expected_severity"] == pytest.approx(sum(reach), abs=1e-4)


@pytest.mark.parametrize("name", ["severity", "Toxic", "expected_severity"])
def test_score_refuses_clashes(spark, name):
    df = docs(spark, [(1, "a b")])
    model = train(df, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    with pytest.raises(ValueError, match="already has"):
        score(df.withColumnRenamed("n", name), model)


def test_line_dedup_refuses_clashes(spark):
    with pytest.raises(ValueError, match="already has"):
        line_dedup(docs(spark, [(1, "a")]).withColumnRenamed("n", "n_lines"))


def test_line_dedup_repeated_rows(spark):
    """Of equal rows one is the first occurrence; the others lose every line that a window covers."""
    text = "a\nb\nc\nd"
    rows = [(5, text)] * 3 + [(7, "x\ny")] * 2 + [(None, "p\nq\nr")] * 2 + [(9, "z\n" + text)]
    got = sorted((repr(r["doc_id"]), r["text"], r["n_removed"], r["n_spans"]) for r in line_dedup(docs(spark, rows)).collect())
    assert got == sorted([("5", text, 0, 0), ("5", "", 4, 1), ("5", "", 4, 1), ("7", "x\ny", 0, 0), ("7", "x\ny", 0, 0), ("None", "p\nq\nr", 0, 0), ("None", "", 3, 1), ("9", "z", 4, 1)])
