"""Fingerprints drawn once more, word by word, in plain Python."""

import hashlib
import math
import re
import struct
from collections import Counter

import pytest
import xxhash

from echoloom.llm.fingerprint import SAMPLES, TOGETHER, edited_fingerprints

from .helpers import corpus, docs


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hash_int(x: int, seed: int) -> int:
    return xxhash.xxh64_intdigest(struct.pack("<i", x), seed)


def hash_long(x: int, seed: int) -> int:
    return xxhash.xxh64_intdigest(struct.pack("<q", signed(x)), seed)


def by_hand(text: str, count: int) -> str:
    weights = Counter(xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text))
    out = ""
    for i in range(count):
        block, j = divmod(i, TOGETHER)
        least = None
        for term, w in weights.items():
            seed = hash_int(block, hash_long(term, 42))
            one, two = (hash_int(2 * j + k, hash_long(seed, 42)) for k in (0, 1))
            low, high = (lambda h: ((h & 0xFFFFFFFF) + 0.5) / 2**32), (lambda h: ((h >> 32) + 0.5) / 2**32)
            u, q, c = low(one), low(one) * high(one), -math.log(low(two) * high(two))
            t = 0 if w * u < 1 else math.floor(math.log(w * u) / -math.log(q)) + 1
            a = c * u * (1.0 if t == 0 else q if t == 1 else math.pow(q, t))
            draw = int(a * 2**37) << 20 | ((one ^ (t << 5)) & 0xFFFFF)
            least = draw if least is None else min(least, draw)
        out += f"{(least or 0) & 0xFFFF:04x}"
    return out


@pytest.mark.parametrize("count", [8, SAMPLES])
def test_edited_fingerprints(spark, count):
    rows = corpus(7)[:40] + [(900, "tick " * 3000 + "tock"), (901, "Ünï cödé \U0001f388 " * 9), (902, " ".join(f"w{i}" for i in range(4000)))]
    rows = sorted(rows, key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in edited_fingerprints(docs(spark, rows), count=count).collect()}
    prints = [by_hand(t or "", count) for _, t in rows]
    near = lambda x, y: sum(x[4 * i : 4 * i + 4] == y[4 * i : 4 * i + 4] for i in range(count)) / count
    for n, (d, t) in enumerate(rows):
        text, after = t or "", rows[(n + 1) % len(rows)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        want = by_hand(edited, count)
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (prints[n], want)
        assert r["near_edited"] == near(prints[n], want) and r["near_next"] == near(prints[n], prints[(n + 1) % len(rows)])


def test_string_ids_are_refused(spark):
    df = spark.createDataFrame([("a", "one two")], "doc_id string, text string")
    with pytest.raises(TypeError, match="whole number"):
        edited_fingerprints(df)
