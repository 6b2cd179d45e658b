"""Memory of the refinement of one anchor that has very many contexts: copies of a passage with a few edits each."""

import tracemalloc
from collections import Counter

import numpy as np

from echoloom.llm import suffix_dedup as sd


def edited_copies(n: int, size: int = 350) -> list[bytes]:
    rng = np.random.default_rng(1)
    base = rng.integers(97, 123, size, dtype=np.uint8)
    out = []
    for _ in range(n):
        piece = base.copy()
        piece[rng.integers(0, size, 3)] = rng.integers(97, 123, 3)
        out.append(piece.tobytes())
    return out


def test_memory_of_many_contexts():
    pieces = edited_copies(6000)
    data, ends = np.frombuffer(b"".join(pieces), np.uint8), np.repeat(np.arange(350, 350 * 6001, 350, dtype="int32"), 350)
    tracemalloc.start()
    got = sd.refine(data, ends, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * len(data)
    seen = Counter(p[i : i + 200] for p in pieces for i in range(151))
    assert (got == [i < 151 and seen[p[i : i + 200]] > 1 for p in pieces for i in range(350)]).all()


def test_shares_sorted_apart(monkeypatch):
    pieces = edited_copies(60)
    data, ends = np.frombuffer(b"".join(pieces), np.uint8), np.repeat(np.arange(350, 350 * 61, 350, dtype="int32"), 350)
    want = sd.refine(data, ends, 200)
    monkeypatch.setattr(sd, "SORTED", 500)
    assert (sd.refine(data, ends, 200) == want).all() and want.any()
