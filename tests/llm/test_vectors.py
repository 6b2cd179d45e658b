"""Whitening and product codes, held against plain numpy and Python's whole numbers."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from echoloom.llm import whitening
from echoloom.llm.queries import QUERIES
from echoloom.llm.vector_codes import nearest, sketch, vector_codes
from echoloom.llm.whitening import SHIFT, whitened

SCHEMA = "vec_id long, embedding array<double>, label int, x string, id string, n string, named string, code string, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", "i", "n", "m", "c", "k") for i, v, y in rows], SCHEMA)


def cloud(n=300, width=8, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) @ rng.normal(size=(width, width)) * 0.3
    rows = [(i, [float(c) for c in v], None if i % 7 == 0 else i % 3) for i, v in enumerate(x)]
    rows += [rows[5], rows[5], (None, rows[9][1], 1), (900, rows[9][1], 2)]
    rows += [(901, None, 1), (902, [], 1), (903, [None] + [0.0] * (width - 1), 1), (904, [math.nan] * width, 1), (905, [math.inf] + [0.0] * (width - 1), None), (906, [-math.inf] * width, 2)]
    return rows


def whole(rows, shift=0):
    fine = [(i, v, y) for i, v, y in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    return [(i, [math.floor(1024 * c) + shift for c in v], y) for i, v, y in fine]


def check_whitening(rows, got, components=8):
    kept = whole(rows, SHIFT)
    n, x = len(kept), np.array([v for _, v, _ in kept])
    sums = [sum(v[j] for _, v, _ in kept) for j in range(x.shape[1])]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for _, v, _ in kept]
    centred = x - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-9 * values[0]).sum()))
    trace = float(Fraction(sum(deviations), n**3))
    assert len(got) == n * k
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], int(r["deviation"])), {}).setdefault(r["component"], []).append(r)
    signs = {}
    for (i, _, _), d, white in zip(kept, deviations, centred @ (vectors[:, :k] / np.sqrt(values[:k])), strict=True):
        assert sorted(by[i, d]) == list(range(1, k + 1))
        for c in range(k):
            r = by[i, d][c + 1][0]
            if abs(white[c]) > 1e-6:
                sign = signs.setdefault(c, math.copysign(1, r["whitened"] * white[c]))
                assert math.isclose(r["whitened"], sign * white[c], rel_tol=1e-9, abs_tol=1e-9)
            assert r["n"] == n and math.isclose(r["explained"], values[c] / trace, rel_tol=1e-9) and 0 <= r["identity_error"] < 1e-9
    assert len({r["identity_error"] for r in got}) == 1


def test_whitening(spark):
    rows = cloud()
    check_whitening(rows, whitened(table(spark, rows)).collect())


@pytest.mark.parametrize("n", [2, 5])
def test_few_rows_have_few_components(spark, n):
    rows = cloud()[:n]
    check_whitening(rows, whitened(table(spark, rows)).collect())


def test_whitening_of_nothing(spark):
    same = [(i, [0.5] * 4, 0) for i in range(9)]
    for rows in ([], [(1, None, 1)], same, same[:1]):
        got = whitened(table(spark, rows))
        assert got.count() == 0 and "identity_error" in got.columns
    with pytest.raises(ValueError, match="one length"):
        whitened(table(spark, [(1, [1.0], 0), (2, [1.0, 2.0], 0)]))


def test_deviations_beyond_63_bits():
    model = whitening.Whitening(1 << 33, [0, 1 << 40], 1 << 12, np.eye(2), np.ones(2))
    x = np.array([[5, -7], [1 << 11, 1 << 12]])
    assert model.deviations(x) == [sum(((1 << 33) * int(c) - s) ** 2 for c, s in zip(v, model.sums, strict=True)) for v in x]


def test_whitening_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], list(r["embedding"]), 0) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = QUERIES["op11_whitening"](spark, sf)
    assert dict(got.dtypes)["deviation"] == "bigint"
    check_whitening(rows, got.collect())


def codes_by_force(rows, parts=4, entries=256, rounds=4):
    kept = whole(rows)
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[r[1][p * width : (p + 1) * width] for r in order[:entries]] for p in range(parts)]

    def assign():
        out = []
        for _, v, _ in kept:
            places = []
            for p in range(parts):
                q = v[p * width : (p + 1) * width]
                places.append(min((sum((a - b) ** 2 for a, b in zip(q, e, strict=True)), j) for j, e in enumerate(books[p])))
            out.append(places)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [kept[i][1][p * width : (p + 1) * width] for i in range(len(kept)) if found[i][p][1] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found, labels = assign(), {}
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    for (_, _, y), f in zip(kept, found, strict=True):
        labels[y] = labels.get(y, 0) + sum(d for d, _ in f)
    return [(str(i), "".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f), labels[y], sha) for (i, _, y), f in zip(kept, found, strict=True)]


@pytest.mark.parametrize(("entries", "rounds"), [(256, 4), (16, 2)])
def test_vector_codes(spark, entries, rounds):
    rows = cloud()
    got = [(str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes(table(spark, rows), entries=entries, rounds=rounds).collect()]
    assert sorted(got) == sorted(codes_by_force(rows, entries=entries, rounds=rounds))


def test_codes_of_odd_tables(spark):
    assert vector_codes(table(spark, [])).count() == 0 and vector_codes(table(spark, [(1, None, 1), (2, [], 2)])).count() == 0
    same = [(i, [0.5, -0.5, 0.25, 3.0], None) for i in range(300)]
    got = vector_codes(table(spark, same)).collect()
    assert {(r["code"], r["error"], r["label_error"]) for r in got} == {("00000000", 0, 0)} and len(got) == 300
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes(table(spark, [(1, [1.0] * 5, 0)]))
    with pytest.raises(ValueError, match="one length"):
        vector_codes(table(spark, [(1, [1.0] * 4, 0), (2, [1.0] * 8, 0)]))
    with pytest.raises(ValueError, match="too far apart"):
        vector_codes(table(spark, [(1, [1e30] * 4, 0), (2, [0.0] * 4, 0)]))


@pytest.mark.parametrize("width", [1, 2, 5, 16, 33])
def test_bounds_are_conservative(width):
    rng = np.random.default_rng(width)
    book = rng.integers(-600, 600, (256, width))
    book[100:120] = book[7]
    points = np.concatenate([rng.integers(-600, 600, (500, width)), book[::5], rng.integers(-2, 3, (500, width))])
    exact = ((points[:, None, :] - book[None]) ** 2).sum(2)
    index, distance = nearest(points, book)
    assert (index == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    for blocks in (1, 4, 8):
        low = ((sketch(points, blocks)[:, None, :] - sketch(book, blocks)[None]) ** 2).sum(2)
        assert (low <= exact + 1e-6).all()
