import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from echoloom.llm import near_dup
from echoloom.llm import suffix_dedup as sd
from echoloom.llm.fingerprint import edited_fingerprints, fingerprints, likeness
from echoloom.llm.fixity import audit, fixity, manifest, warc_record
from echoloom.llm.near_dup import BANDS, ROWS, keep_one, least_matches, near_duplicates, prune
from echoloom.llm.toxicity import SLOTS, fit, score, train

from .helpers import corpus, docs, solid


def shingles(text, size):
    w = solid(text)
    return ({tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}) if w else set()


def components_by_force(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return [(d, len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, percent):
    base = " ".join(f"t{i}" for i in range(60))
    rows = corpus(5, 90)
    rows += [(500 + i, base.replace(f"t{i * 2} ", f"u{i} ")) for i in range(30)] + [(600, base), (601, base.upper()), (602, "one  TWO"), (603, base + "\n")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(docs(spark, rows), size=size, percent=percent).collect())
    assert got == sorted(components_by_force(rows, size, percent))
    kept = keep_one(docs(spark, rows), size=size, percent=percent)
    assert kept.columns == docs(spark, rows).columns
    blank = [d for d, n, _ in got if n == 0]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, n, c in got if n} | set(blank))
    assert near_duplicates(docs(spark, [])).count() == 0 and keep_one(docs(spark, [])).count() == 0


@pytest.mark.parametrize("block", [256, 3])
def test_open_buckets(spark, monkeypatch, block):
    """A group in which the smallest member is linked to few: the rest is found by the comparison in blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    words = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(30):
        w = list(words)
        for j in range(i % 6):
            w[(i * 5 + j * 11) % 60] = f"d{i}_{j}"
        rows.append((i, " ".join(w)))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(docs(spark, rows), size=3, percent=85).collect())
    assert got == sorted(components_by_force(rows, 3, 85))


def test_bounds_and_pruning():
    bounds = least_matches(85, 130)
    assert [n for n, _ in bounds] == [26, 52, 78, 104, 130] and all(0 < m < n for n, m in bounds)
    rng = np.random.default_rng(0)
    low = 0
    for _ in range(2000):  # pairs at the threshold stay
        hits = np.cumsum(rng.random(130) < 0.85)
        low += any(hits[n - 1] < m for n, m in bounds)
    assert low == 0
    count = BANDS * ROWS
    a = rng.integers(0, 2**32, (3, count), dtype="<u4")
    b = a.copy()
    b[1, : count // 2] += 1
    b[2, :10] += 1
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([4, 5, 6]), pa.array([x.tobytes() for x in a]), pa.array([x.tobytes() for x in b])], names=["a", "b", "x", "y"])
    assert next(prune([batch], least_matches(85, count), count)).column(0).to_pylist() == [1, 3]


def removed_by_force(rows, length):
    seen = Counter()
    data = [(t or "").encode() for _, t in rows]
    for b in data:
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(bool(len(b)) and gone[0]) if len(b) else 0
        out.append((d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "gram"), [(200, 48), (40, 16)])
def test_suffix_dedup(spark, length, gram, monkeypatch):
    rows = corpus(6) + [(700, "é" * 150), (701, "ab" * 400), (702, "z" * 199), (703, "z" * 201), (704, None)]
    got = sorted(map(tuple, sd.suffix_dedup(docs(spark, rows), length=length, gram=gram).drop("kept").collect()))
    assert got == sorted(removed_by_force(rows, length))
    monkeypatch.setattr(sd, "HOT_CONTEXTS", 1)
    assert sorted(map(tuple, sd.suffix_dedup(docs(spark, rows), length=length, gram=gram).drop("kept").collect())) == got
    assert sd.suffix_dedup(docs(spark, [])).count() == 0


def test_refinement_and_runs(monkeypatch):
    rng = np.random.default_rng(1)
    for length in (5, 8, 20, 33):
        pieces = [rng.integers(0, 2, rng.integers(1, 90)).astype(np.uint8) for _ in range(12)]
        data, bounds = np.concatenate(pieces), np.cumsum([0, *map(len, pieces)])
        got = sd.refine(data, np.repeat(bounds[1:], np.diff(bounds)), length)
        seen = Counter(p[i : i + length].tobytes() for p in pieces for i in range(len(p) - length + 1))
        want = np.concatenate([[i + length <= len(p) and seen[p[i : i + length].tobytes()] > 1 for i in range(len(p))] for p in pieces])
        assert (got == want).all()
    monkeypatch.setattr(sd, "CHUNK", 64)
    data = rng.integers(0, 3, 500).astype(np.uint8)
    runs = [x for a, s, e in sd.super_windows(data, sd.Roller(8), 20) for x in zip(s.tolist(), e.tolist(), strict=True)]
    assert [p for s, e in runs for p in range(s, e - 19)] == list(range(481))


def test_fingerprints(spark):
    rows = corpus(7) + [(800, "Ünï cödé 🎈🎈 text with some more words to cut")]
    got = edited_fingerprints(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])
    by_id = {r["doc_id"]: r for r in got}
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        cut = len(t) // 3
        r = by_id[d]
        if d == rows[10][0]:  # two rows
            continue
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if t == after:
            assert r["near_next"] == 1
    prints = {}
    for r in got:
        prints.setdefault(dict(rows)[r["doc_id"]] or "", set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in prints.values())
    assert edited_fingerprints(docs(spark, [])).count() == 0
    one = edited_fingerprints(docs(spark, [(None, "a b c d e f")])).collect()
    assert one[0]["near_next"] == 1 and one[0]["doc_id"] is None


def test_fingerprint_bins(spark):
    """Small bins, among them those of an id that a third of the rows share, give the rows of one bin."""
    rows = corpus(7) + [(20, f"text {i} of an id with many rows") for i in range(40)] + [(None, f"null {i}") for i in range(30)]
    whole = sorted(map(tuple, edited_fingerprints(docs(spark, rows)).collect()), key=repr)
    assert sorted(map(tuple, edited_fingerprints(docs(spark, rows), bin_rows=7).collect()), key=repr) == whole


def test_collision_rate(spark):
    """Equal samples estimate sum(min) / sum(max) of word counts."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 150) % 60)) for i in range(40)]
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints(docs(spark, rows), count=256).collect()}
    pairs = [(i, j) for i in range(40) for j in range(i)]
    est = [r[0] for r in spark.createDataFrame([(got[i], got[j]) for i, j in pairs], "a string, b string").select(likeness(spark_col("a"), spark_col("b"), 256)).collect()]
    true = []
    for i, j in pairs:
        x, y = Counter(rows[i][1].split()), Counter(rows[j][1].split())
        true.append(sum((x & y).values()) / sum((x | y).values()))
    error = np.array(est) - np.array(true)
    assert abs(error.mean()) < 0.03 and error.std() < 0.06


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_toxicity_fit():
    rng = np.random.default_rng(5)
    lists, toxic, severe = [], [], []
    for _ in range(3000):
        g = int(rng.choice(3, p=[0.85, 0.1, 0.05]))
        lists.append(np.unique(np.concatenate([rng.integers(100, 5000, 60), rng.choice(12, g * 3, replace=False)])))
        toxic.append(g > 0)
        severe.append(g)
    pack = lambda part: (np.concatenate([[0], np.cumsum([len(x) for x in part])]), np.concatenate(part))
    offsets, flat = pack(lists[:2000])
    model = fit(offsets, flat, np.array(severe[:2000]))
    assert len(model.cuts) == 2 and model.cuts[0] < model.cuts[1] and model.dense().shape == (SLOTS,)
    dense = model.dense()
    s = np.array([dense[x].sum() for x in lists[2000:]])
    held, grades = np.array(toxic[2000:]), np.array(severe[2000:])
    found = s > model.cuts[0]
    assert found[held].mean() > 0.97 and found[~held].mean() < 0.01
    assert (s > model.cuts[1])[grades == 2].mean() > 0.9 and (s > model.cuts[1])[grades == 1].mean() < 0.3
    assert len(fit(offsets, flat, np.zeros(2000, int)).slots) == 0


def test_toxicity(spark):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        words = [f"v{x}" for x in rng.integers(0, 300, 40)] + (["Vile", "rotten"] if bad else [])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 12 != 0), int(bad)))
    df, tagged = docs(spark, rows + [(900, None), (901, ""), (902, "VILE rotten " + "v1 " * 20000), (None, "vile rotten"), (3, rows[3][1])]), spark.createDataFrame([*labels[:400], (None, 1, 1), (9999, 0, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    out = score(df, train(df, tagged))
    got = [(r["doc_id"], r["toxic"], r["severity"], r["expected_severity"]) for r in out.collect()]
    assert len(got) == 605 and out.columns[: len(df.columns)] == df.columns
    held = [(i, t) for i, t, _, _ in got if i is not None and 400 <= i < 600]
    assert np.mean([t == (i % 6 == 0) for i, t in held]) > 0.98
    by_id = {r[0]: r for r in got}
    assert not by_id[900][1] and not by_id[901][1] and by_id[902][1] and by_id[None][1]
    assert all((s >= 1) == t and 0 <= e <= 2 for _, t, s, e in got)
    none = score(df, train(df, tagged.where("toxic = 0"))).where("toxic").count()
    assert none == 0 == score(df.limit(0), train(df, tagged.limit(0))).count()


def test_fixity(spark):
    pages = [(i, f"http://x/{i}", "é" * (i % 50)) for i in range(-3, 700)] + [(5, "http://x/twice", "t"), (5, "http://x/twice", "t"), (None, "http://x/null", "n"), (9000, None, None)]
    schema = "page_id long, url string, html string"
    changed = [(i, u, "#" + h[1:]) if i in (20, 333) else (i, u, h) for i, u, h in pages if i not in (21, 9000)] + [(9001, "u", "new"), (5, "http://x/twice", "t")]
    got = fixity(spark.createDataFrame(pages, schema), spark.createDataFrame(changed, schema)).collect()
    states = {}
    for r in got:
        states.setdefault(r["state"], set()).add(r["page_id"])
    assert states["corrupt"] == {20, 333, 5} and states["missing"] == {21, 9000} and states["extra"] == {9001} and states["unaudited"] == {None}
    assert len(got) == len(pages) + 1
    own = sorted((r for r in got if r["archive"] == 0 and r["state"] != "extra"), key=lambda r: r["offset"])
    end = 0
    for r in own:
        assert r["offset"] == end
        end += r["length"]
    row = next(r for r in got if r["page_id"] == 7)
    body = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nWARC-Target-URI: http://x/7\r\nContent-Length: 14\r\n\r\n" + "é".encode() * 7 + b"\r\n\r\n"
    assert row["digest"] == hashlib.sha256(body).hexdigest() and row["length"] == len(body)
    empty = spark.createDataFrame([], schema)
    assert fixity(empty, empty).count() == 0


def test_descent_reads_little(spark):
    from pyspark.sql import functions as F

    pages = spark.range(4096).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html"))
    other = pages.withColumn("html", F.when(F.col("page_id") == 1234, F.lit("1235")).otherwise(F.col("html")))
    one, two = (manifest(df.select("page_id", warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("r")), "page_id", "r") for df in (pages, other))
    found, visited = audit(one, two)
    assert [tuple(r) for r in found.collect()] == [(1234, "corrupt")] and visited == [1, 16, 16, 16]
    assert audit(one, one)[1] == [1, 0, 0, 0]


def test_fixity_offsets(spark):
    """The replica's own offsets count: gaps, overlaps and order, but not what follows from a longer or lost record."""
    pages = [(i, "u", "x" * (i % 5)) for i in range(1, 40)]
    schema = "page_id long, url string, html string"
    ours = spark.createDataFrame(pages, schema)
    size = {r["page_id"]: r["length"] for r in fixity(ours, ours).collect()}
    order = [i for i in range(1, 40) if i not in (9, 20, 21)] + [20, 21]
    rows, at = [], 0
    for i in order:
        at += {15: 7, 30: -3}.get(i, 0)
        rows.append((i, "u", "y" * 50 if i == 5 else "x" * (i % 5), at))
        at += size[i] + (50 - 0 + 1 if i == 5 else 0)
    theirs = spark.createDataFrame(rows, schema + ", at long")
    states = {r["page_id"]: r["state"] for r in fixity(ours, theirs, offset_col="at").collect()}
    assert {i: s for i, s in states.items() if s != "ok"} == {5: "corrupt", 9: "missing", 15: "moved", 30: "moved", 20: "moved", 21: "moved"}
