import hashlib
import zlib

import pytest

from echoloom.llm.decontaminate import build_index, decontaminate, drop_contaminated, item_windows, proximity_matches, rare_terms
from echoloom.llm.licenses import PHRASES, STRIDE, TEMPLATES, license_scan
from echoloom.llm.line_dedup import line_dedup
from echoloom.llm.packing import END_ID, Encoder, cut, difference, level, pack
from echoloom.llm.url_filter import url_filter

from .helpers import alnum, corpus, docs

NOTICE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."


def licenses_by_force(text):
    words = alnum(text)
    places, named = [], set()
    for phrase, label in PHRASES:
        p = phrase.split(" ")
        found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += found
        if found:
            named.add(label)
    labels, best = set(named), 0.0
    for s in range(0, max(len(words) - STRIDE, 1), STRIDE):
        block = set(words[s : s + 2 * STRIDE])
        for label, t in TEMPLATES:
            want = set(t.split(" "))
            if 100 * len(want & block) >= 80 * len(want):
                labels.add(label)
                best = max(best, len(want & block) / len(want))
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(named)), ",".join(sorted(labels)), 1.0 if named else best)


def test_licenses(spark):
    rows = corpus() + [(100, "filler " * 90 + NOTICE + " filler" * 70), (101, NOTICE.replace("granted", "given").replace("fee", "pay")), (102, "Licensed under CC BY-NC 4.0. Released under the MIT License."), (103, NOTICE[:90]), (104, "under the mit licenseE under the MIT License"), (None, "This work is licensed under the GNU General Public License, version 3.")]
    got = sorted(map(tuple, license_scan(docs(spark, rows)).drop("matches").collect()), key=repr)
    assert got == sorted(((i, *licenses_by_force(t)) for i, t in rows), key=repr)
    by_id = {r[0]: r for r in got}
    assert by_id[100][6] == by_id[101][6] == "isc" and by_id[102][5] == "cc-by-nc,mit" and by_id[103][6] == "" and by_id[None][6] == "gpl"
    assert license_scan(docs(spark, [])).count() == 0


def lines_by_force(rows):
    seen, covered, turns = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        turns[r] = turns.get(r, 0) + 1
        lines = (r[1] or "").split("\n")
        for i in range(len(lines) - 2):
            run = tuple(lines[i : i + 3])
            if run in seen:
                covered.setdefault((r, turns[r]), set()).update((i, i + 1, i + 2))
            seen[run] = 1
    out = []
    for r in rows:
        lines, gone = (r[1] or "").split("\n"), covered.get((r, turns[r]), set())
        turns[r] -= 1
        text = "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else r[1]
        out.append((r[0], text, len(lines), len(gone), sum(i - 1 not in gone for i in gone)))
    return out


def test_line_dedup(spark):
    rows = corpus(2) + [(200, "a\nb\nc\nd"), (201, "x\na\nb\nc\ny\na\nb\nc"), (202, "b\nc\nd"), (203, "\n\n\n\n\n"), (204, "a\nb")]
    out = line_dedup(docs(spark, rows))
    assert [c for c in out.columns if c in ("key", "pos", "words", "id", "n")] == ["key", "pos", "words", "id", "n"]
    got = sorted(map(tuple, out.select("doc_id", "text", "n_lines", "n_removed", "n_spans").collect()), key=repr)
    assert got == sorted(lines_by_force(rows), key=repr)
    assert dict((r[0], r[1]) for r in got)[201] == "x\ny"
    assert line_dedup(docs(spark, [])).count() == 0


def hits_by_force(text, items, size=10):
    words, hit, found = alnum(text), set(), set()
    for item, t in items:
        w = alnum(t)
        k = min(size, len(w))
        for s in range(len(w) - k + 1) if w else ():
            for p in range(len(words) - k + 1):
                if words[p : p + k] == w[s : s + k]:
                    hit.update(range(p, p + k))
                    found.add(str(item))
    ids = ",".join(sorted(found))
    return (len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))


def test_decontamination(spark):
    rows = corpus(3)
    texts = [t for _, t in rows if t]
    rows += [(300, "say WHAT now"), (301, "k9 " * 30), (302, "été " * 12), (303, "what")]
    items = [(0, " ".join(texts[12].split()[5:40])), (2, "What now?"), (10, None), (11, ""), (12, "K9 " * 10), (13, " ".join(texts[12].split()[8:30])), (14, "no such words here at all in any text of the corpus"), (2, "what"), (15, "Été " * 10)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontaminate(docs(spark, rows), bench).drop("key", "n_near").collect()), key=repr)
    assert got == sorted(((i, *hits_by_force(t, items)) for i, t in rows), key=repr)
    clean = drop_contaminated(docs(spark, rows), bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(i for i, t in rows if not hits_by_force(t, items)[4])
    assert clean.columns == docs(spark, rows).columns
    assert decontaminate(docs(spark, rows), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate(docs(spark, []), bench).count() == 0


def test_proximity(spark):
    rows = [(0, "alpha x beta"), (1, "alpha beta"), (2, "alpha x y z beta"), (3, "beta alpha"), (4, "gamma"), (5, None)]
    windows, _ = item_windows(spark.createDataFrame([(0, "alpha beta"), (1, "gamma")], "item_id long, text string"))
    index = build_index(docs(spark, rows), windows.selectExpr("explode(words) AS term"))
    ids = {r["key"]: r["id"] for r in index.where("id IS NOT NULL").collect()}
    found = proximity_matches(index, rare_terms(index, windows), 2).collect()
    assert sorted((ids[r["key"]], abs(r["drift"])) for r in found) == [(0, 1), (1, 0), (3, 2), (4, 0)]


def test_differencing():
    assert sorted(sum(x) for x in ([[8, 7, 6, 5, 4][i] for i in p] for p in difference([8, 7, 6, 5, 4], 2))) == [14, 16]
    assert difference([], 2) == [[], []] and difference([3], 2) == [[0], []]
    sizes = [(i * 7919) % 512 + 1 for i in range(1500)]
    parts = level(sizes)
    assert sorted(i for p in parts for i in p) == list(range(1500))
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) <= 2048 and max(sums) - min(sums) < 64 and len(parts) <= -(-sum(sizes) // 2048) + 2
    assert cut(5000) == [(0, 2048), (2048, 2048), (4096, 512), (4608, 392)]


def test_packing(spark):
    rows = corpus(4) + [(400, "word " * 5000), (401, "a <|endoftext|> b"), (402, "日本語 x\U00031000y"), (None, "null id"), (None, None)]
    got = pack(docs(spark, rows), group_windows=2).collect()
    encode = Encoder()
    want = []
    for i, t in rows:
        ids = [*encode.slow.encode(t or "", add_special_tokens=False).ids, END_ID]
        assert encode(t or "") == ids[:-1]
        want += [(i, s, n, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[s : s + n])), len(ids)) for s, n in cut(len(ids))]
    assert sorted((r[:5] for r in map(tuple, got)), key=repr) == sorted(want, key=repr)
    windows = {}
    for r in got:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in windows.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r["length"] for r in got)
    assert len(windows) * 2048 - total <= 0.12 * total + 2048
    assert pack(docs(spark, [])).count() == 0


def test_url_filter(spark):
    html = '<html><head><link rel="canonical" href="%s"></head></html>'
    pages = [
        (0, "http://a.org/x", html % "https://b.org/y"),
        (1, "https://b.org/y/", '<meta http-equiv="refresh" content="0; url=http://example.com/en/z">'),
        (2, "http://Example.COM/en/z", None),
        (3, "http://c.org/1", html % "http://www.example.com/en/z"),
        (4, "http://d.org/1", html % "http://c.org/1"),
        (5, "http://d.org/1", html % "http://shop.net/es/1"),
        (6, "http://shop.net/es/1#top", ""),
        (7, None, html % "http://shop.net/es/1"),
        (8, "no scheme", None),
        (9, "http://e.org", html % "http://shop.net/es/1"),
        (10, "http://com", None),
        (11, "http://notexample.com/en/", None),
        (12, "http://www.example.com/en/z", None),
        (12, "http://www.example.com/en/z", None),
        (13, "http://x.net/de/?u=http://y", None),
        (14, "http://f.org/q?utm_source=feed", html % "http://shop.net/fr/?ref=x"),
        (15, "http://shop.net/fr/", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted(map(tuple, url_filter(df).collect()))
    verdict = [(r[0], r[3], r[4]) for r in got]
    assert verdict == [
        (0, None, "block"), (1, None, "block"), (2, "example.com/en/", "block"), (3, None, "allow"), (4, None, "allow"), (5, None, "allow"), (6, "net/es/", "block"),
        (7, None, "allow"), (8, None, "allow"), (9, None, "allow"), (10, None, "allow"), (11, "com/", "allow"), (12, "www.example.com/en/", "allow"), (12, "www.example.com/en/", "allow"), (13, None, "allow"), (14, None, "block"), (15, "net/fr/", "block"),
    ]
    assert [r[1:3] for r in got][:1] == [("a.org", "/x")] and got[7][1:3] == ("", "") and got[10][1:3] == ("com", "")
    assert url_filter(df.limit(0)).count() == 0
    log = spark.createDataFrame([("http://g.org/", "http://shop.net/es/9"), (None, "http://x.net/es/")], "a string, b string")
    more = spark.createDataFrame([(1, "http://g.org"), (2, "http://shop.net/es/9")], "page_id long, url string")
    assert sorted(r["verdict"] for r in url_filter(more, links=log, html_col=None).collect()) == ["block", "block"]


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 29), (7, 7), (None, 3)], [(i, (i * 7) % 31) for i in range(31)]])
def test_components(spark, edges):
    from echoloom.llm.graph import connected_components

    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in list(parent)}
