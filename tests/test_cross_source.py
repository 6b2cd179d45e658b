"""Cross-source evidence, held against a loop over items, candidates and rows."""

import random

import numpy as np
import pytest

from echoloom.operators.resolve import cross_source
from echoloom.plans.neighbours import _items, _relation
from echoloom.plans.queries import QUERIES

ITEM = "opp_id long, opp_type string, state string, merged_into long, vec array<double>, mode string, title string, snippets array<string>"
ROW = "opp_id long, message_id long, seq long, src_line string, spu array<string>, requires_spu boolean"


def by_force(items, relation, verdict, cap, k=5):
    of, held = {}, {}
    for o, m, q, src, spu, need in relation:
        of.setdefault(o, []).append((m, q, src, spu, need))
        held.setdefault(o, set()).add((m, q))
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    out = set()
    for o, kind, _, _, vec, *_ in items:
        if vec is None:
            continue
        own = {r[2] for r in of.get(o, [])}
        near = []
        for p, other, state, merged, w, *_ in items:
            if p != o and other == kind and state == "valid" and merged is None and w is not None and any(r[2] not in own for r in of.get(p, [])):
                near.append((round(float(1 - unit(vec) @ unit(w)), 12), p))
        taken = []
        for d, p in sorted(near)[:k]:
            same, confidence = verdict(round(1 - d, 9), o, p)
            if not same or confidence < 0.6:
                continue
            left = cap - len(taken)
            fit = [(m, q) for m, q, src, spu, need in sorted(of[p], key=lambda r: r[:2]) if src not in own and (m, q) not in held.get(o, set()) and ("old" if spu else "new" if not need else None) == kind]
            taken += [(m, q, p, round(min(confidence, 0.999), 3)) for m, q in fit[: max(left, 0)]]
        seen = set()
        for m, q, p, c in taken:
            if (m, q) not in seen:
                seen.add((m, q))
                out.add((o, m, q, p, c))
    return sorted(out)


def world(seed, n=60):
    rng = random.Random(seed)
    kinds = {"old": "existing_product", "new": "innovation"}
    items, relation, centre = [], [], [rng.gauss(0, 1) for _ in range(6)]
    for i in range(n):
        vec = None if i % 19 == 4 else [c + rng.gauss(0, 0.2 if i < 12 else 0.8) for c in centre]
        items.append((i, rng.choice(list(kinds)), "invalid" if i % 11 == 3 else "valid", 1 if i % 13 == 5 else None, vec, f"m{i}", None, [f"v{i}"]))
        # The first twelve lie close together and share one source: their five nearest have nothing to give.
        for _ in range(rng.randrange(0, 12)):
            relation.append((i, rng.randrange(90), rng.randrange(2), "a" if i < 12 else rng.choice("abc"), rng.choice([[], ["P1"], None]), rng.random() < 0.5))
    relation = list({r[:3]: r for r in relation}.values())
    return items, relation, kinds


@pytest.mark.parametrize(("seed", "cap"), [(1, 40), (2, 3)])
def test_cross_source(spark, seed, cap):
    items, relation, kinds = world(seed)
    frame = spark.createDataFrame([(i[0], kinds[i[1]], *i[2:]) for i in items], ITEM)
    judge = lambda p: p.withColumns({"same": p["similarity"] > 0.3, "confidence": p["similarity"]})
    got = cross_source(frame, spark.createDataFrame(relation, ROW), "2020-W01", judge, cap)
    assert {r["match_by"] for r in got.collect()} <= {"cross_line"} and {r["attach_week"] for r in got.collect()} <= {"2020-W01"}
    want = by_force(items, relation, lambda s, a, b: (s > 0.3, s), cap)
    assert sorted((r["opp_id"], r["message_id"], r["seq"], r["neighbor_id"], r["confidence"]) for r in got.collect()) == want and want


def test_five_nearest_that_share_the_source(spark):
    """An item whose five nearest have no other source still gets the sixth's rows."""
    items = [(i, "innovation", "valid", None, [1.0, 0.01 * i], "m", "t", []) for i in range(8)]
    relation = [(i, 10 + i, 0, "a", [], False) for i in range(7)] + [(7, 99, 0, "b", [], False), (7, 98, 0, "b", ["P"], False), (7, 97, 1, "b", [], True)]
    got = cross_source(spark.createDataFrame(items, ITEM), spark.createDataFrame(relation, ROW), "w")
    rows = sorted((r["opp_id"], r["message_id"], r["neighbor_id"]) for r in got.collect())
    assert [r for r in rows if r[0] < 7] == [(i, 99, 7) for i in range(7)]


def test_judge_sees_both_texts(spark):
    items = [(1, "innovation", "valid", None, [1.0, 0.0], "same words", "t1", ["s"]), (2, "innovation", "valid", None, [1.0, 0.1], "same words", "t2", []), (3, "innovation", "valid", None, [1.0, 0.0], "others", "t3", [])]
    relation = [(1, 1, 0, "a", [], False), (2, 2, 0, "b", [], False), (3, 3, 0, "c", [], False)]
    judge = lambda p: p.selectExpr("*", "mode_a = mode_b AS same", "CASE WHEN title_b = 't2' THEN 0.7D ELSE 0.5D END AS confidence")
    got = cross_source(spark.createDataFrame(items, ITEM), spark.createDataFrame(relation, ROW), "w", judge)
    # The pair 2 -> 1 is the same with too little confidence.
    assert [(r["opp_id"], r["message_id"], r["confidence"]) for r in got.collect()] == [(1, 2, 0.7)]


def test_query_has_items_whose_nearest_share_the_sources(spark):
    sf = "/root/testdata/sf0.001"
    items = _items(spark, sf)
    rel = _relation(spark, sf, items)
    own = {}
    for r in rel.select("opp_id", "src_line").distinct().collect():
        own.setdefault(r["opp_id"], set()).add(r["src_line"])
    rows = [(r["opp_id"], r["opp_type"], r["vec"]) for r in items.where("vec IS NOT NULL AND state = 'valid' AND merged_into IS NULL").collect()]
    shared = 0
    for o, kind, vec in rows:
        near = sorted((-float(np.dot(vec, w) / np.linalg.norm(w)), p) for p, other, w in rows if other == kind and p != o)[:5]
        shared += not any(own.get(p, set()) - own.get(o, set()) for _, p in near)
    assert shared > 0
    assert QUERIES["cross_source_evidence"](spark, sf).count() > 0
