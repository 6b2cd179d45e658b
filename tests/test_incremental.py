import random

import pytest
from pyspark.sql import functions as F

from echoloom.operators import incremental as I
from echoloom.operators.core import recount, spread, spu_container, spu_issue
from echoloom.sources.fixtures import evidence, message
from echoloom.sources.versions import Store

SCHEMA = "opp_id string, message_id long, seq long, src_line string, star int, attach_week string, tax_path string, publish_time timestamp, spu array<string>, rule string"
FACT = "spu string, message_id long, category string, star int, publish_time timestamp, country string, negative long, positive long, gone boolean"


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


def some(rng, opp, message, seq):
    spu = rng.sample(["P1", "P2", "P3", "P4"], rng.randrange(4))
    return (opp, message, seq, rng.choice("ab"), rng.choice([None, 1, 3, 5]), f"2024-W{message % 50:02}", rng.choice(["t/a", "t/b"]), None, spu, "R1" if spu else "R2")


def merged(state, merges):
    """Rows after merges, one loser after another."""
    end = lambda o: end(merges[o]) if o in merges else o
    out = {}
    for (o, m, q), r in sorted(state.items(), key=lambda x: (x[0][0] in merges, x[0][0])):
        out.setdefault((end(o), m, q), (end(o), *r[1:]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_refresh_equals_recompute(spark, tmp_path, seed):
    rng = random.Random(seed)
    state = {(o, m, q): some(rng, o, m, q) for o, m, q in {(f"o{rng.randrange(25)}", rng.randrange(60), rng.randrange(2)) for _ in range(260)}}
    frame = lambda data: spark.createDataFrame(data, SCHEMA)
    store = Store(spark, f"{tmp_path}/s")
    I.bootstrap(store, frame(list(state.values())), spark.createDataFrame([], FACT).drop("gone"), 16)
    for turn in range(2):
        before = store.at()
        opps = rng.sample(sorted({k[0] for k in state}), 6)
        new = [some(rng, o, rng.randrange(60, 90), 0) for o in [*opps[:3], f"n{turn}"]]
        edits = [some(rng, *k) for k in rng.sample([k for k in state if k[0] in opps[:2]], 3)]
        upserts = {r[:3]: r for r in edits + new}
        lost = [k for k in rng.sample([k for k in state if k[0] in opps[2:4]], 2) if k not in upserts]
        merges = {opps[4]: opps[5], opps[5]: opps[0]}
        changes = I.refresh(store, frame(list(upserts.values())), spark.createDataFrame(lost, "opp_id string, message_id long, seq long"), spark.createDataFrame(list(merges.items()), "loser string, survivor string"))
        state = {k: r for k, r in state.items() if k not in lost} | upserts
        state = merged(state, merges)
        now, whole = store.at(), frame(list(state.values()))
        assert now.version == before.version + 1
        assert rows(now.read("relation").select(whole.columns)) == rows(whole)
        for name, make in (("recount", recount), ("issue", spu_issue), ("spread", spread)):
            assert rows(now.read(name)) == rows(make(whole)), name
            kept = {b: p for b, p in before.files(name).items() if int(b) not in changes[name]}
            assert kept and all(now.files(name).get(b) == p for b, p in kept.items())
    assert I.refresh(store, frame([]), spark.createDataFrame([], "opp_id string, message_id long, seq long")) == {}
    assert store.version() == 3


def test_containers_equal_the_full_ones(spark):
    sf = "/root/testdata/sf0.001"
    m, e = message(spark, sf), evidence(spark, sf)
    want = spu_container(m, e)
    assert rows(I.containers(I.product_facts(m, e)).select(want.columns)) == rows(want)


def test_circles_and_repeated_rows_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="circle"):
        I.canonical(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "loser string, survivor string"))
    chain = I.canonical(spark.createDataFrame([(f"o{i}", f"o{i + 1}") for i in range(20)], "loser string, survivor string"))
    assert {r["survivor"] for r in chain.collect()} == {"o20"} and chain.count() == 20
    store = Store(spark, f"{tmp_path}/s")
    row = some(random.Random(0), "o", 1, 0)
    I.bootstrap(store, spark.createDataFrame([row], SCHEMA), spark.createDataFrame([], FACT).drop("gone"))
    with pytest.raises(ValueError, match="repeated"):
        I.refresh(store, spark.createDataFrame([row, row], SCHEMA), spark.createDataFrame([], "opp_id string, message_id long, seq long"))
    assert store.version() == 1


def test_failure_publishes_nothing(spark, tmp_path, monkeypatch):
    """A derived table that cannot be made leaves the relation as it was, too."""
    store = Store(spark, f"{tmp_path}/s")
    row = some(random.Random(0), "o", 1, 0)
    I.bootstrap(store, spark.createDataFrame([row], SCHEMA), spark.createDataFrame([], FACT).drop("gone"))
    monkeypatch.setitem(I.DERIVED, "spread", lambda r: spread(r).withColumn("spus", F.raise_error(F.lit("boom")).cast("long")))
    with pytest.raises(Exception, match="boom"):
        I.refresh(store, spark.createDataFrame([some(random.Random(1), "o", 2, 0)], SCHEMA), spark.createDataFrame([], "opp_id string, message_id long, seq long"))
    assert store.version() == 1 and store.at().read("relation").count() == 1
