import pytest

from echoloom.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import both, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    got, want = both(spark, duck(SF), SF, QUERIES[name], ORACLE_SQL[name])
    assert got == want and got


def test_pipeline(spark):
    """Each stage's decisions, held against the operators' brute-force twins on its own input."""
    import corpus_pipeline as p

    from .helpers import alnum
    from .test_near_and_models import shingles

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = []
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = {r["doc_id"]: r["text"] for r in out.collect()}
        stages.append(rows)
        docs = spark.createDataFrame(out.collect(), docs.schema)
    before = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(stages[0]) <= set(before) and len(stages[0]) > 0.5 * len(before)
    assert set(stages[1]) == set(stages[0])
    sets = {d: shingles(t, 5) for d, t in stages[1].items()}
    linked = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    for d in sets:
        if d not in stages[2]:
            assert any(linked(d, x) for x in sets if x != d)
    assert not any(linked(a, b) for a in stages[2] for b in stages[2] if a < b)
    items = [alnum(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + min(10, len(w))]) for w in items if w for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    for d, t in stages[2].items():
        w = alnum(t)
        assert (d in stages[3]) == (not any(tuple(w[i : i + k]) in windows for k in sizes for i in range(len(w) - k + 1)))
    total = sum(r["length"] for r in p.run(spark, SF).select("length").collect())
    assert total >= sum(len(t or "") for t in stages[3].values()) / 8
