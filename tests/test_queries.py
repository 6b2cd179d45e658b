import pytest

from echoloom.plans.queries import ORACLE_SQL, QUERIES

from .oracle import both, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    if name in ORACLE_SQL:
        got, want = both(spark, connection, SF, QUERIES[name], ORACLE_SQL[name])
        assert got == want and got
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_clusters_keep_all_rows(spark):
    df = QUERIES["bucket_clusters"](spark, SF)
    pool = QUERIES["generation_pool"](spark, SF)
    assert df.count() == sum(r["n"] for r in pool.collect())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
