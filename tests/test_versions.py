import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from echoloom.sources.versions import ConcurrentCommitError, Store


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frame(spark, data):
    return spark.createDataFrame(data, "id long, v string")


def test_commit_is_all_or_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.version() == 0 and store.at().tables() == []
    with store.begin() as c:
        c.write("one", frame(spark, [(1, "a")]))
        c.write("two", frame(spark, [(1, "x"), (2, "y")]), ["id"])
    assert c.version == store.version() == 1
    boom = F.raise_error(F.lit("boom")).cast("string")
    with pytest.raises(Exception, match="boom"), store.begin() as c:
        c.write("one", frame(spark, [(9, "z")]))
        assert rows(c.read("one")) == [(9, "z")]
        c.write("two", frame(spark, [(1, "x")]).withColumn("v", boom), ["id"])
    assert store.version() == 1 and rows(store.at().read("one")) == [(1, "a")] and rows(store.at().read("two")) == [(1, "x"), (2, "y")]
    with pytest.raises(Exception, match="no table"):
        store.at().read("three")


def test_killed_between_two_tables(spark, tmp_path):
    """A process that dies after the first of two writes leaves the old state of both."""
    store = Store(spark, str(tmp_path))
    with store.begin() as c:
        c.write("one", frame(spark, [(1, "a")]))
        c.write("two", frame(spark, [(1, "b")]))
    code = f"""
        import os, sys
        sys.path.insert(0, {os.getcwd()!r})
        from pyspark.sql import SparkSession
        from echoloom.sources.versions import Store
        s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        with Store(s, {str(tmp_path)!r}).begin() as c:
            c.write("one", s.createDataFrame([(2, "new")], "id long, v string"))
            print("WRITTEN", flush=True)
            os._exit(9)
    """
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_GATEWAY")}
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, env=env, timeout=240)
    assert out.returncode == 9 and "WRITTEN" in out.stdout
    now = store.at()
    assert now.version == 1 and rows(now.read("one")) == [(1, "a")] and rows(now.read("two")) == [(1, "b")]
    assert len(os.listdir(tmp_path / "one")) == 2  # what it wrote is there, and no version names it
    assert store.vacuum() == 1 and len(os.listdir(tmp_path / "one")) == 1
    with store.begin() as c:
        c.write("one", frame(spark, [(3, "c")]))
    assert rows(store.at().read("one")) == [(3, "c")] and rows(store.at().read("two")) == [(1, "b")]


def test_readers_keep_their_version(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    with store.begin() as c:
        c.write("t", frame(spark, [(i, "old") for i in range(50)]), ["id"], 8)
    pinned = store.at()
    with store.begin() as c:
        c.upsert("t", frame(spark, [(3, "new"), (99, "new")]))
    assert {v for _, v in rows(pinned.read("t"))} == {"old"} and pinned.read("t").count() == 50
    now = store.at()
    assert now.read("t").where("v = 'new'").count() == 2 and now.read("t").count() == 51
    touched = now.touched("t", frame(spark, [(3, ""), (99, "")]))
    assert all(now.files("t")[b] == p for b, p in pinned.files("t").items() if int(b) not in touched)
    assert any(now.files("t")[b] != p for b, p in pinned.files("t").items() if int(b) in touched)
    with store.begin() as c:
        c.upsert("t", frame(spark, [(3, "later"), (100, "later")]), update=False)
    assert ("later" in {v for i, v in rows(store.at().read("t")) if i == 3}) is False and store.at().read("t").count() == 52
    with pytest.raises(ValueError, match="repeated"), store.begin() as c:
        c.upsert("t", frame(spark, [(1, "a"), (1, "b")]))
    with pytest.raises(ValueError, match="not replaced"), store.begin() as c:
        c.replace("t", frame(spark, [(i, "x") for i in range(50)]), touched[:1])
    assert store.version() == 3 and rows(store.at(1).read("t")) == rows(pinned.read("t"))


def test_second_of_two_commits_is_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    first, second = store.begin(), store.begin()
    with first as c:
        c.write("t", frame(spark, [(1, "first")]))
    with pytest.raises(ConcurrentCommitError), second as c:
        c.write("t", frame(spark, [(1, "second")]))
    assert rows(store.at().read("t")) == [(1, "first")]


def test_empty_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    with store.begin() as c:
        c.write("plain", frame(spark, []))
        c.write("keyed", frame(spark, []), ["id"])
    assert store.at().read("plain").count() == store.at().read("keyed").count() == 0
    with store.begin() as c:
        c.upsert("keyed", frame(spark, [(1, "a")]))
        c.replace("keyed", frame(spark, []), list(range(32)))
    assert rows(store.at().read("keyed")) == [] and store.at().read("keyed").columns == ["id", "v"]
