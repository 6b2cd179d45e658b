from datetime import datetime

import pytest
from pyspark.sql import functions as F

from echoloom.operators import ingest as I
from echoloom.operators import manage as M
from echoloom.operators import services as S
from echoloom.operators import write as W
from echoloom.operators.cluster import batches
from echoloom.operators.generate import generate
from echoloom.plans.queries import _pool
from echoloom.sources import slices as SL
from echoloom.streaming.weekly import growth_alerts, rolling_counts, stale_alerts

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_embedding(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, None), (4, ""), (5, "xyz")], "id int, t string")
    got = {r["id"]: r["vec"] for r in S.embedded(df, "t").collect()}
    assert got[1] == got[2] != got[5] and got[3] is None and not any(got[4]) and len(got[1]) == S.DIMENSION
    assert sum(x * x for x in got[1]) == pytest.approx(1)
    for bad in (lambda ts: [[1.0]] * (len(ts) + 1), lambda ts: [[1.0] * (1 + i) for i, _ in enumerate(ts)]):
        with pytest.raises(Exception, match="vectors"):
            S.embedded(df.coalesce(1), "t", service=bad).collect()
    v = spark.createDataFrame([("[1, 2.5]",), ("x",), (None,)], "c string").select(S.parsed_vector(F.col("c")))
    assert [r[0] for r in v.collect()] == [[1.0, 2.5], None, None]


def test_answers(spark):
    told = [("```json\n{\"a\": 1}\n```", '{"a": 1}'), ("{\"b\": 1}", None), ("no", None), ("so: {\"a\": {\"b\": 2}} done", '{"a": {"b": 2}}'), ("{bad", None), (None, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(told)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(S.json_answer(F.col("t"), ("a",))).collect()] == [w for _, w in told]
    service = lambda prompts, budget: ['{"a": %d}' % budget if "ok" in p or budget > 100 else "cut off {" for p in prompts]
    asked = spark.createDataFrame([("ok",), ("long",)], "p string")
    assert rows(S.answered(asked, "p", service, ("a",), 100)) == [("long", '{"a": 200}'), ("ok", '{"a": 100}')]


def test_merged_modes(spark):
    near, far = [1.0, 0.0], [0.0, 1.0]
    df = spark.createDataFrame([("b", 0, "leg breaks", 10, near), ("b", 1, "leg snaps", 10, near), ("b", 2, "unnamed", 1, near), ("b", 3, "leg cracks", 25, near), ("b", 4, "loud", 5, far), ("c", 0, "leg breaks", 1, near)], "bucket string, grp long, mode string, n long, vec array<double>")
    assert rows(S.merged_modes(df)) == [("b", 0, 0), ("b", 1, 0), ("b", 2, 2), ("b", 3, 3), ("b", 4, 4), ("c", 0, 0)]
    assert rows(S.merged_modes(df, same=lambda a, b: False)) == [("b", i, i) for i in range(5)] + [("c", 0, 0)]


def test_tables(spark):
    def table(data):
        return spark.createDataFrame(data, "message_id long, src_line string")

    spark.sql("DROP TABLE IF EXISTS kept_messages")
    W.guarded_messages(spark, "kept_messages", table([(1, "a"), (2, "b")]))
    W.guarded_messages(spark, "kept_messages", table([(2, "b"), (3, "a")]))
    assert rows(spark.table("kept_messages")) == [(1, "a"), (2, "b"), (3, "a")]
    for bad in ([(1, "b")], [(None, "a")], [(7, "a"), (7, "b")]):
        with pytest.raises(ValueError, match="refused"):
            W.guarded_messages(spark, "kept_messages", table(bad))
    with pytest.raises(ValueError, match="repeated"):
        W.upsert_table(spark, "kept_messages", table([(9, "a"), (9, "a")]), ["message_id"])
    assert spark.table("kept_messages").count() == 3
    W.clear_machine_layer(spark, ["kept_messages", "no_such_table"])
    assert spark.table("kept_messages").count() == 0
    spark.sql("DROP TABLE kept_messages")


def test_source_windows(spark):
    a, b = datetime(2024, 1, 1), datetime(2024, 1, 25)
    grid = SL.slice_grid(spark, "2024-01-01", "2024-01-25", 10)
    assert [tuple(r) for r in grid.orderBy("slice_start").collect()] == SL.slices(a, b, 10)
    assert SL.slices(b, a, 10) == [] and SL.slice_grid(spark, "2024-01-25", "2024-01-01", 10).count() == 0
    with pytest.raises(RuntimeError, match="no rows"):
        SL.plan(a, b, 10, lambda x, y: 0, incremental=True)
    assert len(SL.plan(a, b, 10, lambda x, y: 0)) == 3
    got = SL.read_window(SL.slices(a, b, 10), lambda x, y: spark.createDataFrame([(x.day,)], "day int"))
    assert rows(got) == [(1,), (11,), (21,)] and {s.slice_days for s in SL.SOURCES} == {30, 15}
    df = spark.createDataFrame([("a\x00b\x0bc\td",)], "t string")
    assert df.select(I.repaired(F.col("t"))).first()[0] == "abc\td"


def test_batch_orders(spark):
    df = spark.createDataFrame([("b", i, i % 3 or None) for i in range(12)], "bucket string, item long, star long")
    first = {o: sorted(r["item"] for r in batches(df, "bucket", "item", "star", 4, o).where("batch = 0").collect()) for o in ("star", "reverse", "hash")}
    assert first["star"] == [1, 4, 7, 10] and first["reverse"] == [0, 3, 6, 9] and first["hash"] != first["star"]


def test_modes_and_topics(spark):
    df = spark.createDataFrame([("未命名模式", "支撑腿在承重下断裂", "t"), ("断裂", None, "t"), (None, "其他类", "t")], "a string, b string, t string")
    assert [r[0] for r in df.select(M.specific_mode(F.col("a"), F.col("b"), title=F.col("t"))).collect()] == ["支撑腿在承重下断裂", "t", "t"]
    assert [r[0] for r in spark.createDataFrame([(" ", "x"), ("y", "x"), (None, "x")], "a string, b string").select(M.topic(F.col("a"), F.col("b"))).collect()] == ["x", "y", "x"]


def test_generation(spark):
    """Every row of the pool is in one record; a second run on what the first one saved only updates."""
    pool = _pool(spark, SF).where("message_id % 7 = 0")
    none = spark.createDataFrame([], "opp_id string, root string, state string, safety boolean")
    records, plan, ledger = generate(pool, none, none)
    n = pool.count()
    assert ledger.first()["balanced"] and ledger.first()["completed"] == n == records.agg(F.sum("evi_total")).first()[0]
    assert {r["action"] for r in plan.collect()} == {"create"} and plan.count() == records.count()
    chain = records.select("opp_id", F.col("opp_id").alias("root"), F.lit("ok").alias("state")).distinct()
    again = generate(pool, records.select("opp_id", F.lit(False).alias("safety")), chain)[1]
    assert {r["action"] for r in again.collect()} == {"update"}


def test_stateful_streams(spark, tmp_path):
    schema = "k string, ts timestamp, base long"
    days = [("a", f"2024-01-{d:02} 00:00:00", 2) for d in range(1, 8)] + [("b", "2024-01-03 00:00:00", 5), ("c", "2024-06-01 00:00:00", 1)]
    data = spark.createDataFrame(days, "k string, t string, base long").select("k", F.col("t").cast("timestamp").alias("ts"), "base")
    data.repartition(1).sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")

    def run(make, name, mode):
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return rows(spark.table(name))

    assert run(lambda s: growth_alerts(s, "k", "base"), "growth", "append") == [("a", 7)]
    assert run(lambda s: stale_alerts(s, "k", "ts"), "stale", "append") == [("a", datetime(2024, 1, 7)), ("b", datetime(2024, 1, 3))]
    rolled = run(lambda s: rolling_counts(s, "ts", ["k"], 3), "rolling", "complete")
    assert (datetime(2024, 1, 4), "a", 3) in rolled and (datetime(2024, 1, 4), "b", 1) in rolled
