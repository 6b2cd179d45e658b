"""Queries over the neighbour index: filtered search, cross-source evidence, a refreshed cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import neighbour_index as N
from ..operators.core import iso_week
from ..operators.resolve import cross_source
from ..sources.fixtures import read
from .queries import query

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")

#: Items are the embeddings. Most have evidence from one of five sources, that of their label, so near items tend to
#: share it; every sixth has another one, and each tenth message goes to an item of the next source as well.
ITEMS = """items AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY opp_id) - 1 AS pos, count(*) OVER (PARTITION BY src) AS of FROM (
  SELECT vec_id AS opp_id, CASE label % 2 WHEN 0 THEN 'existing_product' ELSE 'innovation' END AS opp_type, vec_id % 17 <> 3 AND vec_id % 19 <> 5 AS active, CASE WHEN vec_id % 23 <> 7 THEN embedding::DOUBLE[] END AS vec,
         CASE WHEN vec_id % 6 = 0 THEN vec_id // 6 ELSE label END % 5 AS src FROM embeddings)),
mentions AS (SELECT *, (o_orderpriority[1]::BIGINT - 1) AS s FROM orders),
attached AS (SELECT opp_id, o_orderkey AS message_id, s, o_orderkey, o_orderpriority FROM mentions JOIN items ON s = src AND o_orderkey % of = pos
  UNION ALL SELECT opp_id, o_orderkey, s, o_orderkey, o_orderpriority FROM mentions JOIN items ON (s + 1) % 5 = src AND o_orderkey % of = pos WHERE o_orderkey % 10 = 0),
relation AS (SELECT opp_id, e.message_id, e.seq, o_orderpriority AS src_line, len(m.spu) > 0 AS has_spu, requires_spu FROM attached a JOIN evidence e ON e.message_id = a.message_id JOIN message m ON m.message_id = a.message_id JOIN policy p ON p.src_line = m.src_line)"""


def _items(s: SparkSession, d: str) -> DataFrame:
    k = F.col("vec_id")
    src = F.when(k % 6 == 0, F.floor(k / 6)).otherwise(F.col("label")) % 5
    return read(s, d, "embeddings").select(
        k.alias("opp_id"), F.when(F.col("label") % 2 == 0, "existing_product").otherwise("innovation").alias("opp_type"), F.when(k % 17 != 3, "valid").otherwise("invalid").alias("state"),
        F.when(k % 19 == 5, k + 1).alias("merged_into"), F.when(k % 23 != 7, F.col("embedding")).alias("vec"), src.cast("long").alias("src"),
        F.concat(F.lit("mode "), k.cast("string")).alias("mode"), F.concat(F.lit("title "), k.cast("string")).alias("title"), F.array(F.concat(F.lit("voice "), k.cast("string"))).alias("snippets"),
    )


def _relation(s: SparkSession, d: str, items: DataFrame) -> DataFrame:
    from ..sources.fixtures import evidence, message, policy

    of = items.groupBy("src").agg(F.count(F.lit(1)).alias("of"))
    placed = items.select("opp_id", "src", (F.row_number().over(W.partitionBy("src").orderBy("opp_id")) - 1).cast("long").alias("pos"))
    source = F.substring("o_orderpriority", 1, 1).cast("long") - 1
    spoken = read(s, d, "orders").select(F.col("o_orderkey").alias("message_id"), F.col("o_orderpriority").alias("priority"), F.explode(F.when(F.col("o_orderkey") % 10 == 0, F.array(source, (source + 1) % 5)).otherwise(F.array(source))).alias("src"))
    told = spoken.join(F.broadcast(of), "src").withColumn("pos", F.col("message_id") % F.col("of")).join(placed, ["src", "pos"])  # five sources
    rows = told.select("opp_id", "message_id", "priority").join(message(s, d).select("message_id", "src_line", "spu"), "message_id").join(F.broadcast(policy(s)), "src_line")
    return rows.join(evidence(s, d).select("message_id", "seq"), "message_id").select("opp_id", "message_id", "seq", F.col("priority").alias("src_line"), "spu", "requires_spu")


@query("""SELECT opp_id, message_id, seq, arg_min(neighbor_id, turn) AS neighbor_id, attach_week, 'cross_line' AS match_by, arg_min(confidence, turn) AS confidence FROM (
 SELECT c.opp_id, c.neighbor_id, r.message_id, r.seq, '2001-W26' AS attach_week, round(least(0.5 + similarity, 0.999), 3) AS confidence, row_number() OVER (PARTITION BY c.opp_id ORDER BY place, r.message_id, r.seq) AS turn
 FROM chosen c JOIN relation r ON r.opp_id = c.neighbor_id WHERE similarity >= 0.1
  AND NOT EXISTS (SELECT 1 FROM own WHERE own.opp_id = c.opp_id AND own.src_line = r.src_line)
  AND NOT EXISTS (SELECT 1 FROM relation x WHERE x.opp_id = c.opp_id AND x.message_id = r.message_id AND x.seq = r.seq)
  AND c.opp_type = CASE WHEN r.has_spu THEN 'existing_product' WHEN NOT r.requires_spu THEN 'innovation' END)
 WHERE turn <= 40 GROUP BY ALL""", ITEMS, """own AS (SELECT DISTINCT opp_id, src_line FROM relation),
near AS (SELECT a.opp_id, a.opp_type, b.opp_id AS neighbor_id, 1 - list_cosine_distance(a.vec, b.vec) AS sim FROM items a JOIN items b ON a.opp_type = b.opp_type AND a.opp_id <> b.opp_id
  WHERE a.vec IS NOT NULL AND b.vec IS NOT NULL AND b.active AND EXISTS (SELECT 1 FROM own x WHERE x.opp_id = b.opp_id AND NOT EXISTS (SELECT 1 FROM own y WHERE y.opp_id = a.opp_id AND y.src_line = x.src_line))),
chosen AS (SELECT * FROM (SELECT *, round(sim, 9) AS similarity, row_number() OVER (PARTITION BY opp_id ORDER BY round(1 - sim, 12), neighbor_id) AS place FROM near) WHERE place <= 5)""")
def cross_source_evidence(s, d):
    """For each item, rows of its five nearest valid items of the type that have a source the item lacks: forty at most."""
    items = _items(s, d)
    judge = lambda pairs: pairs.withColumns({"same": F.col("similarity") >= 0.1, "confidence": 0.5 + F.col("similarity")})
    week = s.range(1).select(iso_week(F.lit("2001-06-30").cast("timestamp"))).first()[0]
    return cross_source(items, _relation(s, d, items), week, judge)


DIST_NOW = """now AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 37 <> 5),
dist AS (SELECT a.vec_id, b.vec_id AS neighbor_id, round(list_cosine_distance(a.v, b.v), 12) AS distance FROM now a JOIN now b ON a.label = b.label AND a.vec_id <> b.vec_id)"""


@query("SELECT vec_id AS opp_id, neighbor_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS place FROM dist) WHERE place = 1", DIST_NOW)
def neighbour_cache(s, d):
    """The cache of nearest neighbours after a refresh: every tenth vector was another one (its entries reversed) when the cache was
    built, every thirteenth was not there, and some that were there went. Equal to a full recompute."""
    k, none = F.col("vec_id"), F.array().cast("array<string>")
    rows = read(s, d, "embeddings").select(F.col("label").alias("grp"), k.alias("id"), F.col("embedding").cast("array<double>").alias("vec"), none.alias("tags"))
    i = F.col("id")
    before = rows.where(i % 13 != 6).withColumn("vec", F.when(i % 10 == 0, F.reverse("vec")).otherwise(F.col("vec")))
    gone = i % 37 == 5
    index = N.build(before)
    _, cache = N.refresh(index, N.nearest_cache(index), rows.where(((i % 10 == 0) | (i % 13 == 6)) & ~gone), rows.where(gone).select("id"))
    return cache.select(i.alias("opp_id"), "neighbor_id", F.round("distance", 6).alias("distance"))


@query()
def indexed_neighbours(s, d):
    """The nearest of each vector by probing cells of the index alone: approximate; a test holds its recall."""
    rows = N.standard(read(s, d, "embeddings"), "vec_id", "label", "embedding")
    index = N.build(rows)
    found = N.search(index, rows, 1, probes=max(4, len(index.pivots) // 2))
    return found.select(F.col("id").alias("vec_id"), "neighbor_id", F.round("distance", 6).alias("distance"))
