"""Connected components over edge tables, without collecting edges or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

MAX_ROUNDS = 64


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; a component is named by its smallest node.

    Alternates large-star and small-star steps, each an aggregate and a join, until no edge changes: about
    log2 of the longest path rounds. Each round is settled in the shared folder. Self loops and null ends are
    ignored (a null end links nothing). Empty edges give an empty result.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    pairs = settle(pairs.distinct(), "cc-edges")
    # u > v in every row.
    last = _digest(pairs)
    for _ in range(MAX_ROUNDS):
        if last[0] == 0:
            break
        # Large star: each larger neighbour of a node is tied to the node's smallest neighbour (or itself).
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = settle(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "cc-low")
        large = pairs.join(low.select(F.col("u").alias("v"), "m"), "v").select("u", F.col("m").alias("v"))
        large = settle(large.distinct(), "cc-large")
        # Small star: the smaller neighbours of a node, and the node, are tied to the smallest of them.
        low = settle(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = settle(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc-edges")
        now = _digest(pairs)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components have not settled after {MAX_ROUNDS} rounds")
    roots = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _digest(pairs: DataFrame) -> tuple:
    """Row count and an order-free checksum: equal for equal edge sets."""
    row = pairs.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]
