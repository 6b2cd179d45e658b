"""Resolution of new items against known ones: exact candidates, nearest vectors, a judge, and the action that follows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.settled import settle
from .core import opp_type, rule_of, size0
from .neighbour_index import _column, build, other_tag, search, standard, units
from .vectors import adaptive_k

#: The most candidates that adaptive_k gives to the judge, and items of one side that meet in a task.
MOST_JUDGED, BLOCK = 10, 4096


def same_by_cosine(similarity: Column, least: float = 0.85) -> Column:
    """Offline judge of a pair."""
    return similarity >= least


def candidates(new: DataFrame, known: DataFrame, most: int = MOST_JUDGED, block: int = BLOCK) -> DataFrame:
    """(id, opp_id, similarity, place, safety, n): of the ``n`` known active items of a new item's type, tag and channel (null equals null)
    the ``most`` with the highest cosine, to nine places, ties by opp_id; those without one come last and are left out.

    The groups are dealt into blocks; a pair of blocks is one matrix product in a task, which the best of a row leave.
    """
    active = known.where("state = 'valid' AND merged_into IS NULL AND opp_type IS NOT NULL AND tag IS NOT NULL")
    group = F.to_json(F.struct("opp_type", "tag", "channel"))
    side = lambda rows, key: rows.select(group.alias("grp"), F.col(key).alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    counts = side(active, "opp_id").groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    told = lambda rows: rows.where("vec IS NOT NULL").withColumn("size", F.size("vec"))
    left, right = settle(told(side(new.where("opp_type IS NOT NULL AND tag IS NOT NULL"), "id")), "resolve-new"), settle(told(side(active, "opp_id")), "resolve-known")
    blocks = lambda rows, name: rows.groupBy("grp", "size").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias(name))
    both = settle(blocks(left, "rows").join(blocks(right, "columns"), ["grp", "size"]), "resolve-blocks")
    dealt = lambda rows, own, other, x, y, no: rows.join(F.broadcast(both) if both.count() <= 100_000 else both, ["grp", "size"]).select("grp", "size", F.pmod(F.xxhash64("id"), own).alias(x), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(y), F.lit(no).alias("side"), *[F.col("id").alias(c) if no == i else F.lit(None).cast(k).alias(c) for i, (c, k) in enumerate((("id", kind), ("opp_id", "string")))], "vec")
    kind = dict(new.dtypes)["id"]
    rows = dealt(left, "rows", "columns", "x", "y", 0).unionByName(dealt(right, "columns", "rows", "y", "x", 1))

    def best(t: pa.Table) -> pa.Table:
        side = t["side"].to_numpy()
        asked, found = t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1)).sort_by("opp_id")
        at, to, of = [], [], []
        if asked.num_rows and found.num_rows:
            u, v = units(_column(asked, "vec")), units(_column(found, "vec"))
            for begin in range(0, len(u), 256):
                d = u[begin : begin + 256] @ v.T
                least = np.partition(d, max(0, len(v) - most), axis=1)[:, max(0, len(v) - most)]
                r, c = np.divmod(np.flatnonzero(d >= least[:, None] - 2e-9), len(v))
                s = np.round(d[r, c], 9)
                order = np.lexsort((c, -s, r))
                r, c, s = r[order], c[order], s[order]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < most
                at.append(r[keep] + begin)
                to.append(c[keep])
                of.append(s[keep])
        at, to, of = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((at, "int64"), (to, "int64"), (of, "float64")))
        return pa.table({"id": asked["id"].take(pa.array(at)), "opp_id": found["opp_id"].take(pa.array(to)), "similarity": pa.array(of)})

    # A told number of partitions is not coalesced: pairs of blocks are few rows and long work.
    pairs = both.agg(F.sum(F.col("rows") * F.col("columns"))).first()[0] or 1
    met = rows.repartition(int(min(max(pairs, 12), 2000)), "grp", "size", "x", "y").groupBy("grp", "size", "x", "y").applyInArrow(best, f"id {kind}, opp_id string, similarity double")
    safety = active.select("opp_id", "safety")
    groups = new.select("id", group.alias("grp")).join(counts, "grp").select("id", "n")
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "opp_id"))
    return met.withColumn("place", place).where(F.col("place") <= most).join(safety, "opp_id").join(groups, "id")


def resolve(new: DataFrame, known: DataFrame, judge: Callable[[Column], Column] = same_by_cosine) -> DataFrame:
    """(id, action, opp_id, proposals): attach to the best same item, create if there is none or the best is safety-relevant.

    Candidates are ranked by cosine and only the adaptive number of them is judged.
    """
    ranked = candidates(new, known).where(F.col("place") <= adaptive_k(F.col("n")))
    same = ranked.where(judge(F.col("similarity")))
    best = same.groupBy("id").agg(F.min_by(F.struct("opp_id", "safety"), "place").alias("best"), F.array_sort(F.collect_set("opp_id")).alias("all"))
    rows = new.select("id").join(best, "id", "left")
    create = F.col("best").isNull() | F.coalesce(F.col("best.safety"), F.lit(False))
    return rows.select("id", F.when(create, "create").otherwise("attach").alias("action"), F.when(~create, F.col("best.opp_id")).alias("opp_id"), F.coalesce(F.when(create, F.col("all")).otherwise(F.array_remove("all", F.col("best.opp_id"))), F.array().cast("array<string>")).alias("proposals"))


def judge_by_cosine(pairs: DataFrame, least: float = 0.85) -> DataFrame:
    """Offline judge of pairs (mode, title, snippets of both sides, similarity): adds ``same`` and ``confidence``."""
    return pairs.withColumns({"same": F.col("similarity") >= least, "confidence": F.col("similarity")})


def cross_source_candidates(items: DataFrame, relation: DataFrame, k: int = 5, exact: bool = True, probes: int = 8) -> DataFrame:
    """(opp_id, neighbor_id, similarity, place): for each item its ``k`` nearest valid items of the type, unmerged and with a
    vector, that have evidence from a source the item has none from. The filter comes before the limit: the index
    probes on until ``k`` items pass.

    ``items``: opp_id, opp_type, state, merged_into, vec; ``relation``: opp_id, src_line and evidence rows.
    """
    sources = relation.groupBy("opp_id").agg(F.array_sort(F.collect_set("src_line")).alias("sources"))
    rows = items.where("vec IS NOT NULL").join(sources, "opp_id", "left")
    vectors = settle(standard(rows.withColumn("state", F.coalesce("state", F.lit(""))), "opp_id", "opp_type", "vec", "sources"), "cross-items")
    active = rows.where("state = 'valid' AND merged_into IS NULL").select(F.col("opp_id").alias("id"))
    index = build(vectors.join(active, "id", "left_semi"))
    found = search(index, vectors, k, other_tag, probes=probes, exact=exact)
    return found.select(F.col("id").alias("opp_id"), "neighbor_id", F.round(1 - F.col("distance"), 9).alias("similarity"), "place")


def cross_source(items: DataFrame, relation: DataFrame, week: str, judge: Callable[[DataFrame], DataFrame] = judge_by_cosine, cap: int = 40, k: int = 5, least: float = 0.6, exact: bool = True) -> DataFrame:
    """Evidence for each item from near items of its type and from sources it lacks, as rows to attach.

    Of the ``k`` candidates of ``cross_source_candidates`` the judge, who sees texts and similarity of both sides, keeps
    those that are the same with a confidence of ``least`` or more. Their rows from sources that the item lacks, that
    the item does not hold yet and whose own class is the item's type are taken candidate by candidate, by message and
    number, until the item has ``cap``. A row that two candidates offer uses up two places and is returned once.

    ``items``: opp_id, opp_type, state, merged_into, vec, mode, title, snippets; ``relation``: opp_id, message_id, seq,
    src_line, spu, requires_spu.
    """
    told = ("mode", "title", "snippets")
    near = settle(cross_source_candidates(items, relation, k, exact), "cross-candidates")
    side = lambda key, letter: items.select(F.col("opp_id").alias(key), *[F.col(c).alias(f"{c}_{letter}") for c in told])
    pairs = near.join(side("opp_id", "a"), "opp_id").join(side("neighbor_id", "b"), "neighbor_id")
    same = judge(pairs).where(F.col("same") & (F.col("confidence") >= least)).select("opp_id", "neighbor_id", "place", "confidence")
    types = items.select("opp_id", "opp_type")
    offered = relation.withColumns({"neighbor_id": F.col("opp_id"), "type": opp_type(rule_of(size0("spu") > 0, ~F.col("requires_spu")))}).select("neighbor_id", "message_id", "seq", "src_line", "type")
    rows = same.join(types, "opp_id").join(offered, "neighbor_id").where("type = opp_type")
    rows = rows.join(relation.select("opp_id", "src_line").distinct(), ["opp_id", "src_line"], "left_anti")
    rows = rows.join(relation.select("opp_id", "message_id", "seq"), ["opp_id", "message_id", "seq"], "left_anti")
    turn = F.row_number().over(W.partitionBy("opp_id").orderBy("place", "message_id", "seq"))
    taken = rows.withColumn("turn", turn).where(F.col("turn") <= cap)
    once = taken.groupBy("opp_id", "message_id", "seq").agg(F.min_by(F.struct("neighbor_id", "confidence"), "turn").alias("x"))
    return once.select("opp_id", "message_id", "seq", "x.neighbor_id", F.lit(week).alias("attach_week"), F.lit("cross_line").alias("match_by"), F.round(F.least(F.col("x.confidence"), F.lit(0.999)), 3).alias("confidence"))
