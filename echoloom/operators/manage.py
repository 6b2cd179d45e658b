"""Decisions and their write-back: saving opportunities, merges and splits, status changes, rules of the write layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .core import low_star_rate
from .lifecycle import merge_evidence

#: Confidences from which a gap passes and from which it needs no second look.
PASS, SURE = 0.4, 0.6
PLACEHOLDER = "未命名模式"


def save_plan(new: DataFrame, known: DataFrame, canonical: DataFrame) -> DataFrame:
    """(opp_id, action, target) for each new record, in one join on its id.

    An id that is not known is ``create``; a known one is ``attach`` to the root of its merge chain, or ``update`` if
    that is itself. A safety-relevant root refuses to be attached to by way of a merge (``refuse``); an id whose chain
    has no root is ``broken``.
    """
    roots = canonical.select("opp_id", "root", "state").withColumnRenamed("state", "chain")
    rows = new.select("opp_id").join(roots, "opp_id", "left")
    risky = known.where("safety").select(F.col("opp_id").alias("root"), F.lit(True).alias("risky"))
    rows = rows.join(risky, "root", "left")
    moved = F.col("root") != F.col("opp_id")
    action = F.when(F.col("chain").isNull(), "create").when(F.col("chain") != "ok", "broken").when(moved & F.coalesce("risky", F.lit(False)), "refuse").when(moved, "attach").otherwise("update")
    return rows.select("opp_id", action.alias("action"), F.when(action == "create", F.col("opp_id")).when(action.isin("attach", "update"), F.col("root")).alias("target"))


def upsert_status(old: DataFrame, change: DataFrame, key: list[str]) -> DataFrame:
    """Human status rows after ``change``: given fields win, others stay; a full join, so new keys appear.

    A change to ``dismissed`` keeps the baseline that was captured first; closed_at is set on closing and cleared on
    reopening.
    """
    o, c = old.select(*key, *[F.col(x).alias(f"o_{x}") for x in ("status", "note", "baseline", "closed_at")]), change.select(*key, *[F.col(x).alias(f"c_{x}") for x in ("status", "note", "baseline", "at")])
    rows = o.join(c, key, "full")
    status = F.coalesce("c_status", "o_status")
    closed = status.isin("done", "dismissed")
    fresh = F.col("c_status").isNotNull() & ~F.col("o_status").eqNullSafe(F.col("c_status"))
    return rows.select(
        *key,
        status.alias("status"),
        F.coalesce("c_note", "o_note").alias("note"),
        F.when(status == "dismissed", F.coalesce("o_baseline", "c_baseline")).otherwise(F.col("o_baseline")).alias("baseline"),
        F.when(closed & fresh, F.col("c_at")).when(closed, F.col("o_closed_at")).alias("closed_at"),
    )


def change_errors(change: DataFrame, issues: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """(key, error) of status changes that must not be written: unknown issue, unknown status, dismissal without note."""
    rows = change.join(issues.select("spu", "opp_id").withColumn("_known", F.lit(True)), ["spu", "opp_id"], "left")
    error = (
        F.when(~F.coalesce("status", F.lit("")).isin(*statuses), "unknown status")
        .when(F.col("_known").isNull(), "unknown issue")
        .when((F.col("status") == "dismissed") & (F.coalesce(T.strip(F.col("note")), F.lit("")) == ""), "no note")
    )
    return rows.select("spu", "opp_id", error.alias("error")).where("error IS NOT NULL")


def merges_allowed(proposals: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Accepted merges (proposal_id, opp_ids) that a machine may run: none with a safety-relevant side."""
    risky = opportunities.where("safety").select("opp_id")
    bad = proposals.select("proposal_id", F.explode("opp_ids").alias("opp_id")).join(risky, "opp_id", "left_semi").select("proposal_id").distinct()
    return proposals.where("op = 'MERGE'").join(bad, "proposal_id", "left_anti")


def merge_pairs(merges: DataFrame, opportunities: DataFrame) -> DataFrame:
    """(proposal_id, source, target): the target is the payload's, or the side with the earliest first week, ties by id."""
    sides = merges.select("proposal_id", "target", F.explode("opp_ids").alias("opp_id")).join(opportunities.select("opp_id", "first_week"), "opp_id")
    chosen = sides.groupBy("proposal_id").agg(F.coalesce(F.max("target"), F.min_by("opp_id", F.struct("first_week", "opp_id"))).alias("target"))
    return sides.select("proposal_id", F.col("opp_id").alias("source")).join(chosen, "proposal_id").where("source <> target")


def execute_merges(relation: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(relation, counts, lineage) after merges; run again it changes nothing."""
    after = merge_evidence(relation, pairs.select("source", "target"))
    counts = after.groupBy("opp_id").agg(F.count(F.lit(1)).alias("evi_total"), F.count_if(F.col("match_by") == "merge").alias("merged"))
    lineage = pairs.select(F.col("source").alias("opp_id"), F.col("target").alias("parent"), F.lit("MERGE").alias("op"), "proposal_id")
    return after, counts, lineage


def execute_splits(splits: DataFrame, manual: DataFrame, opportunities: DataFrame, automatic: bool = False) -> DataFrame:
    """Lineage of accepted splits; with ``automatic`` also of pending ones that no person has touched and that are no safety matter."""
    touched = manual.select("opp_id")
    risky = opportunities.where("safety").select("opp_id")
    rows = splits.select("proposal_id", "status", F.get("opp_ids", F.lit(0)).alias("opp_id"))
    done = rows.where("status = 'accepted'")
    if automatic:
        done = done.unionByName(rows.where("status = 'pending'").join(touched, "opp_id", "left_anti").join(risky, "opp_id", "left_anti").select(rows.columns))
    return done.select("opp_id", F.lit(None).cast("string").alias("parent"), F.lit("SPLIT").alias("op"), "proposal_id")


def tombstones(opportunities: DataFrame, manual: DataFrame) -> DataFrame:
    """Opportunities a person has dismissed; a missing human row means considering, so it is none."""
    return opportunities.join(manual.where("status = 'dismissed'").select("opp_id"), "opp_id", "left_semi")


def tombstone_hits(new: DataFrame, dead: DataFrame) -> DataFrame:
    """(id, opp_id): dismissed items of the same type and tag; safety-relevant new items are let through."""
    keys = dead.select(F.col("opp_type").alias("t"), F.col("tag").alias("g"), "opp_id")
    return new.where(~F.coalesce("safety", F.lit(False))).join(keys, (F.col("opp_type") == F.col("t")) & (F.col("tag") == F.col("g"))).select("id", "opp_id")


def release_rows(recounted: DataFrame, opportunities: DataFrame, top: int = 50) -> DataFrame:
    """(opp_id, reason) of what leaves the backlog: safety, several sources, or one of the ``top`` by rank.

    The top is a sorted limit, so no window ranks all opportunities in one task.
    """
    rows = recounted.join(opportunities.where("backlog AND state = 'valid'").select("opp_id", "safety"), "opp_id")
    best = rows.orderBy(F.desc_nulls_last("rank_score"), "opp_id").limit(top).select("opp_id", F.lit(True).alias("best"))
    reason = F.when(F.col("safety"), "safety").when(F.col("dual_source"), "dual_source").when(F.coalesce("best", F.lit(False)), "rank")
    return rows.join(best, "opp_id", "left").select("opp_id", reason.alias("reason")).where("reason IS NOT NULL")


def intent(text: Column, cues: dict[str, tuple[str, ...]]) -> Column:
    """Offline classifier: struct(intent, confidence) by the cue words a text holds; ``other`` with nothing."""
    count = lambda words: F.size(F.array_compact(F.array(*[F.when(F.lower(text).contains(w), F.lit(w)) for w in words])))
    scores = F.array(*[F.struct(count(ws).alias("n"), F.lit(-i).alias("first"), F.lit(k).alias("intent")) for i, (k, ws) in enumerate(cues.items())])
    best, total = F.array_max(scores), F.aggregate(scores, F.lit(0), lambda a, x: a + x["n"])
    none = F.coalesce(total, F.lit(0)) == 0
    return F.struct(F.when(none, "other").otherwise(best["intent"]).alias("intent"), F.when(none, 0.0).otherwise(best["n"] / total).alias("confidence"))


def intent_gate(rows: DataFrame, found: Column) -> DataFrame:
    """Rows with intent, confidence and whether they pass (a gap, sure enough) and need a person's look (not sure enough)."""
    out = rows.withColumn("_intent", found).withColumns({"intent": F.col("_intent.intent"), "confidence": F.round("_intent.confidence", 6)}).drop("_intent")
    passes = (F.col("intent") == "gap") & (F.col("confidence") >= PASS)
    return out.withColumns({"passes": passes, "needs_review": passes & (F.col("confidence") < SURE)})


def specific_mode(*candidates: Column, title: Column) -> Column:
    """The first candidate that states a problem, else the title; placeholders are none."""
    from ..functions.validators import specific

    return F.coalesce(*[F.when(specific(c) & (T.strip(c) != PLACEHOLDER), T.strip(c)) for c in candidates], title)


def topic(tag: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(tag), F.lit("")), fallback)


def bucket_context(pool: DataFrame, by: list[str]) -> DataFrame:
    """Category (one, cross or undetermined), modal tax path, low-star rate and product line of each bucket."""
    n = F.count_distinct("category")
    return pool.groupBy(*by).agg(
        F.when(n == 0, "undetermined").when(n == 1, F.max("category")).otherwise("cross").alias("category"),
        F.expr("mode() WITHIN GROUP (ORDER BY tax_path)").alias("tax_path"), low_star_rate("star").alias("low_star_rate"),
        T.prod_line(F.array_sort(F.collect_set("prod_line"))).alias("prod_line"),
    )


def expected_against_actual(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Full join of two count tables: keys that differ, with both counts (null where one side has none)."""
    rows = expected.select(*key, F.col("n").alias("expected")).join(actual.select(*key, F.col("n").alias("actual")), key, "full")
    return rows.where(~F.col("expected").eqNullSafe(F.col("actual")))


def costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and cost by model; a model without a price has no cost and is flagged."""
    rows = calls.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out")).join(F.broadcast(prices), "model", "left")
    cost = F.round(F.col("tokens_in") * F.col("price_in") / 1e6 + F.col("tokens_out") * F.col("price_out") / 1e6, 6)
    return rows.select("model", "calls", "tokens_in", "tokens_out", cost.alias("cost"), F.col("price_in").isNull().alias("unknown"))


def account_rows(scope: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """(kind, n): rows of a scope that no outcome accounts for, outcomes beyond the scope, and rows accounted for twice."""
    missing = scope.select(*key).distinct().join(done.select(*key), key, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("missing").alias("kind"), "n")
    beyond = done.select(*key).distinct().join(scope.select(*key), key, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("beyond").alias("kind"), "n")
    twice = done.groupBy(*key).count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("twice").alias("kind"), "n")
    return missing.unionByName(beyond).unionByName(twice)


def backfills(runs: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """Partitions with whether their run is a backfill: older than ``days``, or one of several in a run."""
    several = runs.groupBy("run_id").agg((F.count_distinct("week_start") > 1).alias("several"))
    return runs.join(several, "run_id").select("run_id", "week_start", (F.col("several") | (F.date_diff(F.lit(as_of).cast("date"), "week_start") > days)).alias("backfill"))
