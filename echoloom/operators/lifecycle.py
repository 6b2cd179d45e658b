"""Weekly lifecycle: snapshots, release, revival, staleness, splits, merges, canonical ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.settled import settle
from .core import by_spu
from .rank import numbered

STATUS_RANK = {"done": 4, "in_progress": 3, "considering": 2, "dismissed": 1}


def weekly_snapshot(opp_evidence: DataFrame) -> DataFrame:
    """(opp_id, week): rows of the week and all rows up to it."""
    weeks = opp_evidence.groupBy("opp_id", F.col("attach_week").alias("week")).agg(F.count(F.lit(1)).alias("evi_week"))
    return weeks.withColumn("evi_total", F.sum("evi_week").over(W.partitionBy("opp_id").orderBy("week").rowsBetween(W.unboundedPreceding, 0)))


def baseline_as_of(snapshot: DataFrame, events: DataFrame) -> DataFrame:
    """As-of join: for each (opp_id, event_week) the latest snapshot at or before that week, null where there is none.

    Both sides are put in one order per opportunity and the last snapshot is carried forward: one shuffle on the
    key, and no pairs of snapshots and events.
    """
    both = snapshot.select("opp_id", "week", F.struct("week", "evi_total").alias("snap"), F.lit(0).alias("kind")).unionByName(events.select("opp_id", F.col("event_week").alias("week"), F.lit(None).cast("struct<week:string,evi_total:bigint>").alias("snap"), F.lit(1).alias("kind")))
    order = W.partitionBy("opp_id").orderBy("week", "kind").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("snap", F.last("snap", ignorenulls=True).over(order)).where("kind = 1").select("opp_id", F.col("week").alias("event_week"), F.col("snap.week").alias("baseline_week"), F.col("snap.evi_total").alias("baseline"))


def revive_candidates(snapshot: DataFrame, events: DataFrame, pending: DataFrame, factor: int = 3, rejected: DataFrame | None = None) -> DataFrame:
    """Dismissed opportunities whose count has reached ``factor`` times the count at dismissal, unless one is pending.

    ``rejected`` (opp_id, decided_at, evi_at_reject) are revivals that were refused: the last one's count raises the
    baseline, so that the same growth is not put forward again. An opportunity without a count at dismissal is none.
    """
    now = snapshot.groupBy("opp_id").agg(F.max("evi_total").alias("current"))
    rows = baseline_as_of(snapshot, events).where("baseline > 0").join(now, "opp_id")
    if rejected is not None:
        # The latest decision counts; undated ones come before any dated one.
        last = rejected.groupBy("opp_id").agg(F.max_by("evi_at_reject", F.struct(F.col("decided_at").isNotNull(), "decided_at", F.coalesce("evi_at_reject", F.lit(0)))).alias("evi_at_reject"))
        rows = rows.join(last, "opp_id", "left").withColumn("baseline", F.greatest("baseline", F.coalesce("evi_at_reject", F.lit(0)))).drop("evi_at_reject")
    return rows.where(F.col("current") >= factor * F.col("baseline")).join(pending.select("opp_id"), "opp_id", "left_anti")


def release(recounted: DataFrame, top: int = 50) -> DataFrame:
    """Released: several sources, or among the ``top`` of the rest by rank."""
    return numbered(recounted, F.desc_nulls_last("rank_score"), "opp_id", name="place").select("opp_id", "place", (F.col("dual_source") | (F.col("place") <= top)).alias("released"))


def issue_revival(issues: DataFrame, manual: DataFrame, opp_evidence: DataFrame, factor: int = 3) -> DataFrame:
    """Dismissed issues at ``factor`` times their baseline; completed ones with feedback published after the release date."""
    met = issues.select("spu", "opp_id", "evi_count").join(manual, ["spu", "opp_id"])
    grown = met.where((F.col("status") == "dismissed") & (F.col("evi_count") >= factor * F.col("baseline_evi_count"))).select("spu", "opp_id", F.lit("growth").alias("reason"), F.col("evi_count").alias("n"))
    done = met.where("status = 'done'").select("spu", "opp_id", "release_date")
    later = by_spu(opp_evidence).join(done, ["spu", "opp_id"]).where(F.to_date("publish_time") > F.col("release_date"))
    again = later.groupBy("spu", "opp_id").agg(F.count(F.lit(1)).alias("n")).select("spu", "opp_id", F.lit("feedback").alias("reason"), "n")
    return grown.unionByName(again)


def stale(status: DataFrame, as_of, weeks: int = 8) -> DataFrame:
    return status.where((F.col("status") == "in_progress") & (F.col("updated_at") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(7 * weeks))))


def split_candidates(opp_evidence: DataFrame, share: float = 0.20, least: int = 8) -> DataFrame:
    """Opportunities whose rows outside their largest category are more than ``share``, of ``least`` rows and two categories."""
    counts = opp_evidence.where("category IS NOT NULL").groupBy("opp_id", "category").agg(F.count(F.lit(1)).alias("n"))
    out = counts.groupBy("opp_id").agg(F.sum("n").alias("total"), F.max("n").alias("major"), F.count(F.lit(1)).alias("categories"))
    minor = F.round((F.col("total") - F.col("major")) / F.col("total"), 6)
    return out.withColumn("minor_share", minor).where((F.col("minor_share") > share) & (F.col("total") >= least) & (F.col("categories") >= 2))


def merge_direction(a: Column, b: Column, locked: Column) -> Column:
    """Which of two statuses is the target of a merge; by hand where one is locked."""
    ranks = F.create_map(*[x for k, v in STATUS_RANK.items() for x in (F.lit(k), F.lit(v))])
    return F.when(locked, "manual").when(F.coalesce(ranks[a], F.lit(0)) >= F.coalesce(ranks[b], F.lit(0)), "first").otherwise("second")


def canonical(rows: DataFrame, depth: int = 20) -> DataFrame:
    """(opp_id, root, state) along ``merged_into``: ``ok``, ``cycle`` (or more than ``depth`` steps) or ``dangling``.

    Pointer jumping: each round doubles the distance that is followed, so ``depth`` steps take a handful of joins.
    Rounds are settled, as each one joins the last with itself. Only what fails has no root.
    """
    links = settle(rows.select("opp_id", F.coalesce("merged_into", "opp_id").alias("at"), F.col("merged_into").isNotNull().cast("int").alias("steps")), "canonical")
    reach = 1
    while reach <= depth:
        nxt = links.select(F.col("opp_id").alias("at"), F.col("at").alias("then"), F.col("steps").alias("more"))
        links = settle(links.join(nxt, "at", "left").select("opp_id", F.coalesce("then", "at").alias("at"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "canonical")
        reach *= 2
    ends = rows.select(F.col("opp_id").alias("at"), F.col("merged_into").isNull().alias("root"))
    out = links.join(ends, "at", "left")
    good = F.coalesce("root", F.lit(False)) & (F.col("steps") <= depth)
    state = F.when(F.col("root").isNull(), "dangling").when(good, "ok").otherwise("cycle")
    return out.select("opp_id", F.when(good, F.col("at")).alias("root"), state.alias("state"))


def merge_evidence(relation: DataFrame, merges: DataFrame) -> DataFrame:
    """Move relation rows to the merge targets, tagged ``merge``; rows that the target has already are kept there once.

    Run again on its own result it changes nothing.
    """
    moved = relation.join(merges.select(F.col("source").alias("opp_id"), "target"), "opp_id", "left")
    moved = moved.select(F.coalesce("target", "opp_id").alias("opp_id"), "message_id", "seq", F.when(F.col("target").isNotNull(), "merge").otherwise(F.col("match_by")).alias("match_by"), F.col("target").isNotNull().alias("moved"))
    first = W.partitionBy("opp_id", "message_id", "seq").orderBy("moved", "match_by")
    return moved.withColumn("turn", F.row_number().over(first)).where("turn = 1").drop("turn", "moved")
