"""Derived tables refreshed for touched keys: relation rows, recount, issues and spread by opportunity, product facts and containers
by product. Everything that one refresh changes is published as one version of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.settled import settle
from ..sources.versions import BUCKETS, Commit, Snapshot, Store
from .core import iso_week, recount, spread, spu_issue

#: A relation row's identity.
ROW = ["opp_id", "message_id", "seq"]
#: Derived tables by opportunity and how each is made from relation rows.
DERIVED = {"recount": recount, "issue": spu_issue, "spread": spread}


def product_facts(message: DataFrame, evidence: DataFrame, source: str = "commerce") -> DataFrame:
    """(spu, message_id) of a source's messages with what a container counts of each: its fields, negative and positive rows."""
    own = message.where(F.col("src_line") == source).select("message_id", "category", "star", "publish_time", "country", F.explode(F.array_distinct("spu")).alias("spu"))
    voices = evidence.groupBy("message_id").agg(F.count_if(F.col("sentiment") == "neg").alias("negative"), F.count_if(F.col("sentiment") == "pos").alias("positive"))
    return own.join(voices, "message_id", "left").fillna(0, ["negative", "positive"])


def containers(facts: DataFrame) -> DataFrame:
    """A row for each product, as spu_container() makes it from messages and evidence."""
    return facts.groupBy("spu").agg(
        F.count_distinct("message_id").alias("message_count"),
        F.expr("mode() WITHIN GROUP (ORDER BY category)").alias("category"),
        F.round(F.avg(F.col("star").cast("double")), 2).alias("avg_star"),
        F.array_join(F.array_sort(F.collect_set("country")), ",").alias("countries"),
        F.min(iso_week("publish_time")).alias("first_publish_week"),
        F.max(iso_week("publish_time")).alias("last_publish_week"),
        F.sum("negative").alias("negative_evi_count"),
        F.sum("positive").alias("positive_evi_count"),
    )


def canonical(chains: DataFrame, rounds: int = 32) -> DataFrame:
    """(loser, survivor): merges followed to their end, by doubling. A cycle is an error."""
    hops = settle(chains.select("loser", "survivor").distinct(), "merge-hops")
    for _ in range(rounds):
        step = hops.alias("a").join(hops.alias("b"), F.col("a.survivor") == F.col("b.loser"), "left")
        if step.where("b.loser IS NOT NULL").isEmpty():
            return hops
        hops = settle(step.select(F.col("a.loser").alias("loser"), F.coalesce("b.survivor", "a.survivor").alias("survivor")), "merge-hops")
    raise ValueError("merges lead in a circle")


def bootstrap(store: Store, relation: DataFrame, facts: DataFrame, buckets: int = BUCKETS) -> None:
    """All tables from nothing, in one commit."""
    with store.begin() as c:
        c.write("relation", relation, ["opp_id"], buckets)
        rows = c.read("relation")
        for name, make in DERIVED.items():
            c.write(name, make(rows), ["opp_id"], buckets)
        c.write("fact", facts, ["spu"], buckets)
        c.write("container", containers(c.read("fact")), ["spu"], buckets)


def _replace(c: Commit, table: str, keys: DataFrame, fresh: DataFrame, by: str) -> None:
    """Rows of ``keys`` out of their buckets and ``fresh`` rows in; rows of other keys of those buckets are kept."""
    here = Snapshot(c.store, c.base.version, c.manifest)
    buckets = here.touched(table, keys)
    kept = here.read(table, buckets).join(keys, by, "left_anti")
    c.replace(table, kept.unionByName(fresh.select(kept.columns)), buckets)


def refresh(store: Store, upserts: DataFrame, deletes: DataFrame, merges: DataFrame | None = None, facts: DataFrame | None = None) -> dict[str, list[int]]:
    """Bring the tables up to date; the buckets that were rewritten, by table.

    ``upserts`` are relation rows (new ones, or new values of known ones), ``deletes`` and ``merges`` name relation rows
    (opp_id, message_id, seq) and opportunities (loser, survivor): a loser's rows become its survivor's, a row that
    the survivor has already stays as the survivor's. ``facts`` are the product facts of all changed messages as they
    are now, with a column ``gone`` for those (spu, message_id) that are no more. Relation rows are read and derived rows
    computed for touched keys only; the result is that of computing everything anew. With nothing to do, no version
    is published.
    """
    spark: SparkSession = store.spark
    pairs = canonical(merges) if merges is not None else spark.createDataFrame([], "loser string, survivor string")
    pairs = settle(pairs, "refresh-merges")
    upserts = settle(upserts, "refresh-upserts")
    if not upserts.groupBy(*ROW).count().where("count > 1").isEmpty():
        raise ValueError(f"repeated rows {ROW}")
    changed = upserts.select("opp_id").unionByName(deletes.select("opp_id")).unionByName(pairs.select(F.explode(F.array("loser", "survivor")).alias("opp_id")))
    # A change that names a loser is the survivor's.
    led = changed.join(pairs, F.col("opp_id") == F.col("loser"), "left").select(F.explode(F.array("opp_id", F.coalesce("survivor", "opp_id"))).alias("opp_id"))
    touched = settle(led.where("opp_id IS NOT NULL").distinct(), "refresh-touched")
    changes: dict[str, list[int]] = {}
    with_opps, with_facts = not touched.isEmpty(), facts is not None and not facts.isEmpty()
    if not with_opps and not with_facts:
        return changes
    with store.begin() as c:
        if with_opps:
            here = c.base
            buckets = here.touched("relation", touched)
            old = here.read("relation", buckets).join(touched, "opp_id", "left_semi")
            old = old.join(deletes.select(*ROW).unionByName(upserts.select(*ROW)), ROW, "left_anti")
            now = old.unionByName(upserts.select(old.columns)).join(pairs, F.col("opp_id") == F.col("loser"), "left")
            now = now.withColumns({"_own": F.col("loser").isNull(), "_from": F.col("opp_id"), "opp_id": F.coalesce("survivor", "opp_id")}).drop("loser", "survivor")
            # Of equal rows the survivor's own stays, else that of the smallest loser.
            names = [x for x in old.columns if x not in ROW]
            first = now.groupBy(*ROW).agg(F.min_by(F.struct(*names), F.struct((~F.col("_own")).alias("o"), F.col("_from"))).alias("x"))
            rows = settle(first.select(*ROW, "x.*").select(old.columns), "refresh-rows")
            _replace(c, "relation", touched, rows, "opp_id")
            changes["relation"] = buckets
            for name, make in DERIVED.items():
                _replace(c, name, touched, make(rows), "opp_id")
                changes[name] = here.touched(name, touched)
        if with_facts:
            facts = settle(facts, "refresh-facts")
            spus = settle(facts.select("spu").distinct(), "refresh-spus")
            buckets = c.base.touched("fact", spus)
            old = c.base.read("fact", buckets).join(spus, "spu", "left_semi").join(facts.select("spu", "message_id"), ["spu", "message_id"], "left_anti")
            rows = settle(old.unionByName(facts.where("NOT gone").select(old.columns)), "refresh-fact-rows")
            _replace(c, "fact", spus, rows, "spu")
            _replace(c, "container", spus, containers(rows), "spu")
            changes |= {"fact": buckets, "container": c.base.touched("container", spus)}
    return changes


def changed_facts(old: DataFrame, new: DataFrame) -> DataFrame:
    """``facts`` for refresh() from the facts of changed messages before and now: pairs that are no more are marked as gone."""
    gone = old.join(new.select("spu", "message_id"), ["spu", "message_id"], "left_anti").withColumn("gone", F.lit(True))
    return new.withColumn("gone", F.lit(False)).unionByName(gone.select(*new.columns, "gone"))
