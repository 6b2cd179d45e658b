"""Generation pool, classification, routing, recount, expansion and spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.unicode import bucket_value


def blank_to_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(c), F.lit(""))


def overlaps(array: Column | str, *values: str) -> Column:
    """Whether they share an element; false, not null, where the array is null or holds nulls."""
    return F.coalesce(F.arrays_overlap(array, F.array(*map(F.lit, values))), F.lit(False))


def size0(array: Column | str) -> Column:
    return F.coalesce(F.size(array), F.lit(0))


def iso_week(t: Column | str) -> Column:
    t = F.col(t) if isinstance(t, str) else t
    return F.concat(F.date_part(F.lit("YEAROFWEEK"), t).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(t).cast("string"), 2, "0"))


def rule_of(has_spu: Column, optional_source: Column) -> Column:
    """R1: some product code; else R2: some source that needs none; else R3. R0 is for no rows at all."""
    return F.when(has_spu, "R1").when(optional_source, "R2").otherwise("R3")


OPP_TYPE = {"R1": "existing_product", "R2": "innovation"}


def opp_type(rule: Column) -> Column:
    return F.when(rule == "R1", OPP_TYPE["R1"]).when(rule == "R2", OPP_TYPE["R2"])


def classification_state(rule: Column) -> Column:
    return F.when(rule.isin("R1", "R2"), "valid").otherwise("invalid")


def pool_candidates(evidence: DataFrame, message: DataFrame, policy: DataFrame, since=None, until=None) -> DataFrame:
    """Evidence in at least one content branch, with branch, channel, text and rule; before the source-policy gate.

    The window is half-open on publish_time and reaches the scan. Policies are a handful of rows.
    """
    if since is not None:
        message = message.where(F.col("publish_time") >= F.lit(since))
    if until is not None:
        message = message.where(F.col("publish_time") < F.lit(until))
    told = F.coalesce(F.trim("snippet"), F.lit("")) != ""
    text = F.coalesce(blank_to_null("snippet"), blank_to_null("content"))
    rows = evidence.join(message, "message_id").join(F.broadcast(policy), "src_line").withColumn("evidence_text", text)
    negative = F.col("sentiment") == "neg"
    rows = rows.withColumns(
        {
            "product_experience": F.col("is_product") & negative & told,
            "user_experience": overlaps("content_type", "experience") & negative & told,
            "comparison": overlaps("content_type", "review", "bashing") & F.col("evidence_text").isNotNull() & (size0("brands") >= 2),
            "gap": overlaps("content_type", "inquiry", "other") & F.col("evidence_text").isNotNull(),
        }
    ).where("product_experience OR user_experience OR comparison OR gap")
    return rows.withColumns(
        {
            "content_branch": F.when(F.col("product_experience"), "product_experience").when(F.col("user_experience"), "user_experience").when(F.col("comparison"), "comparison").otherwise("gap"),
            "channel": F.when(F.col("comparison"), "comparison").when(F.col("gap"), "gap").otherwise("product"),
            "rule": rule_of(size0("spu") > 0, ~F.col("requires_spu")),
        }
    )


def generation_pool(evidence: DataFrame, message: DataFrame, policy: DataFrame, since=None, until=None) -> DataFrame:
    """Candidates that their source's policy lets in."""
    return pool_candidates(evidence, message, policy, since, until).where(~F.col("requires_spu") | (size0("spu") > 0))


def attached(pool: DataFrame) -> DataFrame:
    return pool.withColumns({"opp_id": F.concat("tag", F.lit("-"), (F.col("size") % 8).cast("string")), "attach_week": iso_week("publish_time")})


def classify(rows: DataFrame, *by: str) -> DataFrame:
    """Rule, type and state of each group of evidence rows; a row without policy makes ``unknown_policy`` true."""
    rule = rule_of(F.bool_or(size0("spu") > 0), F.bool_or(~F.col("requires_spu")))
    out = rows.groupBy(*by).agg(rule.alias("rule"), F.bool_or(F.col("requires_spu").isNull()).alias("unknown_policy"))
    return out.select(*by, "rule", opp_type(F.col("rule")).alias("opp_type"), classification_state(F.col("rule")).alias("state"), "unknown_policy")


def checked_policy(rows: DataFrame) -> DataFrame:
    """``rows``, unless a row's source has no policy: that is an error even where another row would decide."""
    missing = F.raise_error(F.concat(F.lit("no policy for source "), F.coalesce("src_line", F.lit("null")))).cast("boolean")
    return rows.withColumn("requires_spu", F.coalesce("requires_spu", missing))


def classify_all(keys: DataFrame, rows: DataFrame, *by: str) -> DataFrame:
    """As ``classify``, with a row for every key: R0, invalid and without a type, where a key has no rows at all."""
    found = classify(checked_policy(rows), *by).drop("unknown_policy")
    out = keys.select(*by).distinct().join(found, list(by), "left")
    return out.withColumns({"rule": F.coalesce("rule", F.lit("R0")), "state": F.coalesce("state", F.lit("invalid"))})


def lifecycle_routing(candidates: DataFrame) -> DataFrame:
    """Candidates by lifecycle, the rows that need a product and have none in a set of their own (invalid)."""
    old, bad = F.col("rule") == "R1", F.col("rule") == "R3"
    candidates = folded(candidates, F.when(old, F.col("tag")).otherwise(F.col("content_branch")), "topic")
    keyed = candidates.select(opp_type(F.col("rule")).alias("opp_type"), F.when(~bad, F.col("topic")).alias("topic"), F.when(~old & ~bad, F.col("channel")).alias("channel"), classification_state(F.col("rule")).alias("state"))
    return keyed.groupBy("opp_type", "topic", "channel", "state").agg(F.count(F.lit(1)).alias("n"))


def lifecycle_buckets(pool: DataFrame) -> DataFrame:
    """Pool rows by lifecycle: existing products by tag, innovation by branch and channel, with the bucket's context."""
    old = F.col("rule") == "R1"
    keyed = folded(pool, F.when(old, F.col("tag")).otherwise(F.col("content_branch")), "topic").select(
        opp_type(F.col("rule")).alias("opp_type"),
        "topic",
        F.when(~old, F.col("channel")).alias("channel"),
        "category", "tax_path", "star",
    )
    by = ["opp_type", "topic", "channel"]
    paths = keyed.groupBy(*by, "tax_path").agg(F.count(F.lit(1)).alias("n"), F.count("star").alias("stars"), F.count_if(F.col("star") <= 2).alias("low"), F.min("category").alias("least"), F.max("category").alias("most"))
    one = F.min("least") == F.max("most")
    return paths.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.when(F.max("most").isNull(), "undetermined").when(one, F.max("most")).otherwise("cross").alias("category"),
        most_frequent("tax_path", "n").alias("tax_path"),
        F.round(F.sum("low") / F.nullif(F.sum("stars"), F.lit(0)), 4).alias("low_star_rate"),
    )


def folded(rows: DataFrame, raw: Column, name: str) -> DataFrame:
    """``rows`` with the folded text of ``raw``. Each distinct text is folded once, in Python, and joined back."""
    keyed = rows.withColumn("_raw", raw)
    names = keyed.select("_raw").distinct().select(F.col("_raw").alias("_text"), bucket_value(F.col("_raw")).alias(name))
    return keyed.join(names, F.col("_raw").eqNullSafe(F.col("_text")), "left").drop("_raw", "_text")


def most_frequent(value: str, n: str) -> Column:
    """The value with the largest count, ties by value, of rows that each hold a value's count: counting by value first keeps
    what an aggregate holds to one value. Null is no value."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(-F.col(n), F.col(value))))


def low_star_rate(star: str) -> Column:
    stars = F.col(star)
    return F.round(F.avg(F.when(stars <= 2, 1.0).when(stars.isNotNull(), 0.0)), 4)


def recount(opp_evidence: DataFrame, safety: Column | None = None) -> DataFrame:
    """Authoritative counts of each opportunity from its relation rows, all opportunities in one pass.

    by_source is canonical JSON. rank = n (1 + low-star rate), half as much again with more than one source, and
    1000 on top for safety.
    """
    by_source = opp_evidence.groupBy("opp_id", "src_line").agg(F.count(F.lit(1)).alias("n"), F.count("star").alias("stars"), F.count_if(F.col("star") <= 2).alias("low"), F.min("attach_week").alias("first_week"), F.max("attach_week").alias("last_week"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("src_line", "n"))))
    out = by_source.groupBy("opp_id").agg(F.sum("n").alias("evi_total"), F.to_json(entries).alias("by_source"), F.count(F.lit(1)).alias("sources"), F.sum("stars").alias("stars"), F.sum("low").alias("low"), F.min("first_week").alias("first_week"), F.max("last_week").alias("last_week"))
    rate = F.round(F.col("low") / F.nullif(F.col("stars"), F.lit(0)), 4)
    rank = F.col("evi_total") * (1 + F.coalesce(rate, F.lit(0.0))) * F.when(F.col("sources") > 1, 1.5).otherwise(1.0) + F.when(F.coalesce(safety, F.lit(False)) if safety is not None else F.lit(False), 1000.0).otherwise(0.0)
    return out.select("opp_id", "evi_total", "by_source", rate.alias("low_star_rate"), F.round(rank, 3).alias("rank_score"), (F.col("evi_total") <= 2).alias("weak_evidence"), (F.col("sources") >= 2).alias("dual_source"), "first_week", "last_week")


def spu_container(message: DataFrame, evidence: DataFrame, source: str = "commerce") -> DataFrame:
    """One row for each product code of a source: message statistics and evidence counts, aggregated apart to avoid fan-out."""
    own = message.where(F.col("src_line") == source).select("message_id", "category", "star", "publish_time", "country", F.explode(F.array_distinct("spu")).alias("spu"))
    stats = own.groupBy("spu").agg(
        F.count_distinct("message_id").alias("message_count"),
        F.expr("mode() WITHIN GROUP (ORDER BY category)").alias("category"),
        F.round(F.avg(F.col("star").cast("double")), 2).alias("avg_star"),
        F.array_join(F.array_sort(F.collect_set("country")), ",").alias("countries"),
        F.min(iso_week("publish_time")).alias("first_publish_week"),
        F.max(iso_week("publish_time")).alias("last_publish_week"),
    )
    voiced = own.select("spu", "message_id").join(evidence.select("message_id", "sentiment"), "message_id")
    counts = voiced.groupBy("spu").agg(F.count_if(F.col("sentiment") == "neg").alias("negative_evi_count"), F.count_if(F.col("sentiment") == "pos").alias("positive_evi_count"))
    zero = F.lit(0).cast("long")
    return stats.join(counts, "spu", "left").withColumns({"negative_evi_count": F.coalesce("negative_evi_count", zero), "positive_evi_count": F.coalesce("positive_evi_count", zero)})


def by_spu(opp_evidence: DataFrame) -> DataFrame:
    """(opp_id, spu) with evidence rows, first and last week: the code array is exploded and the full key de-duplicated."""
    rows = opp_evidence.where("rule = 'R1'").select("opp_id", "message_id", "seq", "attach_week", "tax_path", "publish_time", F.explode(F.array_distinct("spu")).alias("spu"))
    return rows.dropDuplicates(["opp_id", "spu", "message_id", "seq"])


def spu_issue(opp_evidence: DataFrame, least: int = 2) -> DataFrame:
    paths = by_spu(opp_evidence).groupBy("spu", "opp_id", "tax_path").agg(F.count(F.lit(1)).alias("n"), F.min("attach_week").alias("first"), F.max("attach_week").alias("last"))
    rows = paths.groupBy("spu", "opp_id").agg(F.sum("n").alias("evi_count"), most_frequent("tax_path", "n").alias("tax_path"), F.min("first").alias("first_attach_week"), F.max("last").alias("last_attach_week"))
    return rows.where(F.col("evi_count") >= least)


def spread(opp_evidence: DataFrame) -> DataFrame:
    """Effective number of products of an opportunity, (sum n)^2 / sum n^2, and the scope it falls into."""
    counts = by_spu(opp_evidence).groupBy("opp_id", "spu").agg(F.count(F.lit(1)).cast("double").alias("n"))
    out = counts.groupBy("opp_id").agg(F.count(F.lit(1)).alias("spus"), F.round(F.pow(F.sum("n"), 2) / F.nullif(F.sum(F.col("n") * F.col("n")), F.lit(0.0)), 6).alias("n_eff"))
    return out.withColumn("scope", scope(F.col("n_eff")))


def scope(n_eff: Column) -> Column:
    return F.when(n_eff < 1.5, "single").when(n_eff < 3, "multi").when(n_eff.isNotNull(), "line")


def wilson(hits: Column, n: Column) -> Column:
    """Lower bound of the 95 % Wilson interval; 0 of nothing."""
    z2 = 3.8416
    n, p = n.cast("double"), hits.cast("double") / F.nullif(n.cast("double"), F.lit(0.0))
    bound = (p + z2 / (2 * n) - F.sqrt(z2 * (p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n)
    return F.when(n > 0, bound).otherwise(0.0)


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), digits)
