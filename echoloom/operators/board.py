"""Dashboard queries: lists, facets, funnels, coverage, search, drill-downs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tax_levels
from .core import by_spu, ratio, size0, wilson
from .rank import medians, numbered
from .trigram_index import literal_pattern

STATUSES = ("considering", "in_progress", "done", "dismissed", "revived")
#: Sort keys that callers may name, else the first; ties go by code.
BOARD_SORTS = ("wilson", "evidence", "issues", "star")


def recent(opp_evidence: DataFrame, as_of, days: int = 60) -> DataFrame:
    """Rows published in the ``days`` before ``as_of``, by publish time and never by attach week."""
    return opp_evidence.where((F.col("publish_time") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))) & (F.col("publish_time") <= F.lit(as_of).cast("timestamp")))


def board_list(container: DataFrame, issues: DataFrame, opp_evidence: DataFrame, as_of, sort: str = "wilson", limit: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """Products with issues: issue and recent evidence counts, negative ratio and its Wilson bound, ordered with a rank.

    ``only`` (spu), such as revived_products(), leaves the other products out before anything of them is counted.
    """
    sort = sort if sort in BOARD_SORTS else BOARD_SORTS[0]
    if only is not None:
        issues, container = issues.join(only, "spu", "left_semi"), container.join(only, "spu", "left_semi")
    counts = issues.groupBy("spu").agg(F.count(F.lit(1)).alias("issue_count"), F.sum("evi_count").alias("evi_count"))
    fresh = by_spu(recent(opp_evidence, as_of)).groupBy("spu").agg(F.count(F.lit(1)).alias("recent_evi_count"))
    rows = counts.join(container, "spu", "left").join(fresh, "spu", "left")
    total = F.coalesce("negative_evi_count", F.lit(0)) + F.coalesce("positive_evi_count", F.lit(0))
    zero = F.lit(0).cast("long")
    rows = rows.select("spu", "category", "avg_star", "message_count", "issue_count", "evi_count", F.coalesce("recent_evi_count", zero).alias("recent_evi_count"), F.coalesce(ratio(F.col("negative_evi_count"), total), F.lit(0.0)).alias("negative_ratio"), F.round(wilson(F.coalesce("negative_evi_count", F.lit(0)), total), 6).alias("wilson"))
    key = {"wilson": F.desc("wilson"), "evidence": F.desc("evi_count"), "issues": F.desc("issue_count"), "star": F.asc_nulls_last("avg_star")}[sort]
    return numbered(rows if limit is None else rows.orderBy(key, "spu").limit(limit), key, "spu")


def status_tier(status: Column) -> Column:
    return F.when(status == "revived", 0).when(status.isin("done", "dismissed"), 2).otherwise(1)


def board_issues(issues: DataFrame, spread: DataFrame, manual: DataFrame) -> DataFrame:
    """Issues of all products with human status (none: considering), spread and place in the product's list."""
    rows = issues.join(spread.select("opp_id", "n_eff", "scope"), "opp_id", "left").join(manual.select("spu", "opp_id", "status"), ["spu", "opp_id"], "left")
    rows = rows.withColumn("status", F.coalesce("status", F.lit("considering")))
    place = W.partitionBy("spu").orderBy(status_tier(F.col("status")), F.desc("evi_count"), "opp_id")
    return rows.select("spu", "opp_id", "evi_count", "status", "n_eff", "scope", F.row_number().over(place).cast("long").alias("place"))


def manual_status(issues: DataFrame) -> DataFrame:
    """Stand-in human layer: a status for most issues, by the length of their key."""
    n = (F.length("spu") + F.length("opp_id")) % 6
    status = F.element_at(F.array(*map(F.lit, STATUSES)), n + 1)
    return issues.where(n < 5).select("spu", "opp_id", status.alias("status"), F.when(status == "done", F.date_add(F.lit("1998-01-01").cast("date"), n)).alias("release_date"), F.when(status == "dismissed", F.greatest(F.floor(F.col("evi_count") / 4), F.lit(1))).alias("baseline_evi_count"))


def grouped_cards(board: DataFrame, issues: DataFrame) -> DataFrame:
    """Issues nested under their product, in order; products without issues are dropped."""
    nested = issues.groupBy("spu").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "opp_id", "evi_count", "status"))), lambda x: F.struct(x["opp_id"].alias("opp_id"), x["evi_count"].alias("evi_count"), x["status"].alias("status"))).alias("issues"))
    return board.join(nested, "spu")


def tag_facets(pool: DataFrame) -> DataFrame:
    """Counts of three tag levels in one pass of grouping sets; a level counts rows in which it is not blank."""
    part = lambda n: F.nullif(F.trim(F.split_part("tax_path", F.lit("/"), F.lit(n))), F.lit(""))
    rows = pool.select(part(2).alias("domain"), part(3).alias("sub"), part(4).alias("leaf")).where("domain IS NOT NULL")
    sets = rows.groupingSets([["domain"], ["domain", "sub"], ["domain", "sub", "leaf"]], "domain", "sub", "leaf").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 3, 1).when(F.col("g") == 1, 2).otherwise(3)
    return sets.select(level.cast("long").alias("level"), "domain", "sub", "leaf", "n").where("(level = 1 OR sub IS NOT NULL) AND (level < 3 OR leaf IS NOT NULL)")


def category_facets(container: DataFrame) -> DataFrame:
    return container.rollup("category").agg(F.count(F.lit(1)).alias("n"), F.grouping("category").alias("g")).where("g = 1 OR category IS NOT NULL").select(F.when(F.col("g") == 1, "__all__").otherwise(F.col("category")).alias("category"), "n")


def evidence_histogram(recounted: DataFrame) -> DataFrame:
    """Opportunities by evidence count in fixed bins, empty bins kept, with the share of all."""
    n = F.col("evi_total")
    bins = F.when(n <= 2, 0).when(n <= 5, 1).when(n <= 10, 2).when(n <= 100, 3).otherwise(4)
    grid = recounted.sparkSession.createDataFrame([(0, "1-2"), (1, "3-5"), (2, "6-10"), (3, "11-100"), (4, "101+")], "bin int, label string")
    counts = recounted.groupBy(bins.alias("bin")).count()
    rows = F.broadcast(grid).join(counts, "bin", "left").withColumn("n", F.coalesce("count", F.lit(0)))
    return rows.select(F.col("bin").cast("long").alias("bin"), "label", "n", F.round(F.try_divide(100.0 * F.col("n"), F.sum("n").over(W.partitionBy())), 2).alias("share"))


def coverage_funnel(message: DataFrame, evidence: DataFrame, candidates: DataFrame, opp_evidence: DataFrame) -> DataFrame:
    """Counts from messages to opportunities, each with its share of the stage before."""
    one = [message.agg(F.count(F.lit(1)).alias("n")), evidence.agg(F.count(F.lit(1)).alias("n")), candidates.agg(F.count(F.lit(1)).alias("n")), opp_evidence.agg(F.count(F.lit(1)).alias("n")), opp_evidence.agg(F.count_distinct("opp_id").alias("n"))]
    names = ("messages", "evidence", "candidates", "pool", "opportunities")
    rows = None
    for i, (name, df) in enumerate(zip(names, one, strict=True)):
        part = df.select(F.lit(i + 1).cast("long").alias("stage"), F.lit(name).alias("name"), "n")
        rows = part if rows is None else rows.unionByName(part)
    before = F.lag("n").over(W.orderBy("stage"))
    return rows.select("stage", "name", "n", ratio(100 * F.col("n"), before, 2).alias("retention"))


def coverage_by_source(message: DataFrame, opp_evidence: DataFrame) -> DataFrame:
    by = ["src_line", "country"]
    a = message.groupBy(*by).agg(F.count(F.lit(1)).alias("messages"))
    b = opp_evidence.groupBy(*by).agg(F.count(F.lit(1)).alias("pool_rows"), F.count_distinct("opp_id").alias("opportunities"), F.count_distinct("message_id").alias("covered"))
    zero = F.lit(0).cast("long")
    rows = a.join(b, by, "left").select(*by, "messages", *[F.coalesce(c, zero).alias(c) for c in ("pool_rows", "opportunities", "covered")])
    return rows.withColumn("conversion", ratio(100 * F.col("covered"), F.col("messages"), 1))


def pool_quality(candidates: DataFrame) -> DataFrame:
    c = lambda p: F.count_if(p)
    f = F.col
    return candidates.agg(F.count(F.lit(1)).alias("n"), c(f("product_experience") & f("user_experience")).alias("both_experience"), c(f("comparison") & f("gap")).alias("comparison_and_gap"), c(f("product_experience") & ~f("low_conf")).alias("confident"), c(f("low_conf")).alias("low_conf"), c(size0("spu") == 0).alias("without_spu"))


def sidebar_counts(container: DataFrame, issues: DataFrame, manual: DataFrame, recounted: DataFrame) -> DataFrame:
    """Five scalar counts in one row, each from its own single aggregate."""
    parts = [container.agg(F.count(F.lit(1)).alias("spus")), issues.agg(F.count(F.lit(1)).alias("issues")), manual.agg(F.count_if(F.col("status") == "revived").alias("revived"), F.count_if(F.col("status") == "in_progress").alias("in_progress")), recounted.agg(F.count_if("weak_evidence").alias("weak"))]
    out = parts[0]
    for p in parts[1:]:  # single rows
        out = out.crossJoin(p)
    return out


def weekly_metrics(opp_evidence: DataFrame) -> DataFrame:
    """Per week: rows, opportunities, new opportunities, dual-source share, and the change against the week before."""
    weeks = opp_evidence.groupBy("opp_id", "attach_week").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src_line").alias("sources"))
    first = F.min("attach_week").over(W.partitionBy("opp_id")) == F.col("attach_week")
    out = weeks.withColumn("new", first).groupBy("attach_week").agg(F.sum("n").alias("evidence"), F.count(F.lit(1)).alias("opportunities"), F.count_if("new").alias("new_opportunities"), F.count_if(F.col("sources") > 1).alias("dual_source"))
    return out.withColumn("change", F.col("evidence") - F.lag("evidence").over(W.orderBy("attach_week")))


def search_products(container: DataFrame, issues: DataFrame, keyword: str = "", category: str = "", tag: str = "") -> DataFrame:
    """Products by keyword (case-insensitive, in code or countries), category and tag; filters not given are not planned."""
    rows = container
    if keyword:
        like = literal_pattern(keyword)
        rows = rows.where(F.col("spu").ilike(like) | F.exists(F.split("countries", ","), lambda x: x.ilike(like)))
    if category:
        rows = rows.where(F.col("category") == category)
    if tag:
        rows = rows.join(issues.where(F.split_part("tax_path", F.lit("/"), F.lit(2)) == tag).select("spu"), "spu", "left_semi")
    return rows.select("spu", "category", "message_count")


def spu_medians(container: DataFrame) -> DataFrame:
    """Each product beside the medians over all products; ratios leave out products without evidence."""
    total = F.col("negative_evi_count") + F.col("positive_evi_count")
    rows = container.withColumn("negative_ratio", F.try_divide(F.col("negative_evi_count").cast("double"), total))
    mid = medians(rows, median_ratio=F.col("negative_ratio"), median_messages=F.col("message_count"), median_star=F.col("avg_star"))
    own = rows.select("spu", F.round("negative_ratio", 6).alias("negative_ratio"), "message_count")
    return own.withColumns({name: F.round(F.lit(value).cast("double"), 6) for name, value in mid.items()})


def issue_voices(opp_evidence: DataFrame, detail: DataFrame) -> DataFrame:
    """All voices of each issue with place, text, translation, tax levels and what is known of the message.

    The text is the snippet, else the content; the translation is the message's, where it says something else than the
    content. Places go by publish time, the latest first and those without last, then by message and number.
    ``detail``: message_id, content_zh, platform, lang, url.
    """
    tax = tax_levels(F.col("tax_path"))
    rows = opp_evidence.join(detail, "message_id", "left").select(
        "opp_id", "message_id", "seq", F.coalesce(F.nullif("snippet", F.lit("")), "content").alias("voice_text"), translation(F.col("content_zh"), F.col("content")).alias("translation"),
        *[tax[x].alias(f"tax_{x}") for x in ("stage", "domain", "sub", "leaf")], "platform", "publish_time", "star", "country", "lang", "interactions", "url", F.explode(F.array_distinct("spu")).alias("spu"),
    )
    place = W.partitionBy("spu", "opp_id").orderBy(F.desc_nulls_last("publish_time"), "message_id", "seq")
    return rows.withColumn("place", F.row_number().over(place).cast("long"))


def translation(translated: Column, content: Column) -> Column:
    """What a translation adds: null where it is the content (or is missing as the content is)."""
    return F.when(~translated.eqNullSafe(content), translated)


def revived_products(issues: DataFrame, manual: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Products with a current issue that is open again: under consideration, revived at some time, its opportunity known and not
    merged away. ``manual``: spu, opp_id, status, revived_at."""
    again = manual.where((F.col("status") == "considering") & F.col("revived_at").isNotNull()).select("spu", "opp_id")
    alive = opportunities.where("merged_into IS NULL").select("opp_id")
    return again.join(issues.select("spu", "opp_id"), ["spu", "opp_id"], "left_semi").join(alive, "opp_id", "left_semi").select("spu").distinct()


def innovation_pool(opp_evidence: DataFrame) -> DataFrame:
    """Innovation opportunities: interactions per message once, brands, messages and rows, aggregated apart."""
    rows = opp_evidence.where("rule = 'R2'")
    a = rows.groupBy("opp_id").agg(F.count(F.lit(1)).alias("evi_total"), F.min("attach_week").alias("first_week"), F.max("attach_week").alias("last_week"))
    b = rows.select("opp_id", "message_id", "interactions").distinct().groupBy("opp_id").agg(F.count(F.lit(1)).alias("messages"), F.coalesce(F.sum(F.coalesce("interactions", F.lit(0))), F.lit(0)).alias("interactions"))
    c = rows.select("opp_id", F.explode("brands").alias("brand")).groupBy("opp_id").agg(F.array_join(F.array_sort(F.collect_set("brand")), ",").alias("brands"))
    top = a.agg(F.max("evi_total").alias("_top"))
    rows = a.join(b, "opp_id").join(c, "opp_id", "left").crossJoin(F.broadcast(top))
    return rows.withColumn("bar", F.round(100.0 * F.col("evi_total") / F.col("_top"), 2)).drop("_top")
