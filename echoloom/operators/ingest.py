"""Ingest: raw export rows to messages and evidence, taxonomy trees to leaves, gates on what a week brought."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .rank import numbered

#: Branches of the taxonomy, the longest content kept, rows of an export that was cut off, days of retention.
PRODUCT_BRANCH, SCENE_BRANCH = "产品体验", "用户群体&场景"
CONTENT_LIMIT, EXPORT_CAP, RETENTION_DAYS = 20_000, 5_000, 720
#: Control characters that no XML text may hold.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def repaired(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def number(c: Column) -> Column:
    """A number told as text; null where it is none."""
    return T.strip(c).try_cast("double")


def to_message(raw: DataFrame, src_line: str | Column, batch: str, domain: list[str]) -> DataFrame:
    """Raw rows of strings to messages.

    Content is cut at CONTENT_LIMIT; numbers that do not parse are null; content types are the tags that belong to
    ``domain``, in their order and with repeats; a blank list is an empty array.
    """
    tags = T.parse_array(F.col("tags"))
    codes = T.clean_codes(F.col("spu"))
    source = src_line if isinstance(src_line, Column) else F.lit(src_line)
    return raw.select(
        "message_id",
        source.alias("src_line"),
        T.scalar(F.col("platform")).alias("platform"),
        F.to_timestamp("published").alias("publish_time"),
        F.nullif(F.substring(F.col("content"), 1, CONTENT_LIMIT), F.lit("")).alias("content"),
        F.nullif(F.col("translated"), F.lit("")).alias("content_zh"),
        F.coalesce(T.scalar(F.col("product_url")), T.scalar(F.col("url"))).alias("url"),
        number(F.col("star")).alias("star"),
        T.first_value(F.col("category")).alias("category"),
        T.first_value(F.col("product_name")).alias("product_name"),
        T.highest_grade(F.col("grade")).alias("product_grade"),
        codes["spu"].alias("spu"),
        codes["spu_raw"].alias("spu_raw"),
        codes["spu_unmatched"].alias("spu_unmatched"),
        T.parse_array(F.col("sku")).alias("sku"),
        T.own_brand(F.col("own_brand")).alias("is_own_brand"),
        T.country(F.col("country")).alias("country"),
        T.scalar(F.col("lang")).alias("lang"),
        number(F.col("interactions")).cast("long").alias("interactions"),
        T.parse_array(F.col("brands")).alias("brands"),
        F.filter(tags, lambda t: t.isin(*domain)).alias("content_type"),
        F.lit(batch).alias("pull_batch_id"),
        F.date_add(F.to_date(F.to_timestamp("published")), RETENTION_DAYS).alias("keep_until"),
    )


def first_rows(raw: DataFrame, key: str = "message_id", order: str = "row_no") -> DataFrame:
    """The first row of each key in file order; rows without a key are none."""
    first = raw.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order))
    return raw.join(first, [key, order], "left_semi")


def to_evidence(raw: DataFrame, leaves: DataFrame, negative: str = "负面") -> DataFrame:
    """Evidence rows of raw rows, by position of the tag; ``leaves`` (tag, tax_path, ...) joined by folded tag.

    A short list of sentiments or snippets gives nulls, sentinels are nulls in place, repeated tails are cut.
    low_conf marks a negative tag with four stars or more.
    """
    tags, moods, told = (T.parse_array(F.col(c)) for c in ("tags", "sentiments", "snippets"))
    rows = raw.select("message_id", number(F.col("star")).alias("star"), T.misaligned(tags, moods).alias("misaligned"), F.posexplode(T.triples(tags, moods, told)).alias("seq", "t"))
    raw_snippet = T.null_token(F.col("t.snippet"))
    rows = rows.select("message_id", F.col("seq").cast("long").alias("seq"), F.col("t.tag").alias("tag_raw"), T.synonym(F.col("t.tag")).alias("tag"), T.null_token(F.col("t.sentiment")).alias("sentiment"), T.fix_tail_repeat(raw_snippet).alias("snippet"), raw_snippet.alias("snippet_raw"), "star", "misaligned")
    known = leaves.select("tag", "tax_path", "is_product", "is_scene")
    out = rows.join(known, "tag", "left").withColumns({"tax_path": F.coalesce("tax_path", F.lit("")), "is_product": F.coalesce("is_product", F.lit(False)), "is_scene": F.coalesce("is_scene", F.lit(False))})
    low = F.coalesce((F.col("sentiment") == negative) & (F.col("star") >= 4), F.lit(False))
    levels = T.tax_levels(F.col("tax_path"))
    return out.withColumns({"low_conf": low, **{f"tax_{x}": levels[x] for x in ("stage", "domain", "sub", "leaf")}}).drop("star")


def ingest_report(raw: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: rows read, messages kept, evidence rows, misaligned messages, snippets whose tail was cut."""
    read_ = raw.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("message_id").alias("messages"))
    cut = ~F.col("snippet").eqNullSafe(F.col("snippet_raw"))
    told = evidence.agg(F.count(F.lit(1)).alias("evidence"), F.count_distinct(F.when(F.col("misaligned"), F.col("message_id"))).alias("misaligned"), F.count_if(cut).alias("tail_fixed"))
    return read_.crossJoin(F.broadcast(told))


def leaves_of(paths: DataFrame, product: str = PRODUCT_BRANCH, scene: str = SCENE_BRANCH) -> DataFrame:
    """Leaves of taxonomy trees told as (place, line, path of names): tag, tax_path, tax_l1, lines, prod_line and branch flags.

    The last name is the leaf; the path of the first place wins, later ones add their product line alone.
    """
    rows = paths.select("place", "line", T.synonym(F.element_at("path", -1)).alias("tag"), F.slice("path", F.lit(1), F.size("path") - 1).alias("trail"))
    out = rows.groupBy("tag").agg(F.min_by("trail", "place").alias("trail"), F.array_sort(F.collect_set("line")).alias("lines"))
    path = F.array_join("trail", "/")
    inside, staged = path.contains(product), path.contains(scene)
    return out.select("tag", path.alias("tax_path"), F.coalesce(F.get("trail", F.lit(0)), F.lit("")).alias("tax_l1"), "lines", T.prod_line(F.col("lines")).alias("prod_line"), (inside & ~staged).alias("is_product"), staged.alias("is_scene"))


def leaf_stats(leaves: DataFrame) -> DataFrame:
    return leaves.agg(F.count(F.lit(1)).alias("leaves"), F.count_if("is_product").alias("product"), F.count_if("is_scene").alias("scene"), F.count_if(F.size("lines") > 1).alias("shared"))


def taxonomy_snapshot(leaves: DataFrame, week: str) -> DataFrame:
    """A row for each tag, product line and week."""
    return leaves.select("tag", F.explode("lines").alias("line"), F.lit(week).alias("week"), "tax_path", "is_product")


def bisected(counts: DataFrame, cap: int = EXPORT_CAP, depth: int = 4) -> DataFrame:
    """(slice_start, slice_days, n, level, state): slices of days cut in halves until none reaches ``cap``.

    ``counts`` has a row for each day (slice_start, slice_days, day, n). After ``depth`` cuts a slice that still
    reaches the cap is ``truncated``; an empty one is ``empty``. A level looks at slices, not at rows of messages.
    """
    open_ = counts.select("slice_start", "slice_days", "day", "n")
    done = None
    for level in range(depth + 1):
        sums = open_.groupBy("slice_start", "slice_days").agg(F.sum("n").alias("n"))
        full = (F.col("n") >= cap) & (F.col("slice_days") > 1)
        settled = sums.where(~full | F.lit(level == depth)).withColumns({"level": F.lit(level), "state": F.when(F.col("n") >= cap, "truncated").when(F.col("n") == 0, "empty").otherwise("ok")})
        done = settled if done is None else done.unionByName(settled)
        if level < depth:
            half = F.floor(F.col("slice_days") / 2).cast("int")
            late = F.col("day") >= F.date_add("slice_start", half)
            cut = open_.join(sums.where(full).select("slice_start", "slice_days"), ["slice_start", "slice_days"], "left_semi")
            open_ = cut.select(F.when(late, F.date_add("slice_start", half)).otherwise(F.col("slice_start")).alias("slice_start"), F.when(late, F.col("slice_days") - half).otherwise(half).alias("slice_days"), "day", "n")
    return done


def week_grid(first: str, last: str, spark) -> DataFrame:
    """(week, starts, ends) of all ISO weeks from the one of day ``first`` to the one of day ``last``; ends is the next Monday."""
    days = spark.range(1).select(F.explode(F.sequence(F.date_trunc("week", F.lit(first).cast("timestamp")).cast("date"), F.lit(last).cast("date"), F.expr("INTERVAL 7 DAYS"))).alias("starts"))
    week = F.concat(F.date_part(F.lit("YEAROFWEEK"), F.col("starts")).cast("string"), F.lit("-W"), F.lpad(F.weekofyear("starts").cast("string"), 2, "0"))
    return days.select(week.alias("week"), "starts", F.date_add("starts", 7).alias("ends"))


def quality_gates(weeks: DataFrame, evidence: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(gate, value, passed): zero matches, volume against the mean of four weeks before, misalignment, review rate.

    ``weeks`` is (week, n), ``evidence`` has misaligned, ``reviewed`` needs_review. The volume gate passes unseen with
    fewer than five weeks. Only the last five weeks are looked at, so no window holds all of them.
    """
    five = weeks.orderBy(F.desc("week")).limit(5)
    held = five.agg(F.count(F.lit(1)).alias("k"), F.max_by("n", "week").alias("now"), F.sum("n").alias("all"), F.count_if(F.col("n") == 0).alias("zero"))
    base = (F.col("all") - F.col("now")) / 4
    volume = held.select(F.lit("volume").alias("gate"), F.round(base, 6).alias("value"), ((F.col("k") < 5) | (F.col("now") >= 0.5 * base)).alias("passed"))
    zero = held.select(F.lit("zero_match").alias("gate"), F.col("zero").cast("double").alias("value"), (F.col("zero") == 0).alias("passed"))

    def share(df: DataFrame, gate: str, flag: str, most: float) -> DataFrame:
        part = df.agg(F.coalesce(F.try_divide(F.count_if(flag).cast("double"), F.count(F.lit(1))), F.lit(0.0)).alias("v"))
        return part.select(F.lit(gate).alias("gate"), F.round("v", 6).alias("value"), (F.col("v") <= most).alias("passed"))

    return zero.unionByName(volume).unionByName(share(evidence, "alignment", "misaligned", 0.01)).unionByName(share(reviewed, "review", "needs_review", 0.40))


def scope_account(pool: DataFrame, bucket: list[str], most_buckets: int | None = None, most_rows: int | None = None) -> DataFrame:
    """Buckets by falling size with whether a limit would leave them or some of their rows out; a run with any is refused."""
    sizes = pool.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"))
    out = numbered(sizes, F.desc("n"), *bucket, name="place")
    left = F.lit(False) if most_buckets is None else F.col("place") > most_buckets
    cut = F.lit(0).cast("long") if most_rows is None else F.greatest(F.col("n") - most_rows, F.lit(0)).cast("long")
    return out.withColumns({"left_out": left, "rows_cut": F.when(left, F.col("n")).otherwise(cut)})
