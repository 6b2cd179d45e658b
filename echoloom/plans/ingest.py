"""Registered queries of ingest, with their DuckDB twins. Raw export rows are made from ``documents``, all columns strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import core as C
from ..operators import ingest as I
from ..sources.fixtures import evidence, message, read
from .queries import _opp, _pool, query

DOMAIN = ["A", "包装品质"]

#: Columns of a raw export row as SQL that both engines read.
RAW = """SELECT doc_id AS row_no, CASE WHEN doc_id % 50 = 0 THEN NULL ELSE concat('m', CAST(doc_id % 180 AS {text})) END AS message_id,
 CASE doc_id % 4 WHEN 0 THEN '[噪音控制, A, B]' WHEN 1 THEN '[A]' WHEN 2 THEN '[]' ELSE '[B, 产品瑕疵, A, A]' END AS tags,
 CASE doc_id % 4 WHEN 0 THEN '[负面, null, 正面]' WHEN 1 THEN '[负面, 负面]' WHEN 2 THEN NULL ELSE '[正面, 负面, 负面, NaN]' END AS sentiments,
 CASE doc_id % 4 WHEN 0 THEN '[null, 声音很大大, it  worksks]' WHEN 1 THEN '[sehr lange lange]' WHEN 2 THEN NULL ELSE '[, ok]' END AS snippets,
 CASE doc_id % 7 WHEN 6 THEN 'x' WHEN 5 THEN '' ELSE CAST(doc_id % 7 + 0.5 AS {text}) END AS star,
 concat('[', source, ']') AS platform, concat('2024-01-0', CAST(1 + doc_id % 9 AS {text}), ' 10:00:00') AS published, text AS content, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS translated,
 CASE WHEN doc_id % 2 = 0 THEN concat('[http://p/', CAST(doc_id AS {text}), ']') END AS product_url, 'http://m' AS url, '[c1, c2]' AS category, CASE WHEN doc_id % 5 = 0 THEN '[]' ELSE '[tripod, clamp]' END AS product_name,
 CASE doc_id % 3 WHEN 0 THEN '[B级, A]' WHEN 1 THEN '[x, D]' ELSE NULL END AS grade, concat('[MT-', CAST(doc_id % 50 AS {text}), ', mt ', CAST(doc_id % 50 AS {text}), ', -]') AS spu, '[s1,, s2]' AS sku,
 CASE doc_id % 3 WHEN 0 THEN '[]' WHEN 1 THEN '[竞品]' ELSE '[竞品, 本品]' END AS own_brand, CASE doc_id % 4 WHEN 0 THEN '[美国, x]' WHEN 1 THEN 'us' WHEN 2 THEN NULL ELSE '瑞典' END AS country,
 concat('[', lang, ']') AS lang, CASE doc_id % 3 WHEN 0 THEN '12.7' WHEN 1 THEN '' ELSE 'many' END AS interactions, '[b1, b2]' AS brands FROM {documents}"""

#: (place, line, names) of the leaves of two small trees over the parts' types and brands; the first place of a leaf wins.
TREES = """SELECT DISTINCT p_size AS place, CASE WHEN p_size % 3 = 0 THEN 'light' ELSE 'stand' END AS line, CASE WHEN p_size % 4 = 0 THEN '用户群体&场景' ELSE 'root' END AS top,
 CASE WHEN p_size % 2 = 0 THEN '产品体验' ELSE 'service' END AS mid, p_brand AS leaf FROM {part}"""


def raw_export(s: SparkSession, d: str) -> DataFrame:
    return s.sql(RAW.format(text="STRING", documents="{documents}"), documents=read(s, d, "documents"))


def _leaves(s: SparkSession, d: str) -> DataFrame:
    rows = s.sql(TREES.format(part="{part}"), part=read(s, d, "part"))
    place = F.struct("place", "line", "top", "mid")
    return I.leaves_of(rows.select(place.alias("place"), "line", F.array("top", "mid", "leaf").alias("path")))


def _tags(s: SparkSession) -> DataFrame:
    told = [(1, "stand", ["产品体验", "结构", "A"]), (2, "light", ["root", "噪音控制"]), (3, "light", ["用户群体&场景", "产品瑕疵"])]
    return I.leaves_of(s.createDataFrame(told, "place int, line string, path array<string>"))


_RAW = RAW.format(text="VARCHAR", documents="documents")
_FIRST = f"raw AS ({_RAW}), r AS (SELECT * FROM raw WHERE message_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY row_no) = 1)"
_LIST = lambda c: rf"list_filter(list_transform(string_split(regexp_replace(trim(coalesce({c}, '')), '^[\[\]]+|[\[\]]+$', '', 'g'), ','), lambda x: trim(x)), lambda x: x <> '')"
_ONE = lambda c: rf"nullif(trim(regexp_replace(trim({c}), '^[\[\]]+|[\[\]]+$', '', 'g')), '')"


@query(
    rf"""WITH {_FIRST} SELECT message_id, CASE WHEN row_no % 2 = 0 THEN 'commerce' ELSE 'social' END AS src_line, {_ONE('platform')} AS platform, published::TIMESTAMP AS publish_time, nullif(left(content, 20000), '') AS content, nullif(translated, '') AS content_zh,
 coalesce({_ONE('product_url')}, url) AS url, try_cast(star AS DOUBLE) AS star, {_LIST('category')}[1] AS category, {_LIST('product_name')}[1] AS product_name, CASE row_no % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'D' END AS product_grade,
 ['MT' || (row_no % 50)] AS spu, {_LIST('spu')} AS spu_raw, ['-'] AS spu_unmatched, ['s1', 's2'] AS sku, CASE row_no % 3 WHEN 1 THEN false WHEN 2 THEN true END AS is_own_brand, CASE row_no % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'US' WHEN 3 THEN 'SE' END AS country,
 {_ONE('lang')} AS lang, CASE WHEN row_no % 3 = 0 THEN 12::BIGINT END AS interactions, ['b1', 'b2'] AS brands, CASE row_no % 4 WHEN 0 THEN ['A'] WHEN 1 THEN ['A'] WHEN 2 THEN [] ELSE ['A', 'A'] END AS content_type, 'batch' AS pull_batch_id, published::TIMESTAMP::DATE + 720 AS keep_until FROM r""",
    plain=True,
)
def message_mapping(s, d):
    """Raw export rows, the first of each id in file order, as messages."""
    return I.to_message(I.first_rows(raw_export(s, d)), F.when(F.col("row_no") % 2 == 0, "commerce").otherwise("social"), "batch", DOMAIN)


_EVIDENCE = rf"""{_FIRST}, x AS (SELECT *, {_LIST('tags')} AS t, {_LIST('sentiments')} AS m, {_LIST('snippets')} AS n FROM r), y AS (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM x),
 z AS (SELECT message_id, i - 1 AS seq, t[i] AS tag_raw, CASE t[i] WHEN '噪音控制' THEN '噪声控制' WHEN '产品瑕疵' THEN '整体质量' ELSE t[i] END AS tag, CASE WHEN lower(m[i]) IN ('null', 'nan') THEN NULL ELSE m[i] END AS sentiment, CASE WHEN lower(n[i]) = 'null' THEN NULL ELSE n[i] END AS snippet_raw,
   len(t) > 0 AND len(t) <> len(m) AS misaligned, try_cast(star AS DOUBLE) AS star FROM y),
 e AS (SELECT message_id, seq, tag_raw, tag, sentiment, CASE snippet_raw WHEN '声音很大大' THEN '声音很大' WHEN 'it  worksks' THEN 'it works' WHEN 'sehr lange lange' THEN 'sehr lange' ELSE snippet_raw END AS snippet, snippet_raw, misaligned,
   CASE tag WHEN 'A' THEN '产品体验/结构' WHEN '噪声控制' THEN 'root' WHEN '整体质量' THEN '用户群体&场景' ELSE '' END AS tax_path, tag = 'A' AS is_product, tag = '整体质量' AS is_scene, coalesce(sentiment = '负面' AND star >= 4, false) AS low_conf,
   CASE tag WHEN 'A' THEN '结构' END AS tax_stage, NULL::VARCHAR AS tax_domain, NULL::VARCHAR AS tax_sub, NULL::VARCHAR AS tax_leaf FROM z)"""


def _mapped(s, d):
    return I.to_evidence(I.first_rows(raw_export(s, d)), _tags(s))


@query(f"WITH {_EVIDENCE} SELECT * FROM e", plain=True)
def message_evidence(s, d):
    return _mapped(s, d)


@query(f"WITH {_EVIDENCE} SELECT (SELECT count(*) FROM raw) AS rows, (SELECT count(*) FROM r) AS messages, count(*) AS evidence, count(DISTINCT message_id) FILTER (misaligned) AS misaligned, count(*) FILTER (snippet IS DISTINCT FROM snippet_raw) AS tail_fixed FROM e", plain=True)
def ingest_batch(s, d):
    return I.ingest_report(raw_export(s, d), _mapped(s, d))


_LEAVES = f"""t AS ({TREES.format(part='part')}), l AS (SELECT leaf AS tag, arg_min(top || '/' || mid, (place, line, top, mid)) AS tax_path, arg_min(top, (place, line, top, mid)) AS tax_l1, list_sort(list(DISTINCT line)) AS lines FROM t GROUP BY leaf),
 leaves AS (SELECT *, CASE len(lines) WHEN 1 THEN lines[1] ELSE 'common' END AS prod_line, contains(tax_path, '产品体验') AND NOT contains(tax_path, '用户群体&场景') AS is_product, contains(tax_path, '用户群体&场景') AS is_scene FROM l)"""


@query(f"WITH {_LEAVES} SELECT * FROM leaves", plain=True)
def taxonomy_leaves(s, d):
    return _leaves(s, d)


@query(f"WITH {_LEAVES} SELECT count(*) AS leaves, count(*) FILTER (is_product) AS product, count(*) FILTER (is_scene) AS scene, count(*) FILTER (len(lines) > 1) AS shared FROM leaves", plain=True)
def taxonomy_stats(s, d):
    return I.leaf_stats(_leaves(s, d))


@query(f"WITH {_LEAVES} SELECT tag, unnest(lines) AS line, '2024-W03' AS week, tax_path, is_product FROM leaves", plain=True)
def taxonomy_snapshot(s, d):
    return I.taxonomy_snapshot(_leaves(s, d), "2024-W03")


@query("""SELECT slice_start, slice_days, n, level, state FROM bisected WHERE state <> ''""", """days AS (SELECT publish_time::DATE AS day, count(*) AS n FROM message GROUP BY 1),
 d0 AS (SELECT (DATE '1995-01-01' + (date_diff('day', DATE '1995-01-01', day) // 60 * 60)::INTEGER)::DATE AS slice_start, 60 AS slice_days, day, n FROM days),
 bisect AS (SELECT slice_start, slice_days, day, n, 0 AS level, sum(n) OVER (PARTITION BY slice_start, slice_days) AS total FROM d0
   UNION ALL SELECT start, days, day, n, level + 1, sum(n) OVER (PARTITION BY start, days) FROM (SELECT CASE WHEN day >= slice_start + (slice_days // 2)::INTEGER THEN (slice_start + (slice_days // 2)::INTEGER)::DATE ELSE slice_start END AS start,
     CASE WHEN day >= slice_start + (slice_days // 2)::INTEGER THEN slice_days - slice_days // 2 ELSE slice_days // 2 END AS days, day, n, level FROM bisect WHERE total >= 100 AND slice_days > 1 AND level < 4)),
 bisected AS (SELECT DISTINCT slice_start, slice_days, total::BIGINT AS n, level, CASE WHEN total >= 100 THEN 'truncated' ELSE 'ok' END AS state FROM bisect WHERE NOT (total >= 100 AND slice_days > 1 AND level < 4))""")
def export_bisect(s, d):
    """Slices of sixty days of messages, halved while a hundred rows or more would be cut off."""
    days = message(s, d).groupBy(F.to_date("publish_time").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    start = F.lit("1995-01-01").cast("date")
    cut = days.select(F.date_add(start, (F.floor(F.datediff("day", start) / 60) * 60).cast("int")).alias("slice_start"), F.lit(60).alias("slice_days"), "day", "n")
    return I.bisected(cut, 100)


@query("SELECT strftime(starts, '%G-W%V') AS week, starts::DATE AS starts, (starts + INTERVAL 7 DAY)::DATE AS ends FROM (SELECT unnest(generate_series(TIMESTAMP '1998-12-14', TIMESTAMP '2000-01-10', INTERVAL 7 DAY)) AS starts)", plain=True)
def week_calendar(s, d):
    return I.week_grid("1998-12-17", "2000-01-10", s)


@query("""SELECT 'zero_match' AS gate, count(*) FILTER (n = 0)::DOUBLE AS value, count(*) FILTER (n = 0) = 0 AS passed FROM five UNION ALL SELECT 'volume', round((sum(n) - arg_max(n, week)) / 4, 6), arg_max(n, week) >= 0.5 * (sum(n) - arg_max(n, week)) / 4 FROM five
 UNION ALL SELECT 'alignment', round(v, 6), v <= 0.01 FROM (SELECT avg((seq = 7)::INTEGER) AS v FROM evidence) UNION ALL SELECT 'review', round(v, 6), v <= 0.4 FROM (SELECT avg((low_conf OR snippet IS NULL)::INTEGER) AS v FROM pool)""",
 "five AS (SELECT attach_week AS week, count(*) AS n FROM opp_evidence GROUP BY 1 ORDER BY 1 DESC LIMIT 5)")
def quality_gates(s, d):
    weeks = _opp(s, d).groupBy(F.col("attach_week").alias("week")).agg(F.count(F.lit(1)).alias("n"))
    reviewed = _pool(s, d).select((F.col("low_conf") | F.col("snippet").isNull()).alias("needs_review"))
    return I.quality_gates(weeks, evidence(s, d).select((F.col("seq") == 7).alias("misaligned")), reviewed)


@query("SELECT *, place > 20 AS left_out, CASE WHEN place > 20 THEN n ELSE greatest(n - 30, 0) END::BIGINT AS rows_cut FROM (SELECT *, row_number() OVER (ORDER BY n DESC, tag, channel) AS place FROM (SELECT tag, channel, count(*) AS n FROM pool GROUP BY ALL))")
def scope_account(s, d):
    """What limits of 20 buckets and 30 rows a bucket would leave out of the pool."""
    return I.scope_account(_pool(s, d), ["tag", "channel"], 20, 30)


@query("""SELECT field_set, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM (SELECT concat_ws('+', CASE WHEN content IS NOT NULL THEN 'content' END, CASE WHEN star IS NOT NULL THEN 'star' END, CASE WHEN len(spu) > 0 THEN 'spu' END, CASE WHEN len(brands) > 1 THEN 'brands' END) AS field_set FROM message) GROUP BY 1""")
def field_presence(s, d):
    """Which fields are filled together, with those that hold several values."""
    sets = message(s, d).select(F.concat_ws("+", F.when(F.col("content").isNotNull(), "content"), F.when(F.col("star").isNotNull(), "star"), F.when(F.size("spu") > 0, "spu"), F.when(F.size("brands") > 1, "brands")).alias("field_set"))
    counts = sets.groupBy("field_set").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("field_set", "n", C.ratio(F.col("n"), F.col("total"), 6).alias("share"))
