"""The registered queries of the training-data operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER, table
from .decontaminate import SLACK, decontaminate
from .fingerprint import edited_fingerprints
from .fixity import FILE_BITS, fixity, warc_record
from .licenses import CONTAINMENT, PHRASES, STRIDE, TEMPLATES, license_scan
from .line_dedup import line_dedup
from .near_dup import near_duplicates
from .packing import pack
from .simhash import simhash_duplicates
from .suffix_dedup import LENGTH, suffix_dedup
from .toxicity import score, train
from .url_filter import RULES, rule_index, url_filter
from .vector_codes import ENTRIES, PARTS, ROUNDS, vector_codes
from .whitening import whitened
from .whole_vectors import SCALE

ALNUM_SQL = r"regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')" % (UPPER, LOWER)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("matches")


def _op1_sql() -> str:
    phrase = lambda p: " AND ".join(f"w[i + {j}] = '{x}'" if j else f"w[i] = '{x}'" for j, x in enumerate(p.split(" ")))
    places = " || ".join(f"list_filter(range(1, len(w) - {len(p.split(' ')) - 2}), lambda i: {phrase(p)})" for p, _ in PHRASES)
    named = ", ".join(f"CASE WHEN len(list_filter(range(1, len(w) - {len(p.split(' ')) - 2}), lambda i: {phrase(p)})) > 0 THEN '{label}' END" for p, label in PHRASES)
    rows = ", ".join(f"('{label}', {sorted(set(t.split(' ')))!r})" for label, t in TEMPLATES)
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {ALNUM_SQL} AS w FROM documents),
t(label, words) AS (VALUES {rows}),
b AS (SELECT r, list_distinct(w[s + 1 : s + {2 * STRIDE}]) AS block
      FROM (SELECT r, w, unnest(range(0, greatest(len(w) - {STRIDE}, 1), {STRIDE})) AS s FROM d)),
m AS (SELECT r, label, len(list_intersect(words, block)) / len(words) AS share FROM b, t
      WHERE 100 * len(list_intersect(words, block)) >= {CONTAINMENT} * len(words)),
g AS (SELECT r, list(DISTINCT label) AS found, max(share) AS share FROM m GROUP BY r),
e AS (SELECT doc_id, r, len(w) AS n_words, {places} AS places, list_filter([{named}], lambda x: x IS NOT NULL) AS named FROM d)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
       array_to_string(list_sort(list_distinct(named)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(named || coalesce(found, []))), ',') AS labels,
       CASE WHEN len(named) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM e LEFT JOIN g USING (r)"""


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP2_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 85 * (na.n_shingles + nb.n_shingles - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT DISTINCT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n_shingles, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels tell toxic texts from others and say nothing of severity: grade 1 is a toxic text, grade 2 one that is labelled as of
    low quality too. Where no label is of grade 2, the model has one cut and is a logistic regression."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).drop("text")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


OP4_SQL = rf"""
WITH d AS (SELECT doc_id, {{words}} AS w FROM documents), i AS (SELECT item_id, {{words}} AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, w[s : s + 9] AS run FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS s FROM i WHERE len(w) > 0)),
k AS (SELECT DISTINCT len(run) AS k FROM v),
g AS (SELECT doc_id, s, k, w[s : s + k - 1] AS run FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, k)),
h AS (SELECT doc_id, s, k, item_id FROM g JOIN v ON g.run = v.run),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS items FROM h GROUP BY doc_id),
u AS (SELECT row_number() OVER () AS run_id, run FROM (SELECT DISTINCT run FROM v)),
o AS (SELECT run_id, len(run) AS k, unnest(run) AS term, unnest(range(len(run))) AS o FROM u),
p AS (SELECT doc_id, term, pos FROM (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d) WHERE term IN (SELECT term FROM o)),
c AS (SELECT term, count(*) AS c FROM p GROUP BY term),
r AS (SELECT run_id, k, term, o, row_number() OVER (PARTITION BY run_id ORDER BY coalesce(c, 0), o) AS rank FROM o LEFT JOIN c USING (term)),
a AS (SELECT doc_id, run_id, k, pos - o AS start FROM r JOIN p USING (term) WHERE rank = 1),
b AS (SELECT doc_id, run_id, pos - o AS start FROM r JOIN p USING (term) WHERE rank = 2),
m AS (SELECT doc_id, count(DISTINCT run_id) AS n_near FROM (
        SELECT a.doc_id, a.run_id FROM a JOIN b ON a.doc_id = b.doc_id AND a.run_id = b.run_id AND abs(a.start - b.start) <= {SLACK}
        UNION ALL SELECT doc_id, run_id FROM a WHERE k = 1) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN m USING (doc_id)""".format(words=ALNUM_SQL)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


OP6_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) AS m FROM (SELECT r, h, unnest(range(0, greatest(len(h) // 2 - {LENGTH - 1}, 0))) AS i FROM d)),
g AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
c AS (SELECT r, i FROM w JOIN g USING (m)),
f AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS fresh FROM c),
s AS (SELECT r, min(i) AS s, max(i) + {LENGTH} AS e FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS n FROM f) GROUP BY r, n),
p AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS before FROM s),
k AS (SELECT r, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS kept, max(e) AS last, sum(e - s) AS n_removed, count(*) AS n_spans FROM p JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN last IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN k USING (r)"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP7_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT doc_id, r, i, l[i : i + 2] AS run FROM (SELECT doc_id, r, l, unnest(range(1, len(l) - 1)) AS i FROM d)),
o AS (SELECT r, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, r, i) AS turn FROM w),
c AS (SELECT DISTINCT r, i + j AS i FROM o, (VALUES (0), (1), (2)) AS v(j) WHERE turn > 1),
s AS (SELECT r, count(*) AS n_removed, count(*) FILTER (starts) AS n_spans, list(i) AS gone
      FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i) < i - 1, true) AS starts FROM c) GROUP BY r)
SELECT doc_id, CASE WHEN n_removed > 0 THEN array_to_string([l[i] FOR i IN range(1, len(l) + 1) IF NOT list_contains(gone, i)], chr(10)) ELSE text END AS text,
       len(l) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN s USING (r)"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def _replica(pages: DataFrame) -> DataFrame:
    """A second copy of the pages with faults at known places: bytes changed, records lost, one record too many, records
    out of order (at the end of their archive) and gaps before records."""
    changed = F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("#"), F.substring(F.col("html"), F.lit(2), F.length("html")))).otherwise(F.col("html"))
    kept = pages.where((F.col("page_id") % 101 != 7) | F.col("page_id").isNull()).select("page_id", "url", changed.alias("html"))
    copy = kept.unionByName(pages.where(F.col("page_id") % 103 == 5).select((-1 - F.col("page_id")).alias("page_id"), "url", "html"))
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    copy = copy.withColumns({"size": F.length(record), "digest": F.sha2(record, 256), "late": F.col("page_id") % 107 == 11, "gap": F.when(F.col("page_id") % 109 == 17, 16).otherwise(0)})
    archive = F.floor(F.col("page_id") / F.lit(1 << FILE_BITS))
    before = Window.partitionBy(archive).orderBy("late", "page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return copy.withColumn("offset", F.coalesce(F.sum(F.col("size") + F.col("gap")).over(before), F.lit(0)) + F.col("gap")).select("page_id", "url", "html", "offset")


def op9_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return fixity(pages, _replica(pages), offset_col="offset")


OP9_SQL = rf"""
WITH b AS (SELECT page_id, encode(coalesce(html, '')) AS body, coalesce(url, '') AS url FROM pages),
x AS (SELECT -1 - page_id AS page_id, body, url, 'extra' AS state FROM b WHERE page_id % 103 = 5
      UNION ALL SELECT page_id, body, url, CASE WHEN page_id % 101 = 7 THEN 'missing' WHEN page_id % 97 = 13 THEN 'corrupt' ELSE 'ok' END FROM b),
r AS (SELECT page_id, state, encode('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
        || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || octet_length(body) || chr(13) || chr(10) || chr(13) || chr(10)) || body || encode(chr(13) || chr(10) || chr(13) || chr(10)) AS record FROM x),
m AS (SELECT page_id, (page_id >> {FILE_BITS})::BIGINT AS archive, octet_length(record) AS length, sha256(record) AS digest, state, page_id % 107 = 11 AS late FROM r),
o AS (SELECT *, CASE WHEN page_id % 109 = 17 THEN 16 ELSE 0 END AS gap, max(page_id) FILTER (state <> 'missing') OVER (PARTITION BY archive ORDER BY late, page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM m)
SELECT page_id, archive, CASE WHEN state = 'extra' THEN coalesce(sum(length + gap) FILTER (state = 'extra') OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + gap
       ELSE coalesce(sum(length) FILTER (state <> 'extra') OVER (PARTITION BY archive ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END::BIGINT AS offset,
       length, digest, CASE WHEN state = 'ok' AND (gap > 0 OR coalesce(ahead > page_id, false)) THEN 'moved' ELSE state END AS state FROM o"""


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def _op10_sql() -> str:
    cases = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{t}'" for t, _, h, p in rule_index(RULES))
    own = " ".join(f"WHEN '{t}' THEN '{v}'" for t, v, _, _ in rule_index(RULES))
    low = f"'{UPPER}', '{LOWER}'"
    host = lambda u: f"translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), {low})"
    rest = lambda u: rf"regexp_replace(regexp_extract({u}, '(?s)^.*?://[^/?#]*(.*)', 1), '(?s)#.*', '')"
    # RE2 has no look-behind: the separator is captured and put back, twice for arguments that follow one another.
    strip = lambda x: rf"regexp_replace({x}, '([?&])(?:(?:utm_[a-z]+|fbclid|gclid|ref)=[^&#]*(?:&|$))+', '\1', 'g')"
    key = lambda u: rf"CASE WHEN contains({u}, '://') THEN {host(u)} || regexp_replace({strip(rest(u))}, '[/?&]+$', '') END"
    return rf"""
WITH RECURSIVE p AS (SELECT page_id, url, html, coalesce({host('url')}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, {key('url')} AS alias FROM pages),
j AS (SELECT *, CASE {cases} END AS rule FROM p),
v AS (SELECT *, CASE rule {own} END AS own FROM j),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM p WHERE contains(url, '://')),
raw AS (SELECT url, regexp_extract(tag, '(?is)\b(?:href|url)\s*=\s*["'']?\s*([^"''\s>;]+)', 1) AS t FROM tags
        WHERE regexp_matches(tag, '(?is)rel\s*=\s*["'']?canonical\b') OR regexp_matches(tag, '(?is)http-equiv\s*=\s*["'']?refresh\b')),
parts AS (SELECT *, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM raw WHERE t <> '' AND NOT starts_with(t, '#')),
joined AS (SELECT *, CASE WHEN starts_with(t, '/') THEN t WHEN starts_with(t, '?') THEN (CASE WHEN path = '' THEN '/' ELSE path END) || t ELSE regexp_extract(path, '(?s)^(.*)/', 1) || '/' || t END AS whole FROM parts),
cleaned AS (SELECT *, array_to_string(list_reduce(list_transform(string_split(regexp_extract(whole, '(?s)^[^?#]*', 0), '/'), lambda x: [x]),
        lambda done, x: CASE WHEN x[1] = '..' THEN done[1 : greatest(len(done) - 1, 1)] WHEN x[1] = '.' THEN done ELSE done || x END), '/') || regexp_extract(whole, '(?s)^[^?#]*(.*)', 1) AS rest FROM joined),
links AS (SELECT {key('url')} AS a, CASE WHEN regexp_matches(t, '(?i)^[a-z][a-z0-9+.-]*://') THEN t WHEN regexp_matches(t, '(?i)^[a-z][a-z0-9+.-]*:') THEN NULL
        WHEN starts_with(t, '//') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || t ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || rest END AS target FROM cleaned),
e AS (SELECT a, {key('target')} AS b, {host('target')} AS host, regexp_extract(target, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM links WHERE contains(target, '://') AND a IS NOT NULL),
ends AS (SELECT b AS alias, CASE {cases} END AS rule FROM e),
voters AS (SELECT alias, own FROM v UNION ALL SELECT alias, CASE rule {own} END FROM ends),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT DISTINCT alias, alias FROM voters WHERE alias IS NOT NULL UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
votes AS (SELECT reach.a AS alias, bool_or(own = 'allow') AS allowed, bool_or(own = 'block') AS blocked FROM reach JOIN voters ON voters.alias = reach.b WHERE own IS NOT NULL GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN blocked AND NOT allowed THEN 'block' END, 'allow') AS verdict
FROM v LEFT JOIN votes USING (alias)"""


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is null where 63 bits do not hold it (some three million rows of this spread); exact_deviation always does."""
    found = whitened(table(spark, sf_dir, "embeddings"))
    return found.withColumns({"exact_deviation": F.col("deviation"), "deviation": F.col("deviation").try_cast("long")})


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings")).drop("label")


def _op12_sql() -> str:
    nearest = """a{n} AS MATERIALIZED (SELECT r, part, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
        SELECT r, part, e, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN b{n} b USING (part)) GROUP BY r, part)"""
    # Sums and counts stay far under 2^53, so the quotient's floor is exact.
    update = """b{m} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN (SELECT part, e, list(q ORDER BY i) AS x FROM (
        SELECT part, e, i, floor(sum(p.x[i]) / count(*))::BIGINT AS q FROM p JOIN a{n} USING (r, part), (SELECT unnest(range(1, max(len(x)) + 1)) AS i FROM p) GROUP BY part, e, i) GROUP BY part, e) m USING (part, e))"""
    rounds = [nearest.format(n=0)]
    for n in range(ROUNDS):
        rounds += [update.format(n=n, m=n + 1), nearest.format(n=n + 1)]
    last = ROUNDS
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, x, row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS r FROM (
        SELECT vec_id, label, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS x FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)),
p AS MATERIALIZED (SELECT r, part, x[part * len(x) // {PARTS} + 1 : (part + 1) * len(x) // {PARTS}] AS x FROM v, (SELECT unnest(range({PARTS})) AS part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS e, x FROM p WHERE r <= {ENTRIES}),
{", ".join(rounds)},
s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{last}),
c AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN c USING (r), s"""


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_toxicity": op3_toxicity,
    "op4_decontamination": op4_decontamination,
    "op5_fingerprints": op5_fingerprints,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_packing": op8_packing,
    "op9_merkle_audit": op9_merkle_audit,
    "op10_url_filter": op10_url_filter,
    "op11_whitening": op11_whitening,
    "op12_vector_codes": op12_vector_codes,
    "op13_simhash": op13_simhash,
}
ORACLE_SQL = {
    "op1_license_scan": _op1_sql(),
    "op2_near_duplicates": OP2_SQL,
    "op4_decontamination": OP4_SQL,
    "op6_suffix_dedup": OP6_SQL,
    "op7_line_dedup": OP7_SQL,
    "op9_merkle_audit": OP9_SQL,
    "op10_url_filter": _op10_sql(),
    "op12_vector_codes": _op12_sql(),
}
