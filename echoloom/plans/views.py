"""Registered queries of the dashboard views, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import board as B
from ..operators import core as C
from ..operators import views as V
from ..sources.fixtures import evidence, message, read
from ..sources.settled import stored
from ..operators.rank import numbered
from .queries import AS_OF, BY_SPU, CONTAINER, ISSUES, _by_spu, _container, _issues, _opp, _pool, query

#: Opportunities with flags made from their names and counts, for DuckDB.
OPPS = """opps AS (SELECT opp_id, CASE WHEN bool_or(rule = 'R1') THEN 'existing_product' ELSE 'innovation' END AS opp_type, count(*) AS n, CASE WHEN length(opp_id) % 7 = 0 THEN 'invalid' ELSE 'valid' END AS state,
  CASE WHEN length(opp_id) % 5 = 0 THEN 'x' END AS merged_into, length(opp_id) % 3 = 0 AS backlog, count(DISTINCT src_line) > 1 AS dual_source, count(*) < 8 AS weak_evidence, length(opp_id) % 4 = 1 AS safety, length(opp_id) % 2 = 1 AS needs_review, max(publish_time) AS updated_at FROM opp_evidence GROUP BY opp_id)"""
PROPOSALS = """proposals AS (SELECT row_number() OVER (ORDER BY opp_id) AS proposal_id, CASE WHEN n % 2 = 0 THEN 'MERGE' ELSE 'SPLIT' END AS op, [opp_id, opp_id || 'x'] AS opp_ids, CASE WHEN n % 3 = 0 THEN 'accepted' ELSE 'pending' END AS status, updated_at AS created_at FROM opps)"""
OWNERS = """owners AS (SELECT opp_id, ['considering', 'in_progress', 'project', 'done'][(n % 4 + 1)::INTEGER] AS status, updated_at AS status_at FROM opps WHERE n % 5 > 0)"""
HUMAN = """human AS (SELECT spu, opp_id, ['considering', 'in_progress', 'project', 'done', 'dismissed'][n % 5 + 1] AS status, 7::BIGINT AS baseline FROM (SELECT spu, opp_id, length(spu) + length(opp_id) AS n FROM issues) WHERE n % 6 > 0
  UNION ALL SELECT 'P-old', opp_id, 'done', 5 FROM opps WHERE n % 2 = 0)"""
TAGGED = """tagged AS (SELECT DISTINCT named AS spu, sentiment, nullif(trim(split_part(tax_path, '/', 2)), '') AS domain, nullif(trim(split_part(tax_path, '/', 3)), '') AS sub, nullif(trim(split_part(tax_path, '/', 4)), '') AS leaf
  FROM (SELECT message_id, unnest(spu) AS named FROM message) JOIN evidence USING (message_id))"""


def _opps(s, d):
    n = F.length("opp_id")
    rows = _opp(s, d).groupBy("opp_id").agg(F.when(F.bool_or(F.col("rule") == "R1"), "existing_product").otherwise("innovation").alias("opp_type"), F.count(F.lit(1)).alias("n"), (F.count_distinct("src_line") > 1).alias("dual_source"), (F.count(F.lit(1)) < 8).alias("weak_evidence"), F.max("publish_time").alias("updated_at"))
    made = {"state": F.when(n % 7 == 0, "invalid").otherwise("valid"), "merged_into": F.when(n % 5 == 0, "x"), "backlog": n % 3 == 0, "safety": n % 4 == 1, "needs_review": n % 2 == 1}
    return stored(s, d, "opportunities", lambda: rows.withColumns(made))


def _proposals(s, d):
    from pyspark.sql import Window as W

    # A row for each opportunity of the example; their number is a serial number of a small table.
    n = F.col("n")
    return _opps(s, d).select(F.row_number().over(W.orderBy("opp_id")).cast("long").alias("proposal_id"), F.when(n % 2 == 0, "MERGE").otherwise("SPLIT").alias("op"), F.array("opp_id", F.concat("opp_id", F.lit("x"))).alias("opp_ids"), F.when(n % 3 == 0, "accepted").otherwise("pending").alias("status"), F.col("updated_at").alias("created_at"))


def _owners(s, d):
    return _opps(s, d).where("n % 5 > 0").select("opp_id", F.get(F.array(*map(F.lit, ("considering", "in_progress", "project", "done"))), (F.col("n") % 4).cast("int")).alias("status"), F.col("updated_at").alias("status_at"))


def _human(s, d):
    n = F.length("spu") + F.length("opp_id")
    own = _issues(s, d).where(n % 6 > 0).select("spu", "opp_id", F.get(F.array(*map(F.lit, V.STATUSES[:5])), n % 5).alias("status"), F.lit(7).cast("long").alias("baseline"))
    old = _opps(s, d).where("n % 2 = 0").select(F.lit("P-old").alias("spu"), "opp_id", F.lit("done").alias("status"), F.lit(5).cast("long").alias("baseline"))
    return own.unionByName(old)


def _named(s, d):
    return _container(s, d).withColumns({"names": F.array(F.concat(F.lit("Name "), "spu")), "skus": F.array(F.concat("spu", F.lit("-a")), F.lit(None).cast("string"))})


def _tagged(s, d):
    codes = message(s, d).select("message_id", F.explode("spu").alias("spu"))
    tax = T.tax_levels(F.col("tax_path"))
    rows = codes.join(evidence(s, d).select("message_id", "sentiment", tax["stage"].alias("domain"), tax["domain"].alias("sub"), tax["sub"].alias("leaf")), "message_id")
    return stored(s, d, "tagged", lambda: rows.drop("message_id").distinct())


@query("""SELECT place, status, n, sum(n) OVER ()::BIGINT AS total, round(100 * n / nullif(sum(n) OVER (), 0)::DOUBLE, 1) AS percent FROM (SELECT place, g.status, coalesce(n, 0) AS n
 FROM (VALUES (1, 'considering'), (2, 'in_progress'), (3, 'project'), (4, 'done'), (5, 'dismissed'), (6, 'none')) g(place, status) LEFT JOIN (SELECT coalesce(h.status, 'none') AS status, count(*) AS n FROM issues LEFT JOIN human h USING (spu, opp_id) GROUP BY 1) USING (status))""", BY_SPU, ISSUES, OPPS, HUMAN)  # fmt: skip
def status_mix(s, d):
    return V.status_mix(_issues(s, d), _human(s, d))


FRESH = """fresh AS (SELECT 'freshness' AS row_type, latest, weeks, issues, dangling, round(100 * dangling / nullif(issues, 0)::DOUBLE, 1) AS dangling_percent, NULL::BIGINT AS run_id, NULL AS stage, NULL::TIMESTAMP AS started_at
  FROM (SELECT max(publish_time) AS latest, count(DISTINCT date_trunc('week', publish_time)) AS weeks FROM message), (SELECT count(*) AS issues, count(*) FILTER (o.opp_id IS NULL) AS dangling FROM issues i LEFT JOIN (SELECT opp_id FROM opps WHERE merged_into IS NULL) o USING (opp_id)))"""


@query("SELECT * FROM fresh UNION ALL SELECT * FROM (SELECT 'run', NULL, NULL, NULL, NULL, NULL, event_id, event_type, ts FROM events ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 5)", BY_SPU, ISSUES, OPPS, FRESH)
def home_freshness(s, d):
    runs = read(s, d, "events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("stage"), F.col("ts").alias("started_at"))
    return V.freshness(message(s, d), _issues(s, d), _opps(s, d), runs)


@query("""SELECT 'zero_yield' AS alert, source AS subject FROM cover WHERE evidence >= 50 AND opps = 0 UNION ALL SELECT 'dangling', 'issues' FROM fresh WHERE dangling_percent > 5""", BY_SPU, ISSUES, OPPS, FRESH,
 "cover AS (SELECT country AS source, count(*) AS evidence, count(DISTINCT opp_id) FILTER (country < 'M') AS opps FROM opp_evidence GROUP BY 1)")
def home_alerts(s, d):
    cover = _opp(s, d).groupBy(F.col("country").alias("source")).agg(F.count(F.lit(1)).alias("evidence"), F.count_distinct(F.when(F.col("country") < "M", F.col("opp_id"))).alias("opps"))
    return V.panel_alerts(cover, home_freshness(s, d))


@query("""SELECT pool, pool_attached, round(100 * pool_attached / nullif(pool, 0)::DOUBLE, 2) AS coverage_percent, active, backlog, dual_source, weak, safety, needs_review, pending, unclassified FROM
 (SELECT count(*) AS pool FROM evidence e JOIN message m USING (message_id) WHERE is_product AND NOT low_conf AND sentiment = 'neg' AND snippet IS NOT NULL AND src_line = 'commerce' AND len(m.spu) > 0),
 (SELECT count(DISTINCT (message_id, seq)) AS pool_attached FROM opp_evidence WHERE is_product AND NOT low_conf AND sentiment = 'neg' AND src_line = 'commerce' AND len(spu) > 0),
 (SELECT count(*) FILTER (NOT backlog) AS active, count(*) FILTER (backlog) AS backlog, count(*) FILTER (dual_source) AS dual_source, count(*) FILTER (weak_evidence) AS weak, count(*) FILTER (safety) AS safety, count(*) FILTER (needs_review) AS needs_review FROM opps WHERE state = 'valid'),
 (SELECT count(*) AS pending FROM proposals p WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM opps o WHERE o.state = 'invalid' AND list_contains(p.opp_ids, o.opp_id))), (SELECT count(*) AS unclassified FROM candidates WHERE rule = 'R3')""", OPPS, PROPOSALS)  # fmt: skip
def metrics_row(s, d):
    from ..sources.fixtures import policy

    out = C.pool_candidates(evidence(s, d), message(s, d), policy(s)).where("rule = 'R3'")
    return V.metrics_row(evidence(s, d), message(s, d), _opp(s, d), _opps(s, d), _proposals(s, d), out)


VIEW = f"""board AS (SELECT o.*, coalesce(w.status, 'considering') AS status, status_at, coalesce(coalesce(w.status, 'considering') IN ('in_progress', 'project') AND status_at < TIMESTAMP '{AS_OF}' - INTERVAL 56 DAY, false) AS stale FROM opps o LEFT JOIN owners w USING (opp_id) WHERE state = 'valid')"""


@query("SELECT opp_id, opp_type, n, status, status_at, stale FROM board", OPPS, OWNERS, VIEW)
def board_view(s, d):
    return V.board_view(_opps(s, d), _owners(s, d), AS_OF).select("opp_id", "opp_type", "n", "status", "status_at", "stale")


@query(f"""SELECT kind, ref, sub_kind, array_to_string(opp_ids, ',') AS opp_ids, since, date_sub('day', since, TIMESTAMP '{AS_OF}') AS waiting_days FROM (
 SELECT 'proposal' AS kind, proposal_id::VARCHAR AS ref, op AS sub_kind, opp_ids, created_at AS since FROM proposals p WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM opps o WHERE o.state = 'invalid' AND list_contains(p.opp_ids, o.opp_id))
 UNION ALL SELECT 'needs_review', opp_id, opp_type, [opp_id], updated_at FROM opps WHERE needs_review AND NOT backlog AND state = 'valid' UNION ALL SELECT 'stale_status', opp_id, status, [opp_id], status_at FROM board WHERE stale)""", OPPS, OWNERS, PROPOSALS, VIEW)  # fmt: skip
def inbox(s, d):
    board = V.board_view(_opps(s, d), _owners(s, d), AS_OF)
    return V.inbox(_proposals(s, d), _opps(s, d), board, AS_OF).withColumn("opp_ids", F.array_join("opp_ids", ","))


@query("""SELECT spu, opp_id, coalesce(evi_count, actual, baseline, 0) AS evi_count, evi_count IS NULL AS historical, coalesce(status, 'considering') AS status, coalesce(recent, 0) AS recent FROM keys LEFT JOIN issues USING (spu, opp_id) LEFT JOIN human USING (spu, opp_id) LEFT JOIN told USING (spu, opp_id)""", BY_SPU, ISSUES, OPPS, HUMAN, f"""keys AS (SELECT spu, opp_id FROM issues JOIN opps USING (opp_id) WHERE merged_into IS NULL UNION SELECT spu, opp_id FROM human JOIN opps USING (opp_id) WHERE state = 'valid' AND opp_type = 'existing_product'),
 told AS (SELECT spu, opp_id, count(*) AS actual, count(*) FILTER (publish_time >= TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY) AS recent FROM by_spu GROUP BY ALL)""")  # fmt: skip
def issue_history(s, d):
    return V.issue_history(_issues(s, d), _by_spu(s, d), _opps(s, d), _human(s, d), AS_OF)


@query("""SELECT 'text' AS search, spu FROM container WHERE spu ILIKE '%p1%' OR ('Name ' || spu) ILIKE '%p1%' OR (spu || '-a') ILIKE '%p1%' UNION ALL SELECT 'category', spu FROM container WHERE coalesce(category, 'unclassified') = 'BUILDING'
 UNION ALL SELECT 'domain', spu FROM container WHERE spu IN (SELECT spu FROM tagged WHERE sentiment = 'neg' AND domain = 'ECONOMY') UNION ALL SELECT 'sub', spu FROM container WHERE spu IN (SELECT spu FROM tagged WHERE sentiment = 'neg' AND domain = 'ECONOMY' AND sub = 'Brand#13')
 UNION ALL SELECT 'leaf', spu FROM container WHERE spu IN (SELECT spu FROM tagged WHERE sentiment = 'neg' AND domain = (SELECT min(domain) FROM tagged) AND sub = (SELECT min(sub) FROM tagged) AND leaf = (SELECT min(leaf) FROM tagged))""", CONTAINER, TAGGED)  # fmt: skip
def product_search_by_tag(s, d):
    """Each search of the page, side by side."""
    c, t = _named(s, d), _tagged(s, d)
    low = t.agg(*[F.min(x) for x in ("domain", "sub", "leaf")]).first()
    asked = {"text": {"text": "p1"}, "category": {"category": "BUILDING"}, "domain": {"domain": "ECONOMY"}, "sub": {"domain": "ECONOMY", "sub": "Brand#13"}, "leaf": dict(zip(("domain", "sub", "leaf"), low, strict=True))}
    out = None
    for name, how in asked.items():
        rows = V.search(c, t, **how).select(F.lit(name).alias("search"), "spu")
        out = rows if out is None else out.unionByName(rows)
    return out


FACETS = """hits AS (SELECT DISTINCT spu, domain, sub, leaf FROM tagged WHERE sentiment = 'neg' AND trim(domain) <> '' AND spu IN (SELECT spu FROM container WHERE spu ILIKE '%1%')),
 facets AS (SELECT 'domain' AS level, domain, NULL::VARCHAR AS sub, NULL::VARCHAR AS leaf, count(DISTINCT spu) AS n FROM hits GROUP BY domain UNION ALL SELECT 'sub', domain, sub, NULL::VARCHAR, count(DISTINCT spu) FROM hits WHERE trim(sub) <> '' GROUP BY domain, sub
  UNION ALL SELECT 'leaf', domain, sub, leaf, count(DISTINCT spu) FROM hits WHERE trim(sub) <> '' AND trim(leaf) <> '' GROUP BY domain, sub, leaf)"""


@query("SELECT * FROM facets", CONTAINER, TAGGED, FACETS)
def search_facets(s, d):
    return V.search_facets(V.search(_named(s, d), _tagged(s, d), "1").where(F.col("spu").contains("1")), _tagged(s, d))


@query("""SELECT level, domain, sub, leaf, n, coalesce(CASE level WHEN 'domain' THEN domain = 'ECONOMY' ELSE domain = 'ECONOMY' AND sub = 'Brand#13' AND level = 'sub' END, false) AS selected,
 CASE level WHEN 'domain' THEN true WHEN 'sub' THEN domain = 'ECONOMY' ELSE domain = 'ECONOMY' AND sub = 'Brand#13' END AS visible FROM facets""", "facets AS (SELECT 'domain' AS level, tag AS domain, NULL::VARCHAR AS sub, NULL::VARCHAR AS leaf, count(*) AS n FROM evidence GROUP BY tag UNION ALL SELECT 'sub', tag, brand, NULL::VARCHAR, count(*) FROM evidence GROUP BY tag, brand UNION ALL SELECT 'leaf', tag, brand, code, count(*) FROM evidence GROUP BY tag, brand, code)")  # fmt: skip
def facet_chain(s, d):
    """A valid domain and sub, and a leaf that is not under them."""
    e, none = evidence(s, d), F.lit(None).cast("string")
    level = lambda name, *c: e.groupBy(*c).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("level"), F.col("tag").alias("domain"), (F.col("brand") if len(c) > 1 else none).alias("sub"), (F.col("code") if len(c) > 2 else none).alias("leaf"), "n")
    facets = level("domain", "tag").unionByName(level("sub", "tag", "brand")).unionByName(level("leaf", "tag", "brand", "code"))
    return V.facet_chain(facets, "ECONOMY", "Brand#13", "nowhere")


RECORDS = """kinds AS (SELECT *, CASE rule WHEN 'R1' THEN 'existing_product' ELSE 'innovation' END AS opp_type, left(regexp_replace(trim(evidence_text), '\\s+', ' ', 'g'), 200) AS t FROM opp_evidence),
 texts AS (SELECT opp_id, opp_type, t, min((message_id, seq)) AS place FROM kinds WHERE t <> '' GROUP BY ALL),
 told AS (SELECT opp_id, opp_type, (list(t ORDER BY place))[1:5] AS rep_snippets FROM texts GROUP BY opp_id, opp_type),
 sums AS (SELECT opp_id, opp_type, '{' || string_agg('"' || src_line || '":' || n, ',' ORDER BY src_line) || '}' AS evi_by_source FROM (SELECT opp_id, opp_type, src_line, count(*) AS n FROM kinds GROUP BY ALL) GROUP BY opp_id, opp_type),
 records AS (SELECT k.opp_id, k.opp_type, count(*) AS evi_total, list_sort(list(DISTINCT src_line)) AS source_lines, any_value(evi_by_source) AS evi_by_source, coalesce(list_sort(list(DISTINCT category) FILTER (category IS NOT NULL)), []) AS category_set, list_sort(list(DISTINCT country)) AS countries,
  list_sort(list(DISTINCT brand))[1:5] AS product_names, round(avg(CASE WHEN star <= 2 THEN 1.0::DOUBLE WHEN star IS NOT NULL THEN 0 END), 4) AS low_star_rate, any_value(rep_snippets) AS rep_snippets, min(src_line) AS src_line
  FROM kinds k JOIN sums USING (opp_id, opp_type) LEFT JOIN told USING (opp_id, opp_type) GROUP BY k.opp_id, k.opp_type)"""


def _records(s, d):
    rows = _opp(s, d).withColumns({"opp_type": C.opp_type(F.col("rule")), "product_name": F.col("brand")})
    return stored(s, d, "records", lambda: V.opportunity_records(rows))


@query("SELECT * FROM records", RECORDS)
def opportunity_records(s, d):
    return _records(s, d)


@query("SELECT opp_id, opp_type, evi_total <= 2 AS weak_evidence, len(source_lines) >= 2 AS dual_source FROM records", RECORDS)
def source_flags(s, d):
    return V.source_flags(_records(s, d)).select("opp_id", "opp_type", "weak_evidence", "dual_source")


@query("""SELECT message_id, seq, '[' || concat_ws(' | ', 'star ' || star, country, category, nullif(array_to_string(brands, '/'), '')) || '] ' || left(regexp_replace(coalesce(evidence_text, ''), '[\\r\\n]+', ' ', 'g'), 400) AS line FROM pool""")
def evidence_lines(s, d):
    return V.evidence_lines(_pool(s, d))


_SORTED = """boards AS (SELECT spu, message_count, avg_star, CASE WHEN length(spu) = 2 THEN ['B级', 'PS', 'x', 'A'][message_count % 4 + 1] END AS grade, coalesce(round(negative_evi_count / nullif(negative_evi_count + positive_evi_count, 0)::DOUBLE, 6), 0) AS negative_ratio, message_count % 5 AS issue_count FROM container),
 ranked AS (SELECT spu, grade, CASE grade WHEN 'PS' THEN 1 WHEN 'A' THEN 3 WHEN 'B级' THEN 4 WHEN 'x' THEN 7 END AS grade_rank, message_count, avg_star, negative_ratio, issue_count FROM boards)"""


@query("""SELECT 'ratio' AS sort, spu, place FROM (SELECT spu, row_number() OVER (ORDER BY negative_ratio DESC NULLS LAST, spu) AS place FROM ranked) UNION ALL SELECT 'messages', spu, row_number() OVER (ORDER BY message_count NULLS LAST, spu) FROM ranked
 UNION ALL SELECT 'issues', spu, row_number() OVER (ORDER BY issue_count DESC NULLS LAST, spu) FROM ranked UNION ALL SELECT 'star', spu, row_number() OVER (ORDER BY avg_star NULLS LAST, spu) FROM ranked UNION ALL SELECT 'grade', spu, row_number() OVER (ORDER BY grade_rank DESC NULLS LAST, spu) FROM ranked
 UNION ALL SELECT 'grade up', spu, row_number() OVER (ORDER BY grade_rank NULLS LAST, spu) FROM ranked UNION ALL SELECT 'unknown', spu, row_number() OVER (ORDER BY negative_ratio DESC NULLS LAST, spu) FROM ranked""", CONTAINER, _SORTED)  # fmt: skip
def board_sorts(s, d):
    """The board by each of its keys: the place of each product."""
    n = F.col("message_count")
    rows = _container(s, d).withColumns({"grade": F.when(F.length("spu") == 2, F.get(F.array(*map(F.lit, ("B级", "PS", "x", "A"))), (n % 4).cast("int"))), "negative_ratio": F.coalesce(C.ratio(F.col("negative_evi_count"), F.col("negative_evi_count") + F.col("positive_evi_count"), 6), F.lit(0.0)), "issue_count": n % 5})
    out = None
    for name, key, down in (("ratio", "ratio", True), ("messages", "messages", False), ("issues", "issues", True), ("star", "star", False), ("grade", "grade", True), ("grade up", "grade", False), ("unknown", "nonsense", True)):
        part = numbered(rows, *V.board_order(key, down), name="place").select(F.lit(name).alias("sort"), "spu", "place")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""SELECT spu, category, avg_star, message_count, issue_count, evi_count, coalesce(recent_evi_count, 0) AS recent_evi_count, row_number() OVER (ORDER BY evi_count DESC, spu) AS rank FROM (SELECT spu, count(*) AS issue_count, sum(evi_count)::BIGINT AS evi_count FROM issues GROUP BY spu) LEFT JOIN container USING (spu)
 LEFT JOIN (SELECT spu, count(*) AS recent_evi_count FROM by_spu WHERE publish_time >= TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY AND publish_time <= TIMESTAMP '{AS_OF}' GROUP BY spu) USING (spu)
 WHERE spu IN (SELECT m.spu FROM revivals m JOIN issues i ON i.spu = m.spu AND i.opp_id = m.opp_id JOIN opps o ON o.opp_id = m.opp_id WHERE m.status = 'considering' AND m.revived_at IS NOT NULL AND o.merged_into IS NULL)""", BY_SPU, ISSUES, CONTAINER, OPPS, """revivals AS (SELECT spu, opp_id, CASE WHEN evi_count % 4 = 0 THEN 'done' ELSE 'considering' END AS status, CASE WHEN (evi_count + length(spu)) % 9 = 0 THEN 1 END AS revived_at FROM issues UNION ALL SELECT 'P-gone', min(opp_id), 'considering', 1 FROM issues)""")  # fmt: skip
def board_list_revived(s, d):
    """The board of products with an issue that is open again, by evidence."""
    issues = _issues(s, d)
    n = F.col("evi_count")
    manual = issues.select("spu", "opp_id", F.when(n % 4 == 0, "done").otherwise("considering").alias("status"), F.when((n + F.length("spu")) % 9 == 0, 1).alias("revived_at"))
    manual = manual.unionByName(issues.agg(F.min("opp_id").alias("opp_id")).select(F.lit("P-gone").alias("spu"), "opp_id", F.lit("considering").alias("status"), F.lit(1).alias("revived_at")))
    board = B.board_list(_container(s, d), issues, _opp(s, d), AS_OF, "evidence", only=B.revived_products(issues, manual, _opps(s, d)))
    return board.drop("wilson", "negative_ratio")
