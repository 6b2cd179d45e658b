"""Registered queries of decisions and write-back, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import core as C
from ..operators import manage as M
from ..operators.lifecycle import canonical
from ..operators.write import audit, locked_update, moved_sources, upsert
from ..sources.fixtures import read
from .queries import BY_SPU, ISSUES, RECOUNT, _candidates, _issues, _opp, _pool, query
from .views import OPPS, OWNERS, _opps, _owners

CHAIN = """chain AS (SELECT opp_id, CASE WHEN n % 4 = 0 THEN lead(opp_id) OVER (ORDER BY opp_id) WHEN n % 11 = 1 THEN 'gone' END AS merged_into, safety FROM opps),
 walk AS (SELECT opp_id, opp_id AS here, merged_into AS nxt, 0 AS steps FROM chain UNION ALL SELECT w.opp_id, c.opp_id, c.merged_into, steps + 1 FROM walk w JOIN chain c ON c.opp_id = w.nxt WHERE steps < 30),
 roots AS (SELECT opp_id, max(CASE WHEN nxt IS NULL AND steps <= 20 THEN here END) AS root FROM walk GROUP BY opp_id)"""


def _chain(s, d):
    from pyspark.sql import Window as W

    # A table of one row for each opportunity: the next one by name is its neighbour here.
    n = F.col("n")
    return _opps(s, d).select("opp_id", F.when(n % 4 == 0, F.lead("opp_id").over(W.orderBy("opp_id"))).when(n % 11 == 1, "gone").alias("merged_into"), "safety")


@query("""SELECT opp_id, action, CASE action WHEN 'create' THEN opp_id WHEN 'attach' THEN root WHEN 'update' THEN root END AS target FROM (SELECT n.opp_id, r.root, CASE WHEN c.opp_id IS NULL THEN 'create' WHEN r.root IS NULL THEN 'broken' WHEN r.root <> n.opp_id AND k.safety THEN 'refuse' WHEN r.root <> n.opp_id THEN 'attach' ELSE 'update' END AS action
 FROM (SELECT opp_id FROM chain UNION ALL SELECT opp_id || '-new' FROM chain) n LEFT JOIN chain c USING (opp_id) LEFT JOIN roots r USING (opp_id) LEFT JOIN chain k ON k.opp_id = r.root)""", OPPS, CHAIN)  # fmt: skip
def save_plan(s, d):
    known = _chain(s, d)
    new = known.select("opp_id").unionByName(known.select(F.concat("opp_id", F.lit("-new")).alias("opp_id")))
    return M.save_plan(new, known, canonical(known))


CHANGES = """changes AS (SELECT spu, opp_id, CASE n % 4 WHEN 0 THEN 'dismissed' WHEN 1 THEN 'done' WHEN 2 THEN 'odd' ELSE 'considering' END AS status, CASE WHEN n % 3 = 0 THEN ' ' ELSE 'note ' || n END AS note, evi_count AS baseline, TIMESTAMP '2001-07-01' AS moment
  FROM (SELECT spu, opp_id, evi_count, evi_count + length(spu) AS n FROM issues) WHERE n % 5 <> 1 UNION ALL SELECT 'P-none', opp_id, 'done', NULL, 1, TIMESTAMP '2001-07-02' FROM opps WHERE n % 3 = 0),
 held AS (SELECT spu, opp_id, CASE WHEN evi_count % 2 = 0 THEN 'dismissed' ELSE 'done' END AS status, 'old' AS note, CASE WHEN evi_count % 2 = 0 THEN 3::BIGINT END AS baseline, TIMESTAMP '2000-01-01' AS closed_at FROM issues WHERE evi_count % 3 = 0)"""


def _changes(s, d):
    n = F.col("evi_count") + F.length("spu")
    own = _issues(s, d).where(n % 5 != 1).select("spu", "opp_id", F.when(n % 4 == 0, "dismissed").when(n % 4 == 1, "done").when(n % 4 == 2, "odd").otherwise("considering").alias("status"), F.when(n % 3 == 0, " ").otherwise(F.concat(F.lit("note "), n.cast("string"))).alias("note"), F.col("evi_count").alias("baseline"), F.lit("2001-07-01").cast("timestamp").alias("at"))
    none = _opps(s, d).where("n % 3 = 0").select(F.lit("P-none").alias("spu"), "opp_id", F.lit("done").alias("status"), F.lit(None).cast("string").alias("note"), F.lit(1).cast("long").alias("baseline"), F.lit("2001-07-02").cast("timestamp").alias("at"))
    return own.unionByName(none)


def _held(s, d):
    n = F.col("evi_count")
    return _issues(s, d).where(n % 3 == 0).select("spu", "opp_id", F.when(n % 2 == 0, "dismissed").otherwise("done").alias("status"), F.lit("old").alias("note"), F.when(n % 2 == 0, F.lit(3).cast("long")).alias("baseline"), F.lit("2000-01-01").cast("timestamp").alias("closed_at"))


@query("""SELECT spu, opp_id, status, coalesce(cnote, onote) AS note, CASE WHEN status = 'dismissed' THEN coalesce(obase, cbase) ELSE obase END AS baseline, CASE WHEN status IN ('done', 'dismissed') THEN CASE WHEN cstatus IS NOT NULL AND cstatus IS DISTINCT FROM ostatus THEN moment ELSE closed_at END END AS closed_at FROM (
 SELECT spu, opp_id, coalesce(c.status, h.status) AS status, c.status AS cstatus, h.status AS ostatus, c.note AS cnote, h.note AS onote, c.baseline AS cbase, h.baseline AS obase, moment, closed_at FROM held h FULL JOIN changes c USING (spu, opp_id))""", BY_SPU, ISSUES, OPPS, CHANGES)  # fmt: skip
def status_upsert(s, d):
    return M.upsert_status(_held(s, d), _changes(s, d), ["spu", "opp_id"])


@query("SELECT spu, opp_id, error FROM (SELECT c.spu, c.opp_id, CASE WHEN c.status = 'odd' THEN 'unknown status' WHEN i.spu IS NULL THEN 'unknown issue' WHEN c.status = 'dismissed' AND trim(coalesce(note, '')) = '' THEN 'no note' END AS error FROM changes c LEFT JOIN issues i USING (spu, opp_id)) WHERE error IS NOT NULL", BY_SPU, ISSUES, OPPS, CHANGES)
def status_refusals(s, d):
    return M.change_errors(_changes(s, d), _issues(s, d), ("considering", "in_progress", "project", "done", "dismissed"))


@query("SELECT opp_id, was, status AS to FROM (SELECT c.spu || '/' || c.opp_id AS opp_id, coalesce(h.status, 'considering') AS was, c.status FROM changes c LEFT JOIN held h USING (spu, opp_id)) WHERE was IS DISTINCT FROM status", BY_SPU, ISSUES, OPPS, CHANGES)
def status_audit(s, d):
    keyed = lambda df: df.withColumn("opp_id", F.concat_ws("/", "spu", "opp_id"))
    return audit(keyed(_held(s, d)), keyed(_changes(s, d)), "opp_id")


MERGES = """merges AS (SELECT opp_id || '+' AS proposal_id, [opp_id, other] AS opp_ids, CASE WHEN n % 3 = 0 THEN other END AS target FROM (SELECT opp_id, n, lead(opp_id) OVER (ORDER BY opp_id) AS other, row_number() OVER (ORDER BY opp_id) AS r FROM opps) WHERE r % 3 = 1 AND other IS NOT NULL),
 firsts AS (SELECT opp_id, min(attach_week) AS first_week FROM opp_evidence GROUP BY 1),
 allowed AS (SELECT * FROM merges m WHERE NOT EXISTS (SELECT 1 FROM opps o WHERE o.safety AND list_contains(m.opp_ids, o.opp_id))),
 sides AS (SELECT proposal_id, target AS wanted, unnest(opp_ids) AS opp_id FROM allowed), chosen AS (SELECT proposal_id, coalesce(max(wanted), arg_min(opp_id, (first_week, opp_id))) AS target FROM sides JOIN firsts USING (opp_id) GROUP BY 1),
 pairs AS (SELECT proposal_id, opp_id AS source, target FROM sides JOIN chosen USING (proposal_id) WHERE opp_id <> target)"""


def _merges(s, d):
    from pyspark.sql import Window as W

    order = W.orderBy("opp_id")
    rows = _opps(s, d).select("opp_id", "n", F.lead("opp_id").over(order).alias("other"), F.row_number().over(order).alias("r")).where("r % 3 = 1 AND other IS NOT NULL")
    rows = rows.select(F.concat("opp_id", F.lit("+")).alias("proposal_id"), F.lit("MERGE").alias("op"), F.array("opp_id", "other").alias("opp_ids"), F.when(F.col("n") % 3 == 0, F.col("other")).alias("target"))
    firsts = _opp(s, d).groupBy("opp_id").agg(F.min("attach_week").alias("first_week"))
    return M.merge_pairs(M.merges_allowed(rows, _opps(s, d)), firsts)


@query("SELECT * FROM pairs", OPPS, MERGES)
def merge_pairs(s, d):
    return _merges(s, d)


@query("""SELECT opp_id, count(*) AS evi_total, count(*) FILTER (moved) AS merged FROM (SELECT coalesce(p.target, e.opp_id) AS opp_id, message_id, seq, bool_and(p.target IS NOT NULL) AS moved FROM opp_evidence e LEFT JOIN pairs p ON p.source = e.opp_id GROUP BY ALL) GROUP BY opp_id""", OPPS, MERGES)
def merge_execution(s, d):
    relation = _opp(s, d).select("opp_id", "message_id", "seq", F.lit("rule").alias("match_by"))
    return M.execute_merges(relation, _merges(s, d))[1]


@query("""SELECT opp_id, NULL::VARCHAR AS parent, 'SPLIT' AS op, proposal_id FROM (SELECT opp_id, 's' || opp_id AS proposal_id, CASE WHEN n % 2 = 0 THEN 'accepted' ELSE 'pending' END AS status, safety FROM opps) WHERE status = 'accepted' OR (NOT safety AND opp_id NOT IN (SELECT opp_id FROM owners))""", OPPS, OWNERS)
def split_execution(s, d):
    rows = _opps(s, d).select(F.concat(F.lit("s"), "opp_id").alias("proposal_id"), F.when(F.col("n") % 2 == 0, "accepted").otherwise("pending").alias("status"), F.array("opp_id").alias("opp_ids"))
    return M.execute_splits(rows, _owners(s, d), _opps(s, d), automatic=True)


@query("""SELECT a.opp_id AS id, b.opp_id FROM (SELECT opp_id, split_part(opp_id, '-', 1) AS tag, opp_type, safety FROM opps) a JOIN (SELECT opp_id, split_part(opp_id, '-', 1) AS tag, opp_type FROM opps WHERE n % 3 = 0) b USING (tag, opp_type) WHERE NOT safety""", OPPS)
def tombstone_matches(s, d):
    rows = _opps(s, d).withColumn("tag", F.split_part("opp_id", F.lit("-"), F.lit(1)))
    dead = M.tombstones(rows, _opps(s, d).select("opp_id", F.when(F.col("n") % 3 == 0, "dismissed").otherwise("done").alias("status")))
    return M.tombstone_hits(rows.withColumnRenamed("opp_id", "id"), dead)


@query("""SELECT opp_id, reason FROM (SELECT opp_id, CASE WHEN safety THEN 'safety' WHEN dual_source THEN 'dual_source' WHEN row_number() OVER (ORDER BY rank_score DESC NULLS LAST, opp_id) <= 3 THEN 'rank' END AS reason
 FROM (SELECT r.opp_id, o.safety, r.dual_source AND length(r.opp_id) % 2 = 0 AS dual_source, rank_score FROM recounted r JOIN opps o USING (opp_id) WHERE o.backlog AND o.state = 'valid')) WHERE reason IS NOT NULL""", RECOUNT, OPPS)
def release_rows(s, d):
    counts = C.recount(_opp(s, d)).withColumn("dual_source", F.col("dual_source") & (F.length("opp_id") % 2 == 0))
    return M.release_rows(counts, _opps(s, d), 3)


CUES = {"gap": ("the", "a"), "praise": ("in", "of")}
_HITS = lambda ws: " + ".join(f"contains(t, '{w}')::INTEGER" for w in ws)


@query(f"""SELECT doc_id, intent, round(confidence, 6) AS confidence, intent = 'gap' AND round(confidence, 6) >= 0.4 AS passes, intent = 'gap' AND round(confidence, 6) >= 0.4 AND round(confidence, 6) < 0.6 AS needs_review FROM (SELECT doc_id, CASE WHEN g + p = 0 THEN 'other' WHEN g >= p THEN 'gap' ELSE 'praise' END AS intent,
 CASE WHEN g + p = 0 THEN 0 ELSE greatest(g, p) / (g + p)::DOUBLE END AS confidence FROM (SELECT doc_id, {_HITS(CUES['gap'])} AS g, {_HITS(CUES['praise'])} AS p FROM (SELECT doc_id, lower(left(source || chr(10) || trim(text, ' ' || chr(9) || chr(10) || chr(13)), 800)) AS t FROM documents)))""", plain=True)
def intent_gate(s, d):
    rows = read(s, d, "documents").select("doc_id", T.assemble(F.col("source"), F.col("text")).alias("t"))
    return M.intent_gate(rows, M.intent(F.col("t"), CUES)).drop("t")


@query("""SELECT tag, content_branch, CASE count(DISTINCT category) WHEN 0 THEN 'undetermined' WHEN 1 THEN max(category) ELSE 'cross' END AS category, mode() WITHIN GROUP (ORDER BY tax_path) AS tax_path, round(avg(CASE WHEN star <= 2 THEN 1.0::DOUBLE WHEN star IS NOT NULL THEN 0 END), 4) AS low_star_rate,
 CASE count(DISTINCT brand) WHEN 1 THEN max(brand) ELSE 'common' END AS prod_line FROM pool GROUP BY ALL""")
def bucket_context(s, d):
    return M.bucket_context(_pool(s, d).withColumn("prod_line", F.col("brand")), ["tag", "content_branch"])


@query("""SELECT tag, a.n AS expected, b.n AS actual FROM (SELECT tag, count(*) AS n FROM candidates WHERE tag < 'S' GROUP BY 1) a FULL JOIN (SELECT tag, count(*) AS n FROM pool WHERE tag > 'E' GROUP BY 1) b USING (tag) WHERE a.n IS DISTINCT FROM b.n""")
def expected_against_actual(s, d):
    count = lambda df: df.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    planned = _candidates(s, d).where("tag < 'S'")
    return M.expected_against_actual(count(planned), count(_pool(s, d).where("tag > 'E'")), ["tag"])


@query("""SELECT event_type AS model, count(*) AS calls, sum((props->>'$.k')::BIGINT)::BIGINT AS tokens_in, sum(event_id % 97)::BIGINT AS tokens_out, round(sum((props->>'$.k')::BIGINT) * any_value(pi) / 1e6 + sum(event_id % 97) * any_value(po) / 1e6, 6)::DOUBLE AS cost, any_value(pi) IS NULL AS unknown
 FROM events LEFT JOIN (VALUES ('purchase', 2.0::DOUBLE, 6.0::DOUBLE), ('view', 0.5, 1.5)) p(event_type, pi, po) USING (event_type) GROUP BY 1""", plain=True)
def model_costs(s, d):
    calls = read(s, d, "events").select(F.col("event_type").alias("model"), F.get_json_object("props", "$.k").cast("long").alias("tokens_in"), (F.col("event_id") % 97).alias("tokens_out"))
    return M.costs(calls, s.createDataFrame([("purchase", 2.0, 6.0), ("view", 0.5, 1.5)], "model string, price_in double, price_out double"))


@query("""SELECT 'missing' AS kind, count(*) AS n FROM (SELECT message_id, seq FROM pool EXCEPT SELECT message_id, seq FROM candidates WHERE message_id % 3 > 0) UNION ALL SELECT 'beyond', count(*) FROM (SELECT message_id, seq FROM candidates WHERE message_id % 3 > 0 EXCEPT SELECT message_id, seq FROM pool)
 UNION ALL SELECT 'twice', 0""")
def row_account(s, d):
    done = _candidates(s, d).where("message_id % 3 > 0")
    return M.account_rows(_pool(s, d), done, ["message_id", "seq"])


@query("""SELECT run_id, week_start, several OR date_diff('day', week_start, DATE '2024-01-25') > 14 AS backfill FROM (SELECT run_id, week_start, count(DISTINCT week_start) OVER (PARTITION BY run_id) > 1 AS several FROM (SELECT DISTINCT user_id % 500 AS run_id, date_trunc('week', ts)::DATE AS week_start FROM events))""", plain=True)
def backfills(s, d):
    runs = read(s, d, "events").select((F.col("user_id") % 500).alias("run_id"), F.date_trunc("week", "ts").cast("date").alias("week_start")).distinct()
    return M.backfills(runs, "2024-01-25")


@query("""SELECT o.opp_id, CASE WHEN w.status IS NOT NULL AND w.status <> 'considering' THEN 'old ' || o.opp_id ELSE 'new ' || o.opp_id END AS title, o.n + 1 AS evi_total FROM opps o LEFT JOIN owners w USING (opp_id)""", OPPS, OWNERS)
def locked_update_rows(s, d):
    """New titles and counts: what a person has decided on keeps its title."""
    old = _opps(s, d).select("opp_id", F.concat(F.lit("old "), "opp_id").alias("title"), F.col("n").alias("evi_total"))
    new = _opps(s, d).select("opp_id", F.concat(F.lit("new "), "opp_id").alias("title"), (F.col("n") + 1).alias("evi_total"))
    return locked_update(old, new, _owners(s, d), "opp_id", ["title"])


@query("""SELECT message_id, src_line, 'new' AS version FROM (SELECT DISTINCT message_id, src_line FROM pool) WHERE message_id % 2 = 0 UNION ALL SELECT message_id, src_line, 'old' FROM message WHERE message_id % 2 = 1 OR message_id NOT IN (SELECT message_id FROM pool)""")
def message_upsert(s, d):
    from ..sources.fixtures import message

    old = message(s, d).select("message_id", "src_line", F.lit("old").alias("version"))
    new = _pool(s, d).where("message_id % 2 = 0").select("message_id", "src_line", F.lit("new").alias("version")).distinct()
    return upsert(old, new, ["message_id"])


@query("""SELECT CASE WHEN message_id % 41 = 0 THEN NULL ELSE message_id END AS message_id, CASE WHEN message_id % 41 = 0 THEN 'missing id' ELSE 'moved' END AS reason FROM message WHERE message_id % 41 = 0 OR (message_id % 37 = 0 AND src_line <> 'commerce')""")
def source_guard(s, d):
    from ..sources.fixtures import message

    batch = message(s, d).select(F.when(F.col("message_id") % 41 != 0, F.col("message_id")).alias("message_id"), F.when(F.col("message_id") % 37 == 0, "commerce").otherwise(F.col("src_line")).alias("src_line"))
    return moved_sources(message(s, d), batch)
