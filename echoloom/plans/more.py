"""Registered queries of single rules that the larger ones rest on, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import board as B
from ..operators import core as C
from ..operators import vectors as X
from ..operators.resolve import resolve, same_by_cosine
from ..operators.write import reconcile
from ..sources.fixtures import evidence, message, read
from .queries import AS_OF, BY_SPU, CONTAINER, DETAIL, ISSUES, MANUAL, SPREAD, _candidates, _container, _detail, _issues, _opp, query


@query("""SELECT CASE WHEN rule = 'R1' THEN 'existing_product' WHEN rule = 'R2' THEN 'innovation' END AS opp_type, CASE rule WHEN 'R1' THEN lower(tag) WHEN 'R2' THEN content_branch END AS topic, CASE WHEN rule = 'R2' THEN channel END AS channel,
 CASE WHEN rule = 'R3' THEN 'invalid' ELSE 'valid' END AS state, count(*) AS n FROM candidates GROUP BY ALL""")
def lifecycle_routing(s, d):
    return C.lifecycle_routing(_candidates(s, d))


@query("""SELECT k.message_id, coalesce(rule, 'R0') AS rule, CASE rule WHEN 'R1' THEN 'existing_product' WHEN 'R2' THEN 'innovation' END AS opp_type, CASE WHEN rule IN ('R1', 'R2') THEN 'valid' ELSE 'invalid' END AS state FROM message k
 LEFT JOIN (SELECT message_id, CASE WHEN bool_or(len(spu) > 0) THEN 'R1' WHEN bool_or(NOT requires_spu) THEN 'R2' ELSE 'R3' END AS rule FROM candidates GROUP BY 1) USING (message_id)""")
def message_classification(s, d):
    """Every message, those without candidates included."""
    return C.classify_all(message(s, d), _candidates(s, d), "message_id")


KNOWN = """known AS (SELECT 'o' || vec_id AS opp_id, label % 3 AS kind, embedding::DOUBLE[] AS v, vec_id % 4 = 0 AS safety FROM embeddings WHERE vec_id % 2 = 0 AND vec_id % 14 <> 0), fresh AS (SELECT vec_id AS id, label % 3 AS kind, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 2 = 1),
 pairs AS (SELECT id, opp_id, safety, round(list_cosine_similarity(f.v, k.v), 9) AS sim FROM fresh f JOIN known k USING (kind)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, opp_id) AS place, count(*) OVER (PARTITION BY id) AS n FROM pairs),
 same AS (SELECT * FROM ranked WHERE place <= least(10, greatest(3, ceil(n * 0.3))) AND sim >= 0.35),
 best AS (SELECT id, arg_min(opp_id, place) AS opp_id, arg_min(safety, place) AS safety, list_sort(list(DISTINCT opp_id)) AS everyone FROM same GROUP BY id)"""


@query(f"""WITH {KNOWN} SELECT f.id, CASE WHEN b.id IS NULL OR b.safety THEN 'create' ELSE 'attach' END AS action, CASE WHEN b.id IS NOT NULL AND NOT b.safety THEN b.opp_id END AS opp_id,
 coalesce(array_to_string(list_filter(everyone, lambda x: b.safety OR x <> b.opp_id), ','), '') AS proposals FROM fresh f LEFT JOIN best b USING (id)""", plain=True)
def resolve_items(s, d):
    """New items against known ones: candidates of the type, the nearest few, a judge, attach or create with proposals."""
    rows = read(s, d, "embeddings").select("vec_id", (F.col("label") % 3).cast("string").alias("opp_type"), F.lit("t").alias("tag"), F.lit(None).cast("string").alias("channel"), F.col("embedding").cast("array<double>").alias("vec"))
    known = rows.where("vec_id % 2 = 0").select(F.concat(F.lit("o"), F.col("vec_id").cast("string")).alias("opp_id"), "opp_type", "tag", "channel", "vec", (F.col("vec_id") % 4 == 0).alias("safety"), F.lit("valid").alias("state"), F.when(F.col("vec_id") % 14 == 0, "x").alias("merged_into"))
    out = resolve(rows.where("vec_id % 2 = 1").withColumnRenamed("vec_id", "id"), known, lambda c: same_by_cosine(c, 0.35))
    return out.withColumn("proposals", F.array_join("proposals", ","))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1", plain=True)
def cosine_of_pairs(s, d):
    rows = read(s, d, "embeddings").select("vec_id", "embedding")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return rows.join(other, "vec_id").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.round(X.cosine(F.col("embedding"), F.col("next")), 6).alias("similarity"))


@query("""SELECT event_type AS kind, count(*) AS planned, count(*) FILTER (user_id % 10 > 1) AS completed, count(*) FILTER (user_id % 10 = 0) AS failed, count(*) FILTER (user_id % 10 = 1 AND user_id % 20 = 1) AS cancelled,
 count(*) = count(*) FILTER (user_id % 10 <> 1 OR user_id % 20 = 1) AS balanced, NOT (count(*) FILTER (user_id % 10 = 0) > 2 AND count(*) FILTER (user_id % 10 = 0) / count(*)::DOUBLE > 0.2) AS within_budget FROM events GROUP BY 1""", plain=True)
def outcome_ledger(s, d):
    u = F.col("user_id")
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    return reconcile(read(s, d, "events").select(F.col("event_type").alias("kind"), F.lit(1).cast("long").alias("planned"), one(u % 10 > 1).alias("completed"), one(u % 10 == 0).alias("failed"), one((u % 10 == 1) & (u % 20 == 1)).alias("cancelled")))


@query("""SELECT i.spu, count(*) AS n, string_agg(i.opp_id || ':' || coalesce(m.status, 'considering'), ',' ORDER BY CASE WHEN m.status = 'revived' THEN 0 WHEN m.status IN ('done', 'dismissed') THEN 2 ELSE 1 END, i.evi_count DESC, i.opp_id) AS issues
 FROM issues i LEFT JOIN manual m ON m.spu = i.spu AND m.opp_id = i.opp_id WHERE i.spu IN (SELECT spu FROM container) GROUP BY i.spu""", BY_SPU, ISSUES, MANUAL, CONTAINER)
def board_cards(s, d):
    """Products with their issues nested in order."""
    issues = _issues(s, d)
    placed = B.board_issues(issues, C.spread(_opp(s, d)), B.manual_status(issues))
    cards = B.grouped_cards(_container(s, d).select("spu"), placed)
    return cards.select("spu", F.size("issues").cast("long").alias("n"), F.array_join(F.transform("issues", lambda x: F.concat_ws(":", x["opp_id"], x["status"])), ",").alias("issues"))


@query("""SELECT named AS spu, CASE min(r) WHEN 1 THEN 'PS' WHEN 3 THEN min(grade) FILTER (r = 3) WHEN 4 THEN min(grade) FILTER (r = 4) ELSE 'x' END AS grade FROM (SELECT unnest(spu) AS named, message_id FROM message) JOIN (SELECT message_id, ['B级', 'x', 'A', 'B', 'PS', 'x', 'x'][message_id % 7 + 1] AS grade, [4, 7, 3, 4, 1, 7, 7][message_id % 7 + 1] AS r FROM message WHERE message_id % 7 <> 6) USING (message_id) GROUP BY 1""")
def best_grades(s, d):
    """The best grade any message names for a product, ties by spelling."""
    grade = F.get(F.array(*map(F.lit, ("B级", "x", "A", "B", "PS", "x"))), (F.col("message_id") % 7).cast("int"))
    rows = message(s, d).where("message_id % 7 <> 6").select(F.explode("spu").alias("spu"), grade.alias("grade"))
    return rows.groupBy("spu").agg(F.min_by("grade", F.struct(T.grade_rank(F.col("grade")), "grade")).alias("grade"))


@query(r"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS own, CASE doc_id % 4 WHEN 0 THEN 'PS' WHEN 1 THEN 'B级' WHEN 2 THEN 'x' END AS grade, lang AS stage, NULL::VARCHAR AS domain, source AS sub, NULL::VARCHAR AS leaf,
 CASE doc_id % 2 WHEN 0 THEN '噪声控制' ELSE source END AS tag, CASE doc_id % 3 WHEN 0 THEN 'undetermined' WHEN 1 THEN 'light' ELSE 'common' END AS line, lang || CASE WHEN source = lang THEN '' ELSE chr(10) || source END AS told, doc_id % 2 = 0 AS not_product FROM documents""", plain=True)
def field_rules(s, d):
    """Own brand, best grade, tax levels with a gap, synonyms, product line, assembled text, three-valued filter."""
    k = F.col("doc_id")
    own = F.when(k % 3 == 0, "[]").when(k % 3 == 1, "[竞品]").otherwise("[竞品, 本品]")
    grade = F.when(k % 4 == 0, "[D, PS, x]").when(k % 4 == 1, "[B级, B, C]").when(k % 4 == 2, "[x, y]")
    tax = T.tax_levels(F.concat(F.lit("t/"), F.col("lang"), F.lit("/ /"), F.col("source"), F.lit("/")))
    lines = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("light"))).otherwise(F.array(F.lit("light"), F.lit("stand")))
    product = F.when(k % 2 == 1, True).when(k % 4 == 0, False)
    return read(s, d, "documents").select(
        "doc_id", T.own_brand(own).alias("own"), T.highest_grade(grade).alias("grade"), *[tax[x].alias(x) for x in ("stage", "domain", "sub", "leaf")],
        T.synonym(F.when(k % 2 == 0, " 噪音控制 ").otherwise(F.col("source"))).alias("tag"), T.prod_line(lines).alias("line"), T.assemble(F.col("lang"), F.lit("  "), F.col("source"), F.col("lang")).alias("told"), (~F.coalesce(product, F.lit(False))).alias("not_product"),
    )


@query("""SELECT opp_id, n, spus, messages, round(100 * n / max(n) OVER ()::DOUBLE, 2) AS bar, round(n / sum(n) OVER ()::DOUBLE, 6) AS share, top FROM (SELECT opp_id, count(*) AS n, count(DISTINCT code) AS spus, count(DISTINCT message_id) AS messages,
 string_agg(message_id || ':' || seq, ',' ORDER BY interactions DESC NULLS LAST, message_id, seq) FILTER (place <= 3) AS top FROM (SELECT *, row_number() OVER (PARTITION BY opp_id ORDER BY interactions DESC NULLS LAST, message_id, seq) AS place FROM opp_evidence WHERE rule = 'R2') GROUP BY 1)""")
def innovation_detail(s, d):
    """Innovation opportunities with spread, share and the rows that were looked at most."""
    from pyspark.sql import Window as W

    rows = _opp(s, d).where("rule = 'R2'")
    order = [F.desc_nulls_last("interactions"), F.col("message_id"), F.col("seq")]
    top = rows.withColumn("place", F.row_number().over(W.partitionBy("opp_id").orderBy(*order))).where("place <= 3")
    named = top.groupBy("opp_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(":", F.col("message_id").cast("string"), F.col("seq").cast("string")).alias("at"))))["at"], ",").alias("top"))
    facts = rows.groupBy("opp_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("code").alias("spus"), F.count_distinct("message_id").alias("messages"))
    total = facts.agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    return facts.join(named, "opp_id").crossJoin(F.broadcast(total)).select("opp_id", "n", "spus", "messages", F.round(100.0 * F.col("n") / F.col("most"), 2).alias("bar"), F.round(F.col("n") / F.col("all"), 6).alias("share"), "top")


@query("""SELECT message_id, coalesce(nullif(trim(snippet, ' '), ''), nullif(trim(content, ' '), '')) AS voice, CASE WHEN content_zh IS DISTINCT FROM content THEN content_zh END AS translation, seq FROM evidence JOIN message USING (message_id) JOIN detail USING (message_id) WHERE is_product IS NOT TRUE""", DETAIL)
def service_voices(s, d):
    """What evidence beside the product says: the first text there is, and the translation where it is not the content."""
    rows = evidence(s, d).where(~F.coalesce("is_product", F.lit(False))).join(message(s, d).select("message_id", "content"), "message_id").join(_detail(s, d).select("message_id", "content_zh"), "message_id")
    voice = F.coalesce(C.blank_to_null("snippet"), C.blank_to_null("content"))
    return rows.select("message_id", "seq", voice.alias("voice"), B.translation(F.col("content_zh"), F.col("content")).alias("translation"))


@query("""SELECT event_id, coalesce((props->>'$.k')::BIGINT, 0) AS k, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'batch' END AS stage, (event_id % 3 = 0)::BIGINT + 1 AS keys FROM events""", plain=True)
def merged_metrics(s, d):
    """Metrics of a run merged key by key, the later ones winning."""
    k = F.get_json_object("props", "$.k")
    first = F.create_map(F.lit("stage"), F.lit("batch"))
    later = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("stage"), F.col("event_type"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(first, lambda x, y: ~F.map_contains_key(later, x)), later)
    both = F.when(F.col("event_id") % 3 == 0, F.map_concat(merged, F.create_map(F.lit("k"), k))).otherwise(merged)
    return read(s, d, "events").select("event_id", F.coalesce(k.cast("long"), F.lit(0)).alias("k"), both["stage"].alias("stage"), F.size(both).cast("long").alias("keys"))


@query(f"""SELECT opp_id, coalesce(round(n_eff, 6), 0) AS n_eff, evi_total, round(evi_total * (1 + coalesce(low, 0)) * CASE WHEN sources > 1 THEN 1.5::DOUBLE ELSE 1 END + CASE WHEN length(opp_id) % 3 = 0 THEN 1000 ELSE 0 END, 3) AS rank_score FROM
 (SELECT opp_id, count(*) AS evi_total, count(DISTINCT src_line) AS sources, round(count(*) FILTER (star <= 2) / nullif(count(star), 0)::DOUBLE, 4) AS low FROM opp_evidence WHERE publish_time < TIMESTAMP '{AS_OF}' GROUP BY 1) LEFT JOIN spread USING (opp_id)""", BY_SPU, SPREAD)
def safety_rank(s, d):
    """Rank scores with safety-relevant opportunities a thousand up."""
    rows = _opp(s, d).where(F.col("publish_time") < F.lit(AS_OF).cast("timestamp"))
    counts = C.recount(rows, safety=F.length("opp_id") % 3 == 0)
    return counts.join(C.spread(_opp(s, d)).select("opp_id", "n_eff"), "opp_id", "left").select("opp_id", F.coalesce("n_eff", F.lit(0.0)).alias("n_eff"), "evi_total", "rank_score")
