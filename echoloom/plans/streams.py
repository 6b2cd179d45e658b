"""Queries of a stream run to its end, of traced quotes and of fitted intents, with their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import intent_model as N
from ..operators import manage as M
from ..operators import quotes as Q
from ..sources.fixtures import evidence, message, read
from ..sources.settled import shared_dir
from ..streaming import lifecycle as S
from .queries import query

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@query("""SELECT user_id, event_type AS status, told AS updated, told + INTERVAL 2 DAY AS due FROM (
 SELECT user_id, event_type, told, lead(told) OVER (PARTITION BY user_id ORDER BY told, event_type) AS next_told, max(told) OVER () AS newest FROM (SELECT user_id, event_type, date_trunc('millisecond', ts) AS told FROM events WHERE ts IS NOT NULL))
 WHERE event_type IN ('purchase', 'signup') AND coalesce(next_told, newest) > told + INTERVAL 2 DAY""", plain=True)
def stale_users(s, d):
    """Users without an event for two days after a purchase or signup: a stream over the table, run to its end, timers included."""
    # A pattern, as the source of a stream takes a plain path for a folder, and the table may be one file.
    place, name = f"{shared_dir(s)}/stale-users-{uuid.uuid4().hex}", "events.parque[t]"
    before = s.conf.get(_PROVIDER)
    s.conf.set(_PROVIDER, S.PROVIDER)
    try:
        stream = s.readStream.schema(read(s, d, "events").schema).parquet(f"{d}/{name}")
        out = S.stale_items(stream, "user_id", "ts", "event_type", ("purchase", "signup"), 2, "0 seconds")
        out.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        s.conf.set(_PROVIDER, before)
    rows = s.read.schema(out.schema).parquet(f"{place}/rows")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("updated", "due")})


@query("""SELECT id, 0 AS no, quote FROM (
 SELECT c.id, c.quote, coalesce(bool_or(contains(txt, c.first)), false) AS has_first, coalesce(bool_or(contains(txt, c.second)), false) AS has_second, any_value(c.first) AS first, any_value(c.second) AS second FROM (
  SELECT message_id || '-' || seq AS id, tag, coalesce(snippet, '') || '、' || coalesce(content, '') AS quote, CASE WHEN length(trim(snippet, ' ')) >= 5 THEN lower(replace(snippet, ' ', '')) END AS first, CASE WHEN length(content) >= 5 THEN replace(content, ' ', '') END AS second
  FROM evidence JOIN message USING (message_id)) c
 LEFT JOIN (SELECT DISTINCT tag, lower(replace(concat_ws(' ', snippet, content), ' ', '')) AS txt FROM evidence JOIN message USING (message_id) WHERE is_product) t ON t.tag = c.tag AND (contains(txt, c.first) OR contains(txt, c.second))
 WHERE length(c.quote) >= 5 GROUP BY c.id, c.quote)
 WHERE NOT ((first IS NOT NULL OR second IS NOT NULL) AND (first IS NULL OR has_first) AND (second IS NULL OR has_second))""")
def quote_tracing(s, d):
    """Each evidence row as a claim that quotes its snippet and its message: what no product row of its tag says is untraced."""
    rows = evidence(s, d).join(message(s, d).select("message_id", "content"), "message_id")
    text = F.concat(F.lit("“"), F.coalesce("snippet", F.lit("")), F.lit("、"), F.coalesce("content", F.lit("")), F.lit("”"))
    claims = rows.select(F.concat_ws("-", F.col("message_id").cast("string"), F.col("seq").cast("string")).alias("claim"), "tag", text.alias("text"))
    return Q.untraced(claims, rows.where("is_product"), "claim", "tag", "text", ["snippet", "content"])


_FEATURES = r"""feats AS (SELECT doc_id, unnest(list_distinct(list_concat(ws, flatten(list_transform(list_filter(ws, lambda w: regexp_matches(w, '[^\x00-\x7F]')), lambda w: list_transform(generate_series(1, greatest(length(w) - 1, 1)), lambda i: '#' || substr(w, i, 2))))))) AS f
 FROM (SELECT doc_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS ws FROM documents))"""
_CLASSES = ("gap", "other")
#: Labels (two short columns) are broadcast up to so many; beyond, the texts are exchanged.
MOST_BROADCAST = 500_000


@query(f"""WITH {_FEATURES}, told AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'gap' ELSE 'other' END AS label FROM labels JOIN documents USING (doc_id)),
tallied AS (SELECT f, count(*) FILTER (label = 'gap') AS g, count(*) FILTER (label = 'other') AS o FROM feats JOIN told USING (doc_id) GROUP BY f),
shares AS (SELECT sum(g)::DOUBLE / sum(g + o) AS sg, sum(o)::DOUBLE / sum(g + o) AS so FROM tallied),
counts AS (SELECT f, g, o FROM tallied, shares WHERE (g - (g + o) * sg) ** 2 >= 25 * (g + o) * sg OR (o - (g + o) * so) ** 2 >= 25 * (g + o) * so),
priors AS (SELECT ln((count(*) FILTER (label = 'gap') + 1) / (count(*) + 2)) AS pg, ln((count(*) FILTER (label = 'other') + 1) / (count(*) + 2)) AS po FROM told),
scores AS (SELECT doc_id, count(g) AS m, sum(ln(1 + g) - ln(1 + (g + o) * sg)) + any_value(pg) AS a, sum(ln(1 + o) - ln(1 + (g + o) * so)) + any_value(po) AS b
 FROM documents d LEFT JOIN feats USING (doc_id) LEFT JOIN counts USING (f), shares, priors GROUP BY doc_id),
judged AS (SELECT doc_id, CASE WHEN m = 0 OR b > a THEN 'other' ELSE 'gap' END AS intent, round(CASE WHEN m = 0 THEN 0 ELSE 1 / (1 + exp(-least(abs(a - b), 700))) END, 6)::DOUBLE AS confidence FROM scores)
SELECT doc_id, intent, confidence, intent = 'gap' AND confidence >= 0.4 AS passes, intent = 'gap' AND confidence >= 0.4 AND confidence < 0.6 AS needs_review FROM judged""", plain=True)
def fitted_intent(s, d):
    """The gate behind a classifier that is fitted on all labelled documents; their label stands for the intent."""
    docs = read(s, d, "documents").select("doc_id", "text")
    labels = read(s, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "gap").otherwise("other").alias("label"))
    few = labels.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    told = docs.join(F.broadcast(labels) if few else labels, "doc_id")
    model = N.fit(told, "text", "label", _CLASSES)
    return M.intent_gate(N.classify(docs, "doc_id", "text", model), F.col("found")).drop("found")
