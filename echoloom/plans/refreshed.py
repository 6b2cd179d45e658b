"""Derived tables after an incremental refresh, held against a full computation in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental as I
from ..sources.fixtures import evidence, message
from ..sources.settled import shared_dir
from ..sources.versions import Snapshot, Store
from .queries import CONTAINER, RECOUNT, SPREAD, _opp, query

#: What comes after this day is news; of the rows before it, each 29th goes; each 31st had another star and tax path.
DAY = "1997-03-01"
COLUMNS = ("opp_id", "message_id", "seq", "src_line", "star", "attach_week", "tax_path", "publish_time", "spu", "rule")
#: Opportunities of size class 7 are merged into those of class 6, and these into class 5: a chain.
MERGED = """relation_now AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY opp_id, message_id, seq ORDER BY was <> opp_id, was) AS n FROM (
  SELECT * EXCLUDE (opp_id), opp_id AS was, CASE WHEN right(opp_id, 2) IN ('-7', '-6') THEN left(opp_id, length(opp_id) - 1) || '5' ELSE opp_id END AS opp_id FROM opp_evidence
  WHERE NOT (publish_time < TIMESTAMP '1997-03-01' AND (message_id * 7 + seq) % 29 = 0))) WHERE n = 1)"""
_NOW = lambda sql: sql.replace("FROM opp_evidence", "FROM relation_now")
BY_NOW = "by_spu AS (SELECT DISTINCT opp_id, u.code AS spu, message_id, seq, attach_week, tax_path, publish_time FROM (SELECT opp_id, message_id, seq, attach_week, tax_path, publish_time, rule, unnest(spu) AS code FROM relation_now) u WHERE rule = 'R1')"
ISSUES_NOW = "issues AS (SELECT spu, opp_id, count(*) AS evi_count, mode() WITHIN GROUP (ORDER BY tax_path) AS tax_path, min(attach_week) AS first_attach_week, max(attach_week) AS last_attach_week FROM by_spu GROUP BY ALL HAVING count(*) >= 2)"


#: Stores already refreshed, by application and source tables: the queries read one each.
_DONE: dict[tuple[str, str], Snapshot] = {}


def _refreshed(s: SparkSession, d: str) -> Snapshot:
    """A store with yesterday's tables, brought up to date; once per application."""
    key = (s.sparkContext.applicationId, d)
    if key not in _DONE:
        _DONE[key] = _refresh(s, d)
    return _DONE[key]


def _refresh(s: SparkSession, d: str) -> Snapshot:
    rows = _opp(s, d).select(*COLUMNS)
    late = F.col("publish_time") >= F.lit(DAY).cast("timestamp")
    at = F.col("message_id") * 7 + F.col("seq")
    lost, edited = ~late & (at % 29 == 0), ~late & (at % 29 != 0) & (at % 31 == 0)
    before = rows.where(~late).withColumns({"star": F.when(edited, F.lit(1).cast(dict(rows.dtypes)["star"])).otherwise(F.col("star")), "tax_path": F.when(edited, F.lit("a/b")).otherwise(F.col("tax_path"))})
    m, e = message(s, d), evidence(s, d)
    old = m.withColumns({"spu": F.when(F.col("message_id") % 9 == 0, F.slice("spu", 1, 1)).otherwise(F.col("spu")), "star": F.when(F.col("message_id") % 9 == 1, F.lit(None)).otherwise(F.col("star"))})
    old = old.where(~late)
    store = Store(s, f"{shared_dir(s)}/refreshed-{uuid.uuid4().hex}")
    I.bootstrap(store, before, I.product_facts(old, e))
    opps = rows.select("opp_id").distinct()
    step = lambda a, b: opps.where(F.col("opp_id").endswith(a)).select(F.col("opp_id").alias("loser"), F.concat(F.expr("left(opp_id, length(opp_id) - 2)"), F.lit(b)).alias("survivor"))
    differs = late | (F.col("message_id") % 9 <= 1)
    facts = I.changed_facts(I.product_facts(old.where(differs), e), I.product_facts(m.where(differs), e))
    I.refresh(store, rows.where(late | edited), rows.where(lost), step("-7", "-6").unionByName(step("-6", "-5")), facts)
    return store.at()


@query("SELECT * FROM recounted", MERGED, _NOW(RECOUNT))
def refreshed_recount(s: SparkSession, d: str) -> DataFrame:
    return _refreshed(s, d).read("recount")


@query("SELECT * FROM issues", MERGED, BY_NOW, ISSUES_NOW)
def refreshed_issues(s: SparkSession, d: str) -> DataFrame:
    return _refreshed(s, d).read("issue")


@query("SELECT opp_id, spus, n_eff FROM spread", MERGED, BY_NOW, SPREAD)
def refreshed_spread(s: SparkSession, d: str) -> DataFrame:
    return _refreshed(s, d).read("spread").drop("scope")


@query("SELECT * FROM container", CONTAINER)
def refreshed_container(s: SparkSession, d: str) -> DataFrame:
    return _refreshed(s, d).read("container")
