"""URL filters: host and path rules, carried to aliases over redirect and canonical-link components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, join_checked, settle
from .graph import connected_components

#: (verdict, host, path) of the registered query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Query arguments that only say where a visitor came from.
_TRACKING = r"(?<=[?&])(?:utm_[a-z]+|fbclid|gclid|ref)=[^&#]*&?"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def alias_key(url: Column) -> Column:
    """What addresses of one page share: without scheme, fragment, tracking arguments and a final slash; null without ``://``."""
    rest = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)", 1), r"(?s)#.*", ""), _TRACKING, "")
    return F.when(url.contains("://"), F.concat(host_of(url), F.regexp_replace(rest, r"[/?&]+$", "")))


def rule_index(rules=RULES) -> list[tuple[str, str, str, str]]:
    """(text, verdict, host, path), the longest text first; of equal texts the allowing one."""
    return sorted(((h + p, v, h, p) for v, h, p in rules), key=lambda r: (-len(r[0]), r[0], r[1]))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule whose host is the url's or a parent of it and whose path begins the url's."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for t, v, h, p in reversed(rule_index(rules)):
        fits = ((host == F.lit(h)) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(t)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def resolve(target: Column, base: Column) -> Column:
    """The address that a link's ``target`` names on the page ``base``; null if it names no other page.

    Absolute addresses stay; ``//host/x`` takes the page's scheme, ``/x`` its host, ``?q`` its path, and other
    targets are relative to the folder of its path, ``.`` and ``..`` resolved. Empty targets, fragments and schemes
    without ``//`` (mailto:, javascript:) name none.
    """
    path = path_of(base)
    folder = F.concat(F.regexp_extract(path, r"(?s)^(.*)/", 1), F.lit("/"))
    joined = F.when(target.startswith("/"), target).when(target.startswith("?"), F.concat(F.when(path == "", "/").otherwise(path), target)).otherwise(F.concat(folder, target))
    steps = F.split(F.regexp_extract(joined, r"(?s)^[^?#]*", 0), "/")
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x))))
    local = F.concat(F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1), F.array_join(kept, "/"), F.regexp_extract(joined, r"(?s)^[^?#]*(.*)", 1))
    return (
        F.when((target == "") | target.startswith("#"), F.lit(None).cast("string"))
        .when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), target)
        .when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?)://", 1), F.lit(":"), target))
        .otherwise(local)
    )


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b, to): alias keys tied by a canonical link or a meta refresh, and the target, resolved against the page's own url."""
    html = F.col(html_col)
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    tags = F.filter(tags, lambda t: t.rlike(r"(?is)rel\s*=\s*[\"']?canonical\b") | t.rlike(r"(?is)http-equiv\s*=\s*[\"']?refresh\b"))
    target = lambda t: F.regexp_extract(t, r"(?is)\b(?:href|url)\s*=\s*[\"']?\s*([^\"'\s>;]+)", 1)
    # The tags are looked for only in pages that name one of the two.
    found = F.when(html.rlike("(?i)canonical|http-equiv"), F.transform(tags, target))
    links = pages.select(F.col(url_col).alias("url"), F.explode(found).alias("target")).where(F.col("url").contains("://"))
    links = links.select("url", resolve(F.col("target"), F.col("url")).alias("to"))
    return links.select(alias_key(F.col("url")).alias("a"), alias_key(F.col("to")).alias("b"), "to").where(F.col("a").isNotNull() & F.col("b").isNotNull())


def url_filter(pages: DataFrame, rules=RULES, links: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """(id, host, path, rule, verdict), a row for each page.

    A page with a rule takes its verdict. Other pages take that of their alias component: allow if any address of it
    is allowed by a rule, else block if any is blocked, else allow. Its addresses are its pages' and the ends of its
    links, be they pages or not. Components are those of the alias keys under the links found in the pages and the
    given ``links`` (columns a and b: urls, e.g. of a redirect log).

    A null url, or one without ``://``, has empty host and path, no rule, no aliases and is allowed. Repeated rows
    each get a row. Null html has no links. Empty tables give empty results; extra columns are not read.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    judged = pages.select(F.col(id_col), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    text, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = judged.select(id_col, "host", "path", text.alias("rule"), verdict.alias("own"), alias_key(F.col("url")).alias("alias"))

    edges = page_links(pages, url_col, html_col) if html_col else None
    if links is not None:
        # Either end of a given link may be no page: the turned link names the other end.
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        given = both.select(alias_key(F.col("a")).alias("a"), alias_key(F.col("b")).alias("b"), F.col("b").alias("to")).where("a IS NOT NULL AND b IS NOT NULL")
        edges = given if edges is None else edges.unionByName(given)
    voters = judged.select("alias", "own")
    if edges is not None:
        edges = settle(edges, "url-links")
        parts = settle(connected_components(edges).select(F.col("node").alias("alias"), "component"), "url-components")
        ends = edges.select(F.col("b").alias("alias"), host_of(F.col("to")).alias("host"), path_of(F.col("to")).alias("path"))
        voters = voters.unionByName(ends.select("alias", matching_rule(F.col("host"), F.col("path"), rules)[1].alias("own")))
    votes = voters.where(F.col("own").isNotNull() & F.col("alias").isNotNull()).groupBy("alias").agg(F.bool_or(F.col("own") == "allow").alias("allowed"), F.bool_or(F.col("own") == "block").alias("blocked"))
    if edges is not None:
        name = F.coalesce(F.col("component"), F.col("alias"))
        votes = join_checked(votes, parts, "alias", "left").groupBy(name.alias("part")).agg(F.bool_or("allowed").alias("allowed"), F.bool_or("blocked").alias("blocked"))
    else:
        votes = votes.withColumnRenamed("alias", "part")
    votes = settle(votes.where(F.col("blocked") & ~F.col("allowed")).select("part", F.lit("block").alias("shared")), "url-votes")
    if edges is not None:
        judged = join_checked(judged, parts, "alias", "left").withColumn("part", F.coalesce("component", "alias"))
    else:
        judged = judged.withColumn("part", F.col("alias"))
    return join_checked(judged, votes, "part", "left").select(id_col, "host", "path", "rule", F.coalesce("own", "shared", F.lit("allow")).alias("verdict"))
