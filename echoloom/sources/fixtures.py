"""Domain tables derived from the star schema, and the same definitions as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .settled import stored


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """(message_id, seq): one tagged snippet of a message; stored once per application, like ``message``."""
    return stored(spark, d, "evidence", lambda: _evidence(spark, d))


def message(spark: SparkSession, d: str) -> DataFrame:
    """One review or post, with its source, stars, content types, brands and product codes (empty arrays where none)."""
    return stored(spark, d, "message", lambda: _message(spark, d))


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    # The sequence is a window, as line numbers repeat.
    part = read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    rows = read(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    sentiment = F.when(F.col("l_returnflag") == "R", "neg").when(F.col("l_returnflag") == "A", "neu").otherwise("pos")
    star = F.when(src_line_of_order(), 1 + F.col("l_orderkey") % 5)
    return rows.join(read(spark, d, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("message_id"),
        (F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)) - 1).cast("long").alias("seq"),
        F.col("p_type").alias("tag"),
        F.col("p_size").cast("long").alias("size"),
        F.col("p_brand").alias("brand"),
        sentiment.alias("sentiment"),
        (F.col("l_linestatus") == "O").alias("is_product"),
        F.when(F.col("l_linenumber") % 4 == 0, F.lit(None)).when(F.col("l_linenumber") % 7 == 0, F.lit("  ")).otherwise(F.concat("p_name", F.lit(" "), F.col("l_linenumber").cast("string"))).alias("snippet"),
        F.concat_ws("/", F.lit("tree"), "p_type", "p_brand", "p_name").alias("tax_path"),
        ((sentiment == "neg") & F.coalesce(star >= 4, F.lit(False))).alias("low_conf"),
        F.concat(F.lit("P"), (F.col("l_partkey") % 50).cast("string")).alias("code"),
        F.col("l_quantity").alias("quantity"),
    )


def src_line_of_order():
    return F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")


def _message(spark: SparkSession, d: str) -> DataFrame:
    commerce = src_line_of_order()
    base = (
        read(spark, d, "orders")
        .join(read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(read(spark, d, "nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("message_id"),
            F.when(commerce, "commerce").otherwise("social").alias("src_line"),
            F.col("o_orderdate").cast("timestamp").alias("publish_time"),
            F.when(F.col("o_orderkey") % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("msg "), F.col("o_orderkey").cast("string"))).alias("content"),
            F.when(F.col("o_orderstatus") == "F", F.array(F.lit("experience"))).when(F.col("o_orderstatus") == "O", F.array(F.lit("inquiry"))).otherwise(F.array(F.lit("review"))).alias("content_type"),
            F.when(commerce, 1 + F.col("o_orderkey") % 5).alias("star"),
            F.when(commerce, F.col("c_mktsegment")).alias("category"),
            F.col("n_name").alias("country"),
            F.when(~commerce, F.floor("o_totalprice") % 500).alias("interactions"),
        )
    )
    codes = lambda least: F.array_sort(F.collect_set(F.when(F.col("is_product") & (F.col("quantity") > least), F.col("code"))))
    sets = evidence(spark, d).groupBy("message_id").agg(F.array_sort(F.collect_set("brand")).alias("brands"), codes(5).alias("many"), codes(45).alias("few"))
    none = F.array().cast("array<string>")
    return base.join(sets, "message_id", "left").withColumn("spu", F.when(F.col("src_line") == "commerce", F.col("many")).otherwise(F.col("few"))).drop("many", "few").withColumns({"brands": F.coalesce("brands", none), "spu": F.coalesce("spu", none)})


def policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("commerce", True), ("social", False)], "src_line string, requires_spu boolean")


#: The same tables for DuckDB. ``o_totalprice`` is never negative, so floor and cast agree.
CTE = """
policy(src_line, requires_spu) AS (VALUES ('commerce', true), ('social', false)),
evidence AS (
  SELECT l_orderkey AS message_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS seq,
         p_type AS tag, p_size::BIGINT AS size, p_brand AS brand,
         CASE l_returnflag WHEN 'R' THEN 'neg' WHEN 'A' THEN 'neu' ELSE 'pos' END AS sentiment, l_linestatus = 'O' AS is_product,
         CASE WHEN l_linenumber % 4 = 0 THEN NULL WHEN l_linenumber % 7 = 0 THEN '  ' ELSE p_name || ' ' || l_linenumber END AS snippet,
         'tree/' || p_type || '/' || p_brand || '/' || p_name AS tax_path,
         l_returnflag = 'R' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND 1 + l_orderkey % 5 >= 4 AS low_conf,
         'P' || (l_partkey % 50) AS code, l_quantity AS quantity
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
sets AS (
  SELECT l.message_id, list_sort(list(DISTINCT brand)) AS brands,
         coalesce(list_sort(list(DISTINCT code) FILTER (is_product AND quantity > CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 5 ELSE 45 END)), []) AS spu
  FROM evidence l JOIN orders ON o_orderkey = l.message_id GROUP BY l.message_id),
message AS (
  SELECT o_orderkey AS message_id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'commerce' ELSE 'social' END AS src_line, o_orderdate AS publish_time,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'msg ' || o_orderkey END AS content,
         CASE o_orderstatus WHEN 'F' THEN ['experience'] WHEN 'O' THEN ['inquiry'] ELSE ['review'] END AS content_type,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 + o_orderkey % 5 END AS star,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN c_mktsegment END AS category, n_name AS country,
         CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN floor(o_totalprice)::BIGINT % 500 END AS interactions,
         coalesce(brands, []) AS brands, coalesce(spu, []) AS spu
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN sets ON sets.message_id = o_orderkey),
flags AS (
  SELECT e.*, m.src_line, m.publish_time, m.content, m.content_type, m.star, m.category, m.country, m.interactions, m.brands, m.spu, p.requires_spu,
         coalesce(nullif(trim(snippet, ' '), ''), nullif(trim(content, ' '), '')) AS evidence_text,
         is_product AND sentiment = 'neg' AND coalesce(trim(snippet, ' '), '') <> '' AS product_experience,
         list_has_any(content_type, ['experience']) AND sentiment = 'neg' AND coalesce(trim(snippet, ' '), '') <> '' AS user_experience,
         list_has_any(content_type, ['review', 'bashing']) AND len(brands) >= 2 AND coalesce(nullif(trim(snippet, ' '), ''), nullif(trim(content, ' '), '')) IS NOT NULL AS comparison,
         list_has_any(content_type, ['inquiry', 'other']) AND coalesce(nullif(trim(snippet, ' '), ''), nullif(trim(content, ' '), '')) IS NOT NULL AS gap
  FROM evidence e JOIN message m USING (message_id) JOIN policy p USING (src_line)),
candidates AS (
  SELECT *, CASE WHEN product_experience THEN 'product_experience' WHEN user_experience THEN 'user_experience' WHEN comparison THEN 'comparison' ELSE 'gap' END AS content_branch,
         CASE WHEN comparison THEN 'comparison' WHEN gap THEN 'gap' ELSE 'product' END AS channel,
         CASE WHEN len(spu) > 0 THEN 'R1' WHEN NOT requires_spu THEN 'R2' ELSE 'R3' END AS rule
  FROM flags WHERE product_experience OR user_experience OR comparison OR gap),
pool AS (SELECT * FROM candidates WHERE NOT requires_spu OR len(spu) > 0),
opp_evidence AS (SELECT *, tag || '-' || (size % 8) AS opp_id, strftime(publish_time, '%G-W%V') AS attach_week FROM pool)
"""


def oracle(sql: str, *more: str) -> str:
    """A DuckDB query over the tables above and ``more`` common table expressions."""
    return "WITH RECURSIVE " + ",".join([CTE, *more]) + sql
