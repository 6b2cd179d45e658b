"""The training-data pipeline over ``documents``: toxicity, line dedup, near-dedup, decontamination, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoloom.llm.common import shared_dir, table
from echoloom.llm.decontaminate import drop_contaminated
from echoloom.llm.line_dedup import line_dedup
from echoloom.llm.near_dup import keep_one
from echoloom.llm.packing import pack
from echoloom.llm.toxicity import score, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the severity model, fitted on ``labels``, calls toxic.

    A null text is not toxic. Equal rows are judged alike, so all of them stay or all go; no ties arise. An empty table stays
    empty, and without labels nothing goes.
    """
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).where(~F.col("toxic")).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows removed. n_chars follows the text; emptied documents stay.

    Of equal windows the one with the smallest (id, line) is first; of rows with equal id and text one keeps its lines. An
    empty table stays empty.
    """
    out = line_dedup(docs).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of documents with five-word shingle similarity of 0.8 or more.

    The one with the smallest id stays; of rows that share it, that with the smallest key of its text, and of rows equal
    in both one. Documents without words all stay.
    """
    return keep_one(docs, size=5, percent=80).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a ten-word window of a ``benchmark`` item.

    Equal rows go together. Null and empty texts stay; an empty benchmark drops nothing.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each token of the remaining documents goes. Equal rows are packed each; ties among pieces go by id and place; an
    empty table gives no pieces."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: A fitted model, MinHash candidates and a tokenizer: SQL cannot express it. tests/llm holds it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{shared_dir(spark)}/stage-{k}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
