"""Line dedup: repeated windows of three consecutive lines, the later occurrences removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at, join_checked, row_key, settle, unclashed, whole

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(whole(text), "\n")


def _windows(lines: Column, size: int) -> Column:
    """Two independent 64-bit hashes of each run of ``size`` lines, by its first line."""
    n = F.size(lines)
    run = lambda i: [at(lines, i + j) for j in range(size)]
    hashes = F.transform(
        F.sequence(F.lit(0), n - size),
        lambda i: F.struct(F.xxhash64(*run(i)).alias("h1"), F.xxhash64(F.lit(size), *run(i)).alias("h2")),
    )
    return F.when(n >= size, hashes)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(key, covered array<int>): line positions that a later occurrence of a repeated window covers; (key) of repeated rows. Both settled.

    Windows overlap and are compared over all documents, the same document included. The first occurrence is
    the one with the smallest (id, key, line); all others are later. Rows with the same id and text share a key
    and count as occurrences of their own; ``covered`` is for the first of them, of the others all windows are
    later. A text of fewer than ``window`` lines has no windows. Null text is the empty text.
    """
    source = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    # The lines are a column of their own: an expression inside a lambda would be split anew for each line.
    source = source.select("id", row_key(F.col("id"), F.col("text")).alias("key"), _lines(F.col("text")).alias("lines"))
    occurrences = source.select("id", "key", F.posexplode(_windows(F.col("lines"), window)).alias("pos", "w")).select("key", "w.h1", "w.h2", F.struct("id", "key", "pos").alias("place"))
    # Counted and reduced before the shuffle, so that a window in a third of all rows is a few rows here.
    repeated = occurrences.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.max("place").alias("last")).where(F.col("first") < F.col("last")).drop("last")
    repeated = settle(repeated, "repeated-windows")
    later = join_checked(occurrences, repeated, ["h1", "h2"], "inner").where(F.col("place") > F.col("first"))
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set("place.pos"), lambda p: F.sequence(p, p + (window - 1)))))
    covered = settle(later.groupBy("key").agg(covered.alias("covered")), "covered-lines")
    twice = settle(source.groupBy("key").count().where("count > 1").select("key"), "repeated-rows")
    return covered, twice


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the text column replaced by what is left, and n_lines, n_removed, n_spans.

    Every other column is kept as it is; a table that already has one of the three is refused. n_lines counts the
    lines of the input (an empty or null text is one empty line), n_removed those taken out, n_spans the runs of
    them. A row without removed lines keeps its text, null included; a row that loses all lines gets the empty
    text. Of rows that agree in id and text, all but one are later occurrences as a whole: every line of a text of
    ``window`` lines or more goes. An empty table gives an empty result.
    """
    unclashed(docs, "n_lines", "n_removed", "n_spans")
    covered, twice = repeated_lines(docs, id_col, text_col, window)
    covered = covered.select(F.col("key").alias("_el_key"), F.col("covered").alias("_el_covered"))
    keyed = docs.withColumn("_el_key", row_key(F.col(id_col), whole(F.col(text_col))))
    if twice.isEmpty():
        keyed = keyed.withColumn("_el_turn", F.lit(1))
    else:
        # Which of them comes first is open, as they agree in all that the order of occurrences is made of.
        twice = twice.select(F.col("key").alias("_el_key"))
        some = settle(join_checked(keyed, twice, "_el_key", "left_semi").withColumn("_el_row", F.monotonically_increasing_id()), "repeated-texts")
        first = settle(some.groupBy("_el_key").agg(F.min("_el_row").alias("_el_first")), "first-rows")
        some = join_checked(some, first, "_el_key", "inner").withColumn("_el_turn", F.when(F.col("_el_row") == F.col("_el_first"), 1).otherwise(2)).drop("_el_row", "_el_first")
        keyed = join_checked(keyed, twice, "_el_key", "left_anti").withColumn("_el_turn", F.lit(1)).unionByName(some)
    joined = join_checked(keyed, covered, "_el_key", "left").withColumn("_el_lines", _lines(F.col(text_col)))
    every = F.when(F.size("_el_lines") >= window, F.sequence(F.lit(0), F.size("_el_lines") - 1)).otherwise(F.array().cast("array<int>"))
    joined = joined.withColumn("_el_gone", F.when(F.col("_el_turn") > 1, every).otherwise(F.coalesce(F.col("_el_covered"), F.array().cast("array<int>"))))
    lines, gone = F.col("_el_lines"), F.col("_el_gone")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    text = F.when(F.size(gone) > 0, F.array_join(F.transform(kept, lambda i: F.coalesce(at(lines, i), F.lit(""))), "\n")).otherwise(F.col(text_col))
    spans = F.size(F.array_except(gone, F.transform(gone, lambda p: p + 1)))
    return (
        joined.withColumns({"n_lines": F.size(lines).cast("long"), "n_removed": F.size(gone).cast("long"), "n_spans": spans.cast("long"), "_el_text": text})
        .withColumn(text_col, F.col("_el_text"))
        .drop("_el_key", "_el_covered", "_el_lines", "_el_gone", "_el_text", "_el_turn")
    )
