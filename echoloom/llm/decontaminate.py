"""Benchmark decontamination: a positional inverted index searched from the rarest terms of each window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import alnum_words, join_checked, row_key, settle, whole

WINDOW = 10
#: Lists intersected before the words themselves are compared: the rarest terms of a window.
RAREST = 3
#: Positions by which the two rarest terms of a window may stand nearer or farther than in the window, for a proximity match.
SLACK = 3

#: Ends each document in the index, at the position after its last word. No word is empty.
END = ""


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(wid, k, words) of the distinct windows of all items, numbered, and (wid, item_id); both settled.

    An item of fewer words than ``size``, but not none, is one window; one without words (null text) has none.
    """
    worded = items.select(F.col(id_col).alias("item_id"), alnum_words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    runs = worded.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, size))).alias("words"))
    runs = settle(runs.select("item_id", "words", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), "words").alias("h2")), "item-windows")
    windows = runs.groupBy("h1", "h2").agg(F.first("words").alias("words"))
    # The numbers are fixed by being written.
    windows = settle(windows.select("h1", "h2", F.monotonically_increasing_id().alias("wid"), F.size("words").alias("k"), "words"), "windows")
    owners = join_checked(runs.select("h1", "h2", "item_id"), windows.select("h1", "h2", "wid"), ["h1", "h2"], "inner")
    return windows.select("wid", "k", "words"), settle(owners.select("wid", "item_id").distinct(), "window-items")


def build_index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, key, pos, id): postings of every occurrence of the vocabulary's terms in whole texts, settled.

    The table is kept by document (each file holds all postings of its documents), so building it moves no rows
    between tasks. ``id`` is set on a document's END posting alone, whose position is its number of words. Rows
    with the same id and text share a key and its postings.
    """
    terms = settle(vocabulary.select("term").unionByName(vocabulary.sparkSession.createDataFrame([(END,)], "term string")).distinct(), "terms")
    worded = docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), whole(F.col(text_col))).alias("key"), alnum_words(F.col(text_col)).alias("w"))
    places = worded.select("id", "key", F.posexplode(F.concat("w", F.array(F.lit(END)))).alias("pos", "term"))
    return settle(join_checked(places, terms, "term", "inner").select("term", "key", "pos", F.when(F.col("term") == END, F.col("id")).alias("id")), "postings")


def rare_terms(index: DataFrame, windows: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(term, wid, k, offset, rank, of): of each window the terms with the fewest postings, and how many of them; settled."""
    # A row for each term of the benchmark: small beside the windows, so a term that many of them hold is no hot key.
    counts = settle(index.groupBy("term").count(), "term-counts")
    spots = windows.select("wid", "k", F.posexplode("words").alias("offset", "term"))
    # A term without postings is the rarest of all: its window cannot match.
    spots = join_checked(spots, counts, "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    by_window = Window.partitionBy("wid").orderBy("count", "offset")
    ranked = spots.withColumn("rank", F.row_number().over(by_window)).where(F.col("rank") <= rarest)
    return settle(ranked.select("term", "wid", "k", "offset", "rank", F.least("k", F.lit(rarest)).alias("of")), "rare-terms")


def meetings(index: DataFrame, rare: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(key, wid, k, of, s1 .. s``rarest``): the offset-adjusted lists of a window's rare terms in one document.

    A group is what one document holds of one window, so it grows with a document and not with the corpus. Sets, as
    repeated rows bring the same postings more than once. Documents that lack one of the two rarest terms are gone.
    """
    lists = join_checked(index.where(F.col("term") != END), rare, "term", "inner")
    starts = lists.select("key", "wid", "k", "of", "rank", (F.col("pos") - F.col("offset")).alias("start"))
    met = starts.groupBy("key", "wid", "k", "of").agg(*[F.collect_set(F.when(F.col("rank") == r, F.col("start"))).alias(f"s{r}") for r in range(1, rarest + 1)])
    return met.where((F.size("s1") > 0) & ((F.col("of") == 1) | (F.size("s2") > 0)))


def phrase_starts(rarest: int = RAREST) -> Column:
    """Of a meeting: the places where the lists of all rare terms agree."""
    starts = F.col("s1")
    for r in range(2, rarest + 1):
        starts = F.when(F.col("of") < r, starts).otherwise(F.array_intersect(starts, F.col(f"s{r}")))
    return F.filter(starts, lambda s: s >= 0)


def near_places(slack: int) -> Column:
    """Of a meeting: (start, drift) where the two rarest terms stand within ``slack`` of their distance.

    drift is the difference from that distance; 0 is as in the window. Windows of one term match at each posting.
    """
    place = lambda d: F.transform(F.array_intersect("s1", F.transform("s2", lambda s: s - d)), lambda s: F.struct(s.alias("start"), d.alias("drift")))
    pairs = F.flatten(F.transform(F.sequence(F.lit(-slack), F.lit(slack)), place))
    return F.when(F.col("of") == 1, F.transform("s1", lambda s: F.struct(s.alias("start"), F.lit(0).alias("drift")))).otherwise(pairs)


def proximity_matches(index: DataFrame, rare: DataFrame, slack: int = SLACK) -> DataFrame:
    """(key, wid, start, drift): all proximity matches of all windows."""
    return meetings(index, rare).select("key", "wid", F.explode(near_places(slack)).alias("at")).select("key", "wid", "at.start", "at.drift")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """(id, key, n_words, n_hit, n_items, items_sha256, contaminated, n_near), a row for each row of ``docs``.

    n_hit counts the words of a document inside any occurrence of a window, n_items the items with an occurring
    window, items_sha256 their ids, sorted as strings and comma-joined; n_near counts the distinct windows with a
    proximity match (their two rarest terms within ``slack`` of their distance), exact ones included. Null or empty texts have no words and no
    hits; without items nothing is hit. Items with the same id are one item. Equal rows have equal results;
    an empty table gives an empty result. Other columns are not read.
    """
    windows, owners = item_windows(items, item_col, item_text_col, size)
    index = build_index(docs, windows.select(F.explode("words").alias("term")), id_col, text_col)
    met = meetings(index, rare_terms(index, windows)).select("key", "wid", "k", phrase_starts().alias("starts"), (F.size(near_places(slack)) > 0).alias("near"))
    met = settle(met.where((F.size("starts") > 0) | F.col("near")), "meetings")
    found = met.select("key", "wid", "k", F.explode("starts").alias("start"))
    # The other words are compared in the texts that have candidates, and only there.
    named = settle(found.select("key").distinct(), "candidate-keys")
    keyed = docs.select(row_key(F.col(id_col), whole(F.col(text_col))).alias("key"), F.col(text_col).alias("text"))
    texts = settle(join_checked(keyed, named, "key", "left_semi").dropDuplicates(["key"]).select("key", alnum_words(F.col("text")).alias("w")), "candidate-texts")
    placed = join_checked(found, windows.select("wid", "words"), "wid", "inner")
    exact = placed.join(texts, (placed["key"] == texts["key"]) & (F.slice(texts["w"], placed["start"] + 1, placed["k"]) == placed["words"])).select(placed["key"], "wid", "start", "k")
    exact = settle(exact, "phrase-matches")
    spans = exact.select("key", "start", "k").distinct().groupBy("key").agg(F.size(F.array_distinct(F.flatten(F.transform(F.collect_list(F.struct("start", "k")), lambda s: F.sequence(s["start"], s["start"] + s["k"] - 1))))).cast("long").alias("n_hit"))
    hit = join_checked(exact.select("key", "wid").distinct(), owners, "wid", "inner").select("key", F.col("item_id").cast("string").alias("item")).distinct()
    named_items = hit.groupBy("key").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    near = met.where("near").groupBy("key").agg(F.count(F.lit(1)).alias("n_near"))
    hits = settle(spans.join(named_items, "key").join(near, "key", "full"), "document-hits")
    ends = index.where(F.col("term") == END).select(F.col("id").alias(id_col), "key", F.col("pos").cast("long").alias("n_words"))
    zero = F.lit(0).cast("long")
    return join_checked(ends, hits, "key", "left").select(id_col, "key", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), F.coalesce("n_near", zero).alias("n_near"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that hold an occurrence of any window of ``items``; all columns kept."""
    bad = decontaminate(docs, items, id_col, text_col, **how).where("contaminated").select(F.col("key").alias("_el_key")).distinct()
    keyed = docs.withColumn("_el_key", row_key(F.col(id_col), whole(F.col(text_col))))
    return join_checked(keyed, settle(bad, "contaminated"), "_el_key", "left_anti").drop("_el_key")
