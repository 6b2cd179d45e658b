"""Document fingerprints: improved consistent weighted sampling over weighted words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from .common import SPACE_RUN, join_checked, row_key, settle, whole

#: Draws of a fingerprint: the standard error of a likeness is at most 0.032. All pairs share the draws, so their
#: errors do not average out: with 64 the mean error over a small corpus can reach 0.04.
SAMPLES = 256
#: Draws that share a seed.
TOGETHER = 4
#: A draw of a text whose smallest value exceeds MISSED / number of words (probability e^-40, as that value is
#: exponential with the number of words as its rate) may be taken from the terms that are left, or be zero.
MISSED = 40.0
#: Edited fingerprints are drawn under this share of the limits first. A draw stays open with probability e^-12, and a row with
#: an open draw in either text (one in 320) is drawn once more under the whole limits.
FIRST_SHARE = 0.3
#: The draw of a text that has words, but none under its limit: larger than any packed value.
OPEN = (1 << 63) - 1
#: Rows that meet in one window, and the ranges of ids whose quantiles the driver asks for.
BIN_ROWS, RANGES = 256, 256


def weighted_words(df: DataFrame, texts: dict[str, str], keep: list[str]) -> DataFrame:
    """``keep``, term and its weight in each of the texts, for each distinct word of any of them.

    ``texts`` maps a text column to the name of its weights. Words stand between ASCII white space; a weight is a
    word's number in the text, null where the text lacks the word. Each row also has one term without weights, which
    draws nothing, so that rows whose texts have no words are not lost. <weights>_limit goes along, where there is a
    weight, and with the term without weights if the text has words: what a text's smallest draw exceeds with the
    probability e^-MISSED only.
    """
    bodies = df.select(*keep, F.posexplode(F.array(*texts)).alias("variant", "body"))
    # A projection of its own: a text is split once for its words and for their number.
    said = bodies.select(*keep, "variant", F.array_remove(F.split(F.coalesce("body", F.lit("")), SPACE_RUN), "").alias("said"))
    limit = F.try_divide(F.lit(MISSED), F.size("said").cast("double")).alias("limit")
    words = said.select(*keep, "variant", limit, F.explode(F.concat("said", F.array(F.lit(None).cast("string")))).alias("word"))
    counts = [F.count(F.when(F.col("variant") == k, F.col("word"))).alias(w) for k, w in enumerate(texts.values())]
    limits = [F.max(F.when(F.col("variant") == k, F.col("limit"))).alias(f"{w}_limit") for k, w in enumerate(texts.values())]
    counted = words.groupBy(*keep, F.xxhash64("word").alias("term")).agg(*counts, *limits)
    return counted.select(*keep, "term", *[F.when(F.col(w) > 0, F.col(w).cast("double")).alias(w) for w in texts.values()], *[f"{w}_limit" for w in texts.values()])


def candidates(words: DataFrame, by: list[str], prints: dict[str, str], count: int = SAMPLES, share: float = 1.0) -> DataFrame:
    """``by``, the limits, draw, h0 and t and a (t0, a0, ...) for each column of weights: the terms that may win a draw, see ``samples``.

    About ``share`` * MISSED of them for each draw of a text, and the term without weights. Limits are cut to ``share``.
    """
    each = min(TOGETHER, count)
    if count % each:
        raise ValueError(f"count must be a multiple of {each}")
    weights, limits = list(prints), [f"{w}_limit" for w in prints]

    def uniform(bits: str, low: int) -> Column:
        """In (0, 1), from 32 bits."""
        part = F.shiftrightunsigned(bits, low).bitwiseAND(F.lit((1 << 32) - 1))
        return (part.cast("double") + 0.5) * (1 / float(1 << 32))

    # Each step is a projection of its own: what a later step names twice is computed once.
    given = [*by, *weights, *limits]
    most = F.greatest(*weights, F.lit(1.0))
    half = F.when(F.coalesce(*weights).isNull(), F.lit(float("inf"))).otherwise(F.greatest(*limits) if len(limits) > 1 else F.col(limits[0])) / 2
    rows = words.select(*by, *weights, *[(F.col(limit) * share).alias(limit) for limit in limits], "term")
    rows = rows.select(*given, "term", most.alias("most"), half.alias("half")).select("*", (1 / F.col("most")).alias("part"))
    carried = [*given, "most", "part", "half"]
    rows = rows.select(*carried, "term", F.explode(F.sequence(F.lit(0), F.lit(count // each - 1))).alias("block"))
    rows = rows.select(*carried, "block", F.xxhash64("term", "block").alias("seed"))
    rows = rows.select(*carried, "block", "seed", F.explode(F.array(*map(F.lit, range(each)))).alias("i"))
    rows = rows.select(*carried, (F.col("block") * each + F.col("i")).alias("draw"), F.xxhash64("seed", F.shiftleft("i", 1)).alias("h0"), F.xxhash64("seed", F.shiftleft("i", 1).bitwiseOR(F.lit(1))).alias("h1"))
    # -ln(u v) of two uniforms is Gamma(2, 1).
    rows = rows.select(*carried, "draw", "h0", uniform("h0", 0).alias("u"), uniform("h0", 32).alias("v"), (uniform("h1", 0) * uniform("h1", 32)).alias("x"), F.spark_partition_id().alias("task"))
    # Most terms cannot win a draw, as -ln x is 2 (1 - x) / (1 + x) at least: they go before any logarithm, by one comparison
    # for all columns. Where t is not 0, u (u v)^t is u v / w at least, as t is the first step under 1 / w; the largest weight
    # and the largest limit hold for every column. The term without weights passes every bound, and keeps the row of every draw.
    least = F.when(F.col("most") * F.col("u") >= 1, F.col("u") * F.col("v") * F.col("part")).otherwise(F.col("u"))
    may_win = (1 - F.col("x")) * least <= F.col("half") * (1 + F.col("x"))
    # The task's number, never negative, keeps the optimizer from moving the filter below the hashes, where it would
    # compute each of them once for every use.
    rows = rows.where(may_win | (F.col("task") < 0))
    rows = rows.select(*given, "draw", "h0", "u", (F.col("u") * F.col("v")).alias("q"), (-F.log("x") * F.col("u")).alias("a"))

    def steps(w: str) -> Column:
        first = F.col(w) * F.col("u")
        return F.when(first < 1, F.lit(0).cast("long")).when(first >= 1, F.floor(F.log(first) / -F.log("q")) + 1)

    rows = rows.select(*by, *limits, "draw", "h0", "q", "a", *[steps(w).alias(f"t{k}") for k, w in enumerate(weights)])

    def value(k: int) -> Column:
        t, q = F.col(f"t{k}"), F.col("q")
        return F.col("a") * F.when(t == 0, F.lit(1.0)).when(t == 1, q).otherwise(F.pow(q, t))

    # The bound once more, on the values themselves: fewer rows reach the aggregate.
    rows = rows.select(*by, *limits, "draw", "h0", *[f"t{k}" for k in range(len(weights))], *[value(k).alias(f"a{k}") for k in range(len(weights))], F.spark_partition_id().alias("task"))
    within, none = F.col("task") < 0, F.lit(True)
    for k, limit in enumerate(limits):
        within, none = within | F.coalesce(F.col(f"a{k}") <= F.col(limit), F.lit(False)), none & F.col(f"a{k}").isNull()
    return rows.where(within | none)


def samples(words: DataFrame, by: list[str], prints: dict[str, str], count: int = SAMPLES, share: float = 1.0) -> DataFrame:
    """``by`` and a fingerprint for each column of weights in ``prints`` (weights to name): an array of ``count`` samples of 16 bits, as short numbers.

    Draw i samples consistently: a term of weight w has r, c from Gamma(2, 1) and b from U(0, 1), all functions of
    its hash and i; t = floor(ln w / r + b), and the term with the smallest a = c exp(-r (t - b) - r) is drawn. Two
    texts draw the same (term, t) with the probability of their generalised Jaccard similarity.

    With r = -ln u - ln v and b = ln v / (ln u + ln v) of two uniforms, r is Gamma(2, 1), b uniform and independent
    of r, and a = c u (u v)^t, where t counts the j >= 0 with w u (u v)^j >= 1: of most words t is 0 without any
    logarithm. A term's a is exponential with its weight as the rate, so of long texts few terms can win a draw, and
    the rest goes before the logarithm of c. a and the code of the drawn pair are packed in one long, so a draw is a
    plain minimum, combined before any shuffle.

    With a ``share`` under 1 fewer terms reach the minimum. What is drawn is the same; a draw of a text with words, of
    which none stays under the limit, is open and null.
    """
    rows = candidates(words, by, prints, count, share)

    def draw(k: int) -> Column:
        t, a = F.col(f"t{k}"), F.col(f"a{k}")
        # The first hash stands for the term; t is small and moved off the bits' low end.
        code = F.col("h0").bitwiseXOR(F.shiftleft(t, 5)).bitwiseAND(F.lit((1 << 20) - 1))
        packed = F.shiftleft((a * float(1 << 37)).cast("long"), 20).bitwiseOR(code)
        # A row that is kept for the other text says nothing of this one: smaller values over this limit are gone. The
        # term without weights has the limit alone, if the text has words.
        return F.min(F.when(a <= F.col(limits[k]), packed).when(F.col(limits[k]).isNotNull(), F.lit(OPEN))).alias(f"d{k}")

    # Words that a text lacks have a null weight there, so a text without words draws nothing: zeros.
    limits = [f"{w}_limit" for w in prints]
    least = rows.groupBy(*by, "draw").agg(*[draw(k) for k in range(len(prints))])
    opened = F.lit(None) if share < 1 else F.lit(0)
    drawn = lambda d: F.when(d.isNull(), F.lit(0)).when(d == OPEN, opened).otherwise(d.bitwiseAND(F.lit(0xFFFF)))
    codes = [(drawn(F.col(f"d{k}")) - (1 << 15)).cast("short").alias(f"p{k}") for k in range(len(prints))]
    parts = least.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("draw", *codes))).alias("parts"))
    return parts.select(*by, *[F.col(f"parts.p{k}").alias(name) for k, name in enumerate(prints.values())])


def text_of(draws: Column) -> Column:
    """A fingerprint as text: four hex digits a draw."""
    return F.array_join(F.transform(draws, lambda x: F.lpad(F.lower(F.hex(x.cast("int") + (1 << 15))), 4, "0")), "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: int = SAMPLES) -> DataFrame:
    """(id, key, fingerprint) of each distinct (id, text); null text is empty. Words leave their task as draws only."""
    source = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    keyed = source.select("id", row_key(F.col("id"), F.col("text")).alias("key"), "text").dropDuplicates(["key"])
    words = weighted_words(keyed, {"text": "weight"}, ["id", "key"])
    return samples(words, ["id", "key"], {"weight": "fingerprint"}, count).select(F.col("id").alias(id_col), "key", text_of(F.col("fingerprint")).alias("fingerprint"))


def agreement(a: Column, b: Column, count: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints as arrays: an estimate of the texts' generalised Jaccard similarity."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x) / float(count)


def likeness(a: Column, b: Column, count: int = SAMPLES) -> Column:
    """As ``agreement``, of two fingerprints as text."""
    draws = lambda c: F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.substring(c, i * 4 + 1, F.lit(4)))
    return agreement(draws(a), draws(b), count)


def _search(splits: list[int], low: int, high: int) -> str:
    """SQL for the number of splits at or under ``id``, as a balanced tree of comparisons."""
    if low == high:
        return str(low)
    mid = (low + high) // 2
    return f"IF(id >= {splits[mid]}, {_search(splits, mid + 1, high)}, {_search(splits, low, mid)})"


def binned(source: DataFrame, bin_rows: int = BIN_ROWS, ranges: int = RANGES) -> tuple[DataFrame, DataFrame]:
    """``source`` (id, key, ...) with (range, bin), and (range, bin, head_id, head_key, to_range, to_bin) of all bins.

    Bins follow each other by falling (id, key) and hold about ``bin_rows`` rows however large the table is:
    quantiles of the id deal rows into ranges (an id that is a quantile has a range of its own), and a range is cut
    into as many bins as it needs, evenly by (id, key). to_range and to_bin name the bin before; the first bin's is
    the last one. What reaches the driver are the quantiles and a row for each range.
    """
    spark = source.sparkSession
    ranges = max(1, min(ranges, source.count() // bin_rows))
    points = source.approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    splits = sorted({int(x) + d for x in points for d in (0, 1) if int(x) + d < 1 << 63})
    ranged = source.withColumn("range", F.expr(_search(splits, 0, len(splits))))
    widths = ranged.groupBy("range").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("rows")).collect()
    widths = spark.createDataFrame([tuple(w) for w in widths], "range int, low long, high long, rows long")
    # Both casts keep the order, so bins are intervals of (id, key).
    place = F.col("high").cast("double") - F.col("id").cast("double") + (1 - (F.col("key").cast("double") / float(1 << 64) + 0.5))
    bins = F.ceil(F.col("rows") / float(bin_rows))
    at = F.least(F.floor(place / (F.col("high").cast("double") - F.col("low").cast("double") + 1) * bins), bins - 1)
    placed = ranged.join(F.broadcast(widths), "range").withColumn("bin", F.greatest(at, F.lit(0))).drop("low", "high", "rows")
    heads = settle(placed.groupBy("range", "bin").agg(F.max(F.struct("id", "key")).alias("head")), "fingerprint-heads")
    ends = heads.groupBy("range").agg(F.min("bin").alias("first"), F.max("bin").alias("last")).orderBy(F.desc("range")).collect()
    before = [(e["range"], e["first"], ends[i - 1]["range"], ends[i - 1]["last"]) for i, e in enumerate(ends)]
    before = spark.createDataFrame(before, "range int, bin long, to_range int, to_bin long")
    own = Window.partitionBy("range").orderBy("bin")
    linked = heads.withColumn("prior", F.lag("bin").over(own)).join(F.broadcast(before), ["range", "bin"], "left")
    linked = linked.select("range", "bin", F.col("head.id").alias("head_id"), F.col("head.key").alias("head_key"), F.coalesce("to_range", "range").alias("to_range"), F.coalesce("to_bin", "prior").alias("to_bin"))
    return placed, settle(linked, "fingerprint-bins")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: int = SAMPLES, bin_rows: int = BIN_ROWS, share: float = FIRST_SHARE) -> DataFrame:
    """Fingerprints of each text and of an edit of it: (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edit replaces the last floor(n_chars / 3) characters by the first as many (or all) of the next text by
    falling id, after the last one that of the first; rows with one id follow each other by the hash of their text.
    near_edited and near_next compare the fingerprint with the edit's and with the next text's. A single text is
    its own next. Null text is empty, null ids come last, repeated rows each get a row, an empty table an empty
    result. Ids must be whole numbers, as the order of ids is that of numbers. Other columns are not read.

    Rows are dealt into bins of consecutive ids; the first row of a bin also goes to the bin before it, so that
    each row meets its next one in a window over one bin. Texts are shuffled once; words are counted and draws
    combined within that partitioning. ``share`` changes the cost alone: texts with draws that it leaves open are
    drawn once more without it.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be a whole number: the next text is the one with the next smaller id")
    lowest = -(1 << 63)
    source = docs.select(F.col(id_col).alias("given"), F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("id"), whole(F.col(text_col)).alias("text"))
    placed, bins = binned(source.withColumn("key", F.xxhash64("id", "text")), bin_rows)
    head = (F.col("id") == F.col("head_id")) & (F.col("key") == F.col("head_key"))
    here = F.struct("range", "bin", F.lit(0).alias("guest"))
    there = F.struct(F.col("to_range").alias("range"), F.col("to_bin").alias("bin"), F.lit(1).alias("guest"))
    placed = join_checked(placed, bins, ["range", "bin"], "inner").select("given", "id", "key", "text", F.explode(F.when(head, F.array(here, there)).otherwise(F.array(here))).alias("at"))
    # Never null; said here, below the one exchange of texts, as a join further up would say it of one of its two looks only.
    placed = placed.select("at.range", "at.bin", "at.guest", "given", "id", "key", "text").where("range IS NOT NULL AND bin IS NOT NULL")

    following = Window.partitionBy("range", "bin").orderBy("guest", F.desc("id"), F.desc("key"))
    placed = placed.withColumns({"row": F.row_number().over(following), "next": F.lead("text").over(following), "n_chars": F.length("text")})
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - cut), F.substring("next", F.lit(1), cut))
    both = placed.select("range", "bin", "row", "guest", "given", F.col("n_chars").cast("long").alias("n_chars"), "text", F.when(F.col("guest") == 0, edited).alias("edited"))
    # Draws are combined under short keys; what else belongs to a row comes from a second look at the shuffled texts.
    # The id is among the keys so that both looks ask for the same columns, and share one exchange.
    by = ["range", "bin", "row", "given"]
    place = by[:3]
    texts = {"text": "weight", "edited": "edited_weight"}
    first = samples(weighted_words(both, texts, by), by, {"weight": "fingerprint", "edited_weight": "edited_fingerprint"}, count, share)
    # One exchange for the draws themselves and for a look at those left open: the task's number keeps the filter above it.
    first = first.drop("given").repartition(*place)
    has_open = F.exists("fingerprint", lambda x: x.isNull()) | F.exists("edited_fingerprint", lambda x: x.isNull())
    left_open = first.withColumn("task", F.spark_partition_id()).where(has_open | (F.col("task") < 0)).select(*place)
    # Rare whatever the texts, as hashes decide, and three numbers a row: broadcast, for texts are not shuffled again.
    again = both.join(F.broadcast(left_open), place)
    again = samples(weighted_words(again, texts, by), by, {"weight": "again", "edited_weight": "edited_again"}, count).drop("given")
    drawn = first.join(again, place, "left").select(*place, F.coalesce("again", "fingerprint").alias("fingerprint"), F.coalesce("edited_again", "edited_fingerprint").alias("edited_fingerprint"))
    about = both.select(*by, "guest", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    drawn = about.join(drawn, place)
    near = drawn.withColumn("next_fingerprint", F.lead("fingerprint").over(Window.partitionBy("range", "bin").orderBy("row"))).where("guest = 0")
    own, edited, after = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next_fingerprint")
    return near.select(F.col("given").alias(id_col), "n_chars", "edited_sha256", text_of(own).alias("fingerprint"), text_of(edited).alias("edited_fingerprint"), agreement(own, edited, count).alias("near_edited"), agreement(own, after, count).alias("near_next"))
