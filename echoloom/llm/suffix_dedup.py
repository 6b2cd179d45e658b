"""Suffix dedup: bytes covered by long strings that start more than once, by bucket-pointer refinement."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, is_small, join_checked, join_shuffled, settle, whole

LENGTH = 200
#: Bytes of an anchor. Of each string of LENGTH bytes, the anchor is the run of GRAM bytes with the smallest hash.
GRAM = 48
#: Windows of a text that are looked at together, so that a very long text needs no more memory.
CHUNK = 1 << 22
#: Bytes of contexts refined together in a task.
REFINED = 1 << 20
#: Positions that are sorted together there: what sorting takes beside them does not grow with the contexts.
SORTED = 1 << 20
#: Contexts of an anchor that are refined in one task (7 MB of them). Anchors with more are refined the same way, but over
#: all tasks, round by round.
HOT_CONTEXTS = 20_000
#: Bytes of the first buckets there.
FIRST = 25

_U64 = np.uint64
_STEP = 0x9E3779B97F4A7C15
_SPOTS = "akey long, c1 long, c2 long, k1 long, k2 long, start long, length long"
_CONTEXTS = "akey long, c1 long, c2 long, bytes binary"
_SPANS = "akey long, c1 long, c2 long, spans array<struct<s:long,e:long>>"


#: 128 bits that tell rows by id and text, in two longs: they can be kept in hash aggregates.
KEY = ["k1", "k2"]


def _keys(id_col: str, text_col: str) -> list[Column]:
    text = whole(F.col(text_col))
    return [F.xxhash64(F.col(id_col), text).alias("k1"), F.xxhash64(F.lit(1), F.col(id_col), text).alias("k2")]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(33))) * _U64(0xFF51AFD7ED558CCD)
    return x ^ (x >> _U64(32))


class Roller:
    """Hashes of all runs of ``gram`` bytes: prefix sums of byte values times powers of an odd number, modulo 2**64."""

    def __init__(self, gram: int) -> None:
        self.gram, self.powers, self.inverse = gram, np.ones(1, np.uint64), np.ones(1, np.uint64)
        self.values = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.powers) < n + 1:
            steps = np.full(n + 1, _STEP, np.uint64)
            steps[0] = 1
            self.powers = np.multiply.accumulate(steps)
            steps[1:] = pow(_STEP, -1, 1 << 64)
            self.inverse = np.multiply.accumulate(steps)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[:n], out=sums[1:])
        return _mix((sums[self.gram :] - sums[: n + 1 - self.gram]) * self.inverse[: n + 1 - self.gram])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values, from running minima of blocks of ``w``."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def super_windows(data: np.ndarray, roller: Roller, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hashes, starts, ends) of the runs of windows that share an anchor, chunk by chunk.

    Every window of ``length`` bytes is in exactly one run. Which anchor a window has depends on its bytes alone,
    so equal windows meet under equal anchors.
    """
    for begin in range(0, len(data) - length + 1, CHUNK):
        part = data[begin : begin + CHUNK + length - 1]
        grams = roller(part)
        low = _U64((1 << 23) - 1)
        place = _sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - roller.gram + 1) & low
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:], [len(place)]]) - 1
        yield grams[place[first].astype("int64")].view("int64"), first + begin, last + begin + length


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    column = batch.column(batch.schema.get_field_index(name))
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary())
    for value in column:
        yield np.frombuffer(value.as_buffer(), np.uint8)


def find_spots(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(k1, k2, text) to a row for each run of windows with one anchor: the anchor, a 128-bit hash of the run, its place."""
    roller, names = Roller(gram), [c.split()[0] for c in _SPOTS.split(", ")]
    for batch in batches:
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        digests: list[bytes] = []
        keys = zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True)

        def flush() -> pa.RecordBatch:
            hashes = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            akey, k1, k2, start, size = (np.concatenate(x) for x in out)
            for x in out:
                x.clear()
            digests.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (akey, hashes[:, 0], hashes[:, 1], k1, k2, start, size)], names=names)

        for (k1, k2), data in zip(keys, _texts(batch, "text"), strict=True):
            view = memoryview(data)
            for akey, starts, ends in super_windows(data, roller, length) if len(data) >= length else ():
                digests += [xxhash.xxh3_128_digest(view[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                for x, y in zip(out, (akey, np.full(len(akey), k1), np.full(len(akey), k2), starts, ends - starts), strict=True):
                    x.append(y.astype("int64"))
                if len(digests) > 200_000:
                    yield flush()
        if digests:
            yield flush()


def refine(data: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """For each position of ``data``: whether its next ``length`` bytes, within its piece, start at another position too.

    ``ends[p]`` is the end of the piece that holds p. Positions are put in buckets by their first 8 bytes. Then,
    again and again, each bucket is split by sorting on the buckets of the positions ``depth`` bytes later, which
    the last round has already refined, so the depth doubles. A position alone in its bucket is settled and sorted
    no more. Takes some 30 bytes of memory for one of ``data``, which must be under 2 GB.
    """
    ends = ends.astype("int32", copy=False)
    n, depth = len(data), min(8, length)
    alive = np.flatnonzero(ends - np.arange(n, dtype="int32") >= depth).astype("int32")
    # A look at the 8 bytes from each position on, without a copy of all.
    by = np.ndarray(n, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))[alive]
    if depth < 8:
        by &= _U64((1 << (8 * depth)) - 1)
    bucket = np.empty(n, "int32")

    def deal(at: np.ndarray, by: np.ndarray) -> np.ndarray:
        """New buckets for the positions ``at``; returns those that are not alone.

        Equal values of ``by`` fall in one share, and shares of about SORTED positions are sorted one after the other.
        """
        bucket.fill(-1)
        shares, share = min(255, 1 + len(by) // SORTED), np.zeros(len(by), np.uint8)
        for i in range(0, len(by) if shares > 1 else 0, SORTED):
            share[i : i + SORTED] = (_mix(by[i : i + SORTED]) >> _U64(40)) % _U64(shares)
        dealt = 0
        for k in range(shares):
            own = np.flatnonzero(share == k)
            own = own[np.argsort(by[own], kind="stable")]
            ranked = by[own]
            fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(own) else np.zeros(0, bool)
            number = np.cumsum(fresh) - 1
            shared = np.bincount(number, minlength=1)[number] > 1
            bucket[at[own[shared]]] = number[shared] + dealt
            dealt += len(own)
        return at[bucket[at] >= 0]

    alive = deal(alive, by)
    while depth < length and len(alive):
        step = min(depth, length - depth)
        alive = alive[ends[alive] - alive >= depth + step]
        alive = alive[bucket[alive + step] >= 0]
        by = bucket[alive].astype(np.uint64)
        by <<= _U64(32)
        by |= bucket[alive + step].view("uint32")
        alive = deal(alive, by)
        depth += step
    repeated = np.zeros(n, bool)
    repeated[alive] = True
    return repeated


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint spans, rising, of spans that may overlap or touch."""
    order = np.argsort(starts, kind="stable")
    out: list[tuple[int, int]] = []
    for s, e in zip(starts[order].tolist(), ends[order].tolist(), strict=True):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _span_rows(keys: list[tuple], spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    columns = list(zip(*keys, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([[{"s": s, "e": e} for s, e in x] for x in spans], kind)], names=["akey", "c1", "c2", "spans"])


def refine_contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Contexts, sorted by anchor, to the spans of them that repeated windows cover. Whole anchors are refined together."""
    keys: list[tuple] = []
    parts: list[bytes] = []
    held = 0

    def run() -> pa.RecordBatch:
        bounds = np.cumsum([0, *map(len, parts)])
        data = np.frombuffer(b"".join(parts), np.uint8)
        parts.clear()
        hits = np.flatnonzero(refine(data, np.repeat(bounds[1:].astype("int32"), np.diff(bounds)), length))
        cuts = np.searchsorted(hits, bounds)
        names, spans = [], []
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            own = hits[cuts[i] : cuts[i + 1]] - bounds[i]
            names.append(keys[i])
            spans.append(merged(own, own + length))
        return _span_rows(names, spans)

    for batch in batches:
        akey, c1, c2 = (batch.column(i).to_pylist() for i in range(3))
        for k, x, y, b in zip(akey, c1, c2, batch.column(3).to_pylist(), strict=True):
            if held >= REFINED and k != keys[-1][0]:
                yield run()
                keys.clear()
                held = 0
            keys.append((k, x, y))
            parts.append(b)
            held += len(b)
    if parts:
        yield run()


def slice_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, spots array<struct<akey, c1, c2, start, length>>) to (akey, c1, c2, bytes)."""
    names = ["akey", "c1", "c2", "bytes"]
    for batch in batches:
        rows, held = [], 0
        for data, spots in zip(_texts(batch, "text"), batch.column(1), strict=True):
            for s in spots.as_py():
                rows.append((s["akey"], s["c1"], s["c2"], data[s["start"] : s["start"] + s["length"]].tobytes()))
                held += s["length"]
            if held > 1 << 22:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:3]), pa.array([r[3] for r in rows], pa.binary())], names=names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:3]), pa.array([r[3] for r in rows], pa.binary())], names=names)


def first_buckets(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
    """(context, bytes) to (context, pos, g1, g2): a 128-bit hash of the ``first`` bytes at each position."""
    for batch in batches:
        for context, data in zip(batch.column(0).to_pylist(), _texts(batch, "bytes"), strict=True):
            view, n = memoryview(data), len(data) - first + 1
            hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[p : p + first]) for p in range(n)), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, context)), pa.array(np.arange(n)), pa.array(hashes[:, 0]), pa.array(hashes[:, 1])], names=["context", "pos", "g1", "g2"])


def _hot_spans(contexts: DataFrame, length: int, first: int = FIRST) -> DataFrame:
    """Spans of contexts under very frequent anchors: bucket-pointer refinement as in refine(), a table of positions a round.

    Positions start in buckets by their first bytes. A round splits the buckets by the buckets of the positions
    ``depth`` bytes later, as the round before left them, and drops positions that are alone. Buckets are counted
    with partial sums and named by number, so no task gathers one.
    """
    first = min(first, length)
    contexts = settle(contexts.withColumn("context", F.monotonically_increasing_id()), "hot-contexts")

    def deal(rows: DataFrame, by: list[str]) -> DataFrame:
        named = settle(rows.groupBy(*by).count().where("count > 1").select(*by, F.monotonically_increasing_id().alias("bucket_")), "hot-buckets")
        return settle(join_shuffled(rows, named, by, "inner").select("context", "pos", F.col("bucket_").alias("bucket")), "hot-positions")

    rows = settle(contexts.select("context", "bytes").mapInArrow(lambda b: first_buckets(b, first), "context long, pos long, g1 long, g2 long"), "hot-grams")
    rows, depth = deal(rows, ["g1", "g2"]), first
    while depth < length:
        step = min(depth, length - depth)
        later = rows.select("context", (F.col("pos") - step).alias("pos"), F.col("bucket").alias("later"))
        rows, depth = deal(rows.join(later, ["context", "pos"]), ["bucket", "later"]), depth + step
    spans = rows.groupBy("context").agg(F.transform(F.array_sort(F.collect_list("pos")), lambda p: F.struct(p.alias("s"), (p + length).alias("e"))).alias("spans"))
    return contexts.select("context", "akey", "c1", "c2").join(spans, "context").drop("context")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(k1, k2, spans): byte spans of each text, possibly overlapping, that strings of ``length`` bytes with another start cover.

    1. Windows of ``length`` bytes are gathered in runs with one anchor: a hundredth as many rows as bytes.
    2. Runs under an anchor that occurs once are unique. Runs that occur twice as they are, are covered whole.
    3. What is left are runs at the borders of repeats: of each, one copy's bytes are fetched, and the runs of an
       anchor are refined together, by bucket pointers, to depth ``length``: inside a task, or round by round over
       all tasks where an anchor has too many.
    """
    source = docs.select(*_keys(id_col, text_col), whole(F.col(text_col)).alias("text"))
    found = settle(source.mapInArrow(lambda b: find_spots(b, length, gram), _SPOTS), "suffix-spots")
    common = settle(found.groupBy("akey").count().where("count > 1").select("akey"), "suffix-anchors")
    spots = settle(join_shuffled(found, common, "akey", "left_semi"), "suffix-common")
    discard(found, common)
    # First of a group in one scan order: all three are of one row.
    runs = settle(spots.groupBy("akey", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.first("start").alias("start"), F.first("length").alias("length")), "suffix-runs")
    several = settle(runs.groupBy("akey").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1"), "suffix-several")
    border = settle(join_shuffled(runs, several, "akey", "inner"), "suffix-border")

    wanted = border.groupBy("k1", "k2").agg(F.collect_list(F.struct("akey", "c1", "c2", "start", "length")).alias("spots"))
    named = settle(border.select("k1", "k2").distinct(), "suffix-named")
    texts = join_checked(source, named, KEY, "left_semi").join(wanted, KEY).select("text", "spots")
    contexts = texts.mapInArrow(slice_contexts, _CONTEXTS)
    hot = settle(several.where(F.col("contexts") > HOT_CONTEXTS).select("akey"), "suffix-hot")
    if hot.isEmpty():
        spans = contexts.repartition("akey").sortWithinPartitions("akey").mapInArrow(lambda b: refine_contexts(b, length), _SPANS)
    else:
        contexts = settle(contexts, "suffix-contexts").dropDuplicates(["akey", "c1", "c2"])
        cold = join_checked(contexts, hot, "akey", "left_anti").repartition("akey").sortWithinPartitions("akey").mapInArrow(lambda b: refine_contexts(b, length), _SPANS)
        spans = cold.unionByName(_hot_spans(join_checked(contexts, hot, "akey", "left_semi"), length))
    # Runs that occur twice come last and whole.
    twice = runs.where("n > 1").select("akey", "c1", "c2", F.array(F.struct(F.lit(0).cast("long").alias("s"), F.col("length").alias("e"))).alias("spans"))
    covered = settle(spans.unionByName(twice), "suffix-spans")
    discard(runs, several, border, named, hot)
    placed = join_shuffled(spots, covered, ["akey", "c1", "c2"], "inner").select("k1", "k2", F.transform("spans", lambda x: F.struct((x["s"] + F.col("start")).alias("s"), (x["e"] + F.col("start")).alias("e"))).alias("spans"))
    out = settle(placed.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans")), "suffix-covered")
    discard(spots, covered)
    return out


def cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, spans) to (id, n_bytes, n_removed, n_spans, kept, kept_sha256)."""
    for batch in batches:
        rows = []
        for data, spans in zip(_texts(batch, "text"), batch.column(2), strict=True):
            spans = spans.as_py() or []
            gone = merged(np.array([s["s"] for s in spans], "int64"), np.array([s["e"] for s in spans], "int64"))
            kept, at = [], 0
            for s, e in gone:
                kept.append(data[at:s].tobytes())
                at = e
            kept.append(data[at:].tobytes())
            left = b"".join(kept)
            rows.append((len(data), len(data) - len(left), len(gone), left, hashlib.sha256(left).hexdigest()))
        n, removed, count, left, digest = zip(*rows, strict=True) if rows else ([], [], [], [], [])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(left, pa.binary()), pa.array(digest, pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, kept_sha256), a row for each row of ``docs``.

    Removes each byte of a text that lies in a string of ``length`` bytes that also starts anywhere else, the same
    text included; overlaps count, strings are judged on the input, and none crosses texts. ``kept`` are the
    remaining bytes (a cut may split a character). Null text is empty; texts shorter than ``length`` stay whole;
    rows that agree in id and text are copies of each other like any two rows. Strings are compared by their bytes
    or by 128-bit hashes. Empty tables give empty results; other columns are not read.
    """
    spans = repeated_spans(docs, id_col, text_col, length, gram)
    id_type = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"), *_keys(id_col, text_col))
    named = spans.select(*KEY)
    if is_small(named):
        # Texts without a span stay where they are; the others move to theirs.
        touched = keyed.join(F.broadcast(named), KEY, "left_semi").join(spans, KEY).select("id", "text", "spans")
        joined = keyed.join(F.broadcast(named), KEY, "left_anti").select("id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")).unionByName(touched)
    else:
        joined = keyed.join(spans, KEY, "left").select("id", "text", "spans")
    return joined.mapInArrow(cut_spans, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string").withColumnRenamed("id", id_col)
