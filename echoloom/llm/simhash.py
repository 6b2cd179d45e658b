"""SimHash near-duplicates: fingerprints by majority, candidates by shared positional bytes, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_checked, settle, solid_words
from .graph import connected_components

SIZE, BITS = 4, 4
BYTES = 8
#: Lists of more fingerprints than this are intersected further, by half bytes.
LONG_LIST = 512
#: Shingle hashes whose bits are counted at a time.
TOGETHER = 1 << 16

_U64 = np.uint64


def shingle_hashes(df: DataFrame, text_col: str, *keep: str, size: int = SIZE) -> DataFrame:
    """``keep`` and the 64-bit hashes of all runs of ``size`` words, repeats included; of fewer words, of all of them."""
    worded = df.select(*keep, solid_words(F.col(text_col)).alias("words")).withColumn("n", F.size("words"))
    run = lambda i: F.xxhash64(F.concat_ws(" ", *[F.get("words", i + j) for j in range(size)]))
    hashes = F.when(F.col("n") == 0, F.array().cast("array<long>")).when(F.col("n") < size, F.array(F.xxhash64(F.array_join("words", " ")))).otherwise(F.transform(F.sequence(F.lit(0), F.col("n") - size), run))
    return worded.select(*keep, hashes.alias("hashes"))


def majority(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, hashes) to (id, print): a bit is 1 if it is set in over half the hashes. Bits are counted in bounded pieces."""
    for batch in batches:
        lists = batch.column(1)
        offsets = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        counts = np.zeros((len(lists), 64), "int64")
        for begin in range(int(offsets[0]), int(offsets[-1]), TOGETHER):
            end = min(begin + TOGETHER, int(offsets[-1]))
            bits = np.unpackbits(flat[begin:end].view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little")
            rows = np.arange(np.searchsorted(offsets, begin, "right") - 1, np.searchsorted(offsets, end, "left"))
            rows = rows[np.diff(offsets)[rows] > 0]
            counts[rows] += np.add.reduceat(bits, np.maximum(offsets[rows], begin) - begin, axis=0, dtype="int32")
        set_ = 2 * counts > np.diff(offsets)[:, None]
        prints = np.packbits(set_, axis=1, bitorder="little").reshape(-1).view("<i8") if len(lists) else np.zeros(0, "int64")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["id", "print"])


def simhashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(id, print) of each row; a text without words has fingerprint zero."""
    hashed = shingle_hashes(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "id", size=size)
    return hashed.mapInArrow(majority, f"id {docs.schema[id_col].dataType.simpleString()}, print long")


def byte_masks(matches: int) -> list[int]:
    """Masks of all choices of ``matches`` of the eight byte positions."""
    return [sum(0xFF << 8 * p for p in chosen) for chosen in combinations(range(BYTES), matches)]


def half_byte_masks(mask: int, bits: int) -> list[int]:
    """``mask`` with all choices of half bytes outside it, as many as must agree where at most ``bits`` bits differ."""
    free = [p for p in range(2 * BYTES) if not mask >> 4 * p & 0xF]
    return [mask | sum(0xF << 4 * p for p in chosen) for chosen in combinations(free, max(0, len(free) - bits))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links_of_list(prints: np.ndarray, matches: int, bits: int) -> list[tuple[int, int]]:
    """Links that connect what a list's fingerprints link: fewer than it has members."""
    label, found = np.arange(len(prints)), []
    for i in range(len(prints) - 1):
        if len(found) == len(prints) - 1:
            break
        differ = prints[i + 1 :] ^ prints[i]
        # The tally of equal bytes at equal places, then the exact check of what reaches it.
        near = np.flatnonzero((label[i + 1 :] != label[i]) & (np.bitwise_count(differ) <= bits))
        near = near[(differ[near].view(np.uint8).reshape(-1, BYTES) == 0).sum(1) >= matches] + i + 1
        for other, at in zip(*np.unique(label[near], return_index=True), strict=True):
            found.append((i, int(near[at])))
            label[label == other] = label[i]
    return found


def compare_lists(batches: Iterator[pa.RecordBatch], matches: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(part, print), sorted, with the lists' other keys in between, to the links (a, b) of each list."""
    held: list[np.ndarray] = []
    key = None

    def links(prints: np.ndarray) -> pa.RecordBatch:
        pairs = np.array(links_of_list(prints, matches, bits), "int64").reshape(-1, 2)
        ends = prints.view("int64")[pairs]
        return pa.RecordBatch.from_arrays([pa.array(ends.min(1)), pa.array(ends.max(1))], names=["a", "b"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype("int64") for i in range(2)])
        prints = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
        fresh = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for begin, end in zip([0, *fresh.tolist()], [*fresh.tolist(), n], strict=True):
            now = tuple(keys[begin].tolist())
            if now != key and held:
                whole = np.concatenate(held)
                if len(whole) > 1:
                    yield links(whole)
                held = []
            key = now
            held.append(prints[begin:end])
    if held and len(whole := np.concatenate(held)) > 1:
        yield links(whole)


def simhash_links(prints: DataFrame, bits: int = BITS, long_list: int = LONG_LIST) -> DataFrame:
    """Links (a, b) among the distinct fingerprints ``print`` that connect all that differ in at most ``bits`` bits, settled.

    Two such fingerprints agree in at least 8 - bits bytes. The index posts a fingerprint under its bytes by place,
    that many places intersected at once: a list for one byte alone would hold a 256th of all fingerprints. Lists of
    one member go. The members of a list of more than ``long_list`` agree in those bytes, and any linked two of them
    in further half bytes: they are posted again under the choices of these, so that a list holds at most
    2^(4 * bits) fingerprints however alike all are. Lists are compared inside tasks, by tally and by exact check,
    and leave fewer links than members.
    """
    if not 0 < bits < BYTES:
        raise ValueError(f"at most {BYTES - 1} bits may differ, for a byte at least to agree")
    spark, matches = prints.sparkSession, BYTES - bits
    masks = byte_masks(matches)
    posted = prints.select("print", F.posexplode(F.array(*[F.col("print").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("place", "part"))
    lists = settle(posted.groupBy("place", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-lists")
    members = settle(join_checked(posted, lists, ["place", "part"], "inner").select("place", "part", "print", "n"), "simhash-members")
    short = members.where(F.col("n") <= long_list).select("place", "part", "print")
    finer = [(i, i * 1000 + j, signed(m)) for i, mask in enumerate(masks) for j, m in enumerate(half_byte_masks(mask, bits))]
    finer = spark.createDataFrame(finer, "place int, finer int, mask long")  # a fixed table: 70 choices of 70 for 4 bits
    long_ = members.where(F.col("n") > long_list).join(F.broadcast(finer), "place").select((F.col("finer") + 1000).alias("place"), F.col("print").bitwiseAND(F.col("mask")).alias("part"), "print")
    rows = short.unionByName(long_).repartition("place", "part").sortWithinPartitions("place", "part")
    return settle(rows.mapInArrow(lambda x: compare_lists(x, matches, bits), "a long, b long").distinct(), "simhash-links")


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, bits: int = BITS) -> DataFrame:
    """(id, print, component_id), a row for each row of ``docs``.

    A fingerprint's bit is 1 if it is set in over half of the hashes (XXH64, seed 42) of a text's runs of ``size``
    words, A-Z lower-cased, between ASCII white space, repeats included; of fewer words, the whole sequence is the
    only run. Documents are linked if their fingerprints differ in at most ``bits`` bits; component_id is the
    smallest id in a document's connected component.

    Equal fingerprints are one node, so copies cost a row each and no links. Null, empty and blank texts have
    fingerprint zero and are linked like any other. Repeated rows each get a row; null ids get one too and name no
    component (its component_id is null where no member has an id). An empty table gives an empty result; other
    columns are not read.
    """
    signed_ = settle(simhashes(docs, id_col, text_col, size), "simhash-prints")
    classes = settle(signed_.groupBy("print").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies")), "simhash-classes")
    parts = settle(connected_components(simhash_links(classes.select("print"), bits)), "simhash-components")
    # Fingerprints of one row without links are their own component and need no join.
    placed = classes.join(parts, classes["print"] == parts["node"], "left").select("print", "low", "copies", F.coalesce("component", "print").alias("root"), F.col("component").isNotNull().alias("linked")).where("linked OR copies > 1")
    placed = settle(placed, "simhash-placed")
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = settle(placed.join(lowest, "root").select("print", "component_id", F.lit(True).alias("found")), "simhash-named")
    out = join_checked(signed_, named, "print", "left")
    return out.select(F.col("id").alias(id_col), "print", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
