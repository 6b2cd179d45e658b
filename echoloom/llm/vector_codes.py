"""Vector code compression: product codes whose nearest entries are found through segment-mean lower bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_checked, settle
from .whole_vectors import integer_vectors, matrix, shape

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Blocks of a part whose means bound a distance from below, coarse to fine.
BLOCKS = (4, 8)
#: Vectors that are held against a codebook at a time.
CHUNK = 2048
#: Rounding of the bounds, as a share of the numbers that enter them: far more than doubles lose.
SLACK = 1e-9


def sketch(x: np.ndarray, blocks: int) -> np.ndarray:
    """Block sums over the root of the block's length, and the norm of what the block means leave.

    The squared distance of two sketches is at most that of the vectors: block means give their share of it exactly,
    and residuals are at least as far apart as their norms.
    """
    width = x.shape[1]
    starts = np.unique(np.linspace(0, width, min(blocks, width) + 1).astype(int)[:-1])
    lengths = np.diff([*starts, width])
    means = np.add.reduceat(x, starts, axis=1) / np.sqrt(lengths)
    rest = np.sqrt(np.maximum((x.astype(float) ** 2).sum(1) - (means**2).sum(1), 0))
    return np.column_stack([means, rest])


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each point's nearest entry, ties to the lower index; exact whole numbers.

    The entry with the smallest coarse bound gives an upper bound by its exact distance, and entries whose coarse
    bound exceeds it are out; the smallest fine bound of the rest tightens it once more. What survives the fine
    bounds too is decided by exact distances.
    """
    index, distance = np.empty(len(points), "int64"), np.empty(len(points), "int64")
    sizes = (book**2).sum(1)
    # A sketch's norm is its vector's, so a product gives bounds without the point's own norm.
    coarse_table, fine_table = (np.column_stack([-2 * sketch(book, b), sizes]).T.copy() for b in BLOCKS)
    for begin in range(0, len(points), CHUNK):
        x = points[begin : begin + CHUNK]
        own, ones = (x**2).sum(1), np.ones(len(x))
        slack = SLACK * (own + sizes.max() + 1.0)

        def upper(guess: np.ndarray, x=x, own=own, slack=slack) -> np.ndarray:
            return ((x - book[guess]) ** 2).sum(1) - own + slack

        coarse = np.column_stack([sketch(x, BLOCKS[0]), ones]) @ coarse_table
        limit = upper(coarse.argmin(1))
        fine = np.column_stack([sketch(x, BLOCKS[1]), ones]) @ fine_table
        fine[coarse > limit[:, None]] = np.inf
        limit = np.minimum(limit, upper(fine.argmin(1)))
        row, entry = np.divmod(np.flatnonzero(fine <= limit[:, None]), len(book))
        exact = own[row] + sizes[entry] - 2 * np.einsum("ij,ij->i", x[row], book[entry])
        # Rows follow each other with their entries rising; the smallest (distance, entry) of each.
        first = np.flatnonzero(np.diff(row, prepend=-1))
        best = np.minimum.reduceat(exact * len(book) + entry, first)
        index[begin : begin + CHUNK], distance[begin : begin + CHUNK] = best % len(book), best // len(book)
    return index, distance


def _assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, distances), a column for each part."""
    parts, _, width = books.shape
    found = [nearest(np.ascontiguousarray(x[:, p * width : (p + 1) * width]), books[p]) for p in range(parts)]
    return np.column_stack([i for i, _ in found]), np.column_stack([d for _, d in found])


def _sums(vectors: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and numbers of the vectors' parts by codebook entry: added up inside tasks, then by Spark."""
    parts, entries, width = books.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), "int64")
        for batch in batches:
            x = matrix(batch.column(0), parts * width)
            index, _ = _assign(x, books)
            for p in range(parts):
                np.add.at(total[p], index[:, p], np.column_stack([x[:, p * width : (p + 1) * width], np.ones(len(x), "int64")]))
        flat = total.ravel()
        place = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(place.astype("int64")), pa.array(flat[place])], names=["place", "total"])

    total = np.zeros((parts, entries, width + 1), "int64")
    for r in vectors.select("x").mapInArrow(partial, "place long, total long").groupBy("place").agg(F.sum("total").alias("total")).collect():
        total.ravel()[r["place"]] = r["total"]
    return total[:, :, :-1], total[:, :, -1]


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (part, entry, position) of a settled table of vectors (id, x); None without vectors.

    They start as the vectors with the smallest ids (null ids last, equal ids by their vectors; with fewer vectors,
    a codebook has as many entries). Every round assigns all vectors to them and replaces each used entry by
    floor(sum / count). A codebook, sums and counts by entry, is all that passes through the driver.
    """
    n, width, least, most = shape(vectors)
    if not n:
        return None
    if width % parts:
        raise ValueError(f"vectors of {width} entries can't be cut into {parts} equal parts")
    if width * (most - least) ** 2 >= 1 << 53:
        raise ValueError(f"entries from {least} to {most} are too far apart for distances that doubles hold exactly")
    first = np.array([r["x"] for r in vectors.orderBy(F.asc_nulls_last("id"), "x").limit(entries).collect()], "int64")
    books = first.reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums, counts = _sums(vectors, books)
        used = counts > 0
        books[used] = sums[used] // counts[used][:, None]
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in order."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256), a row for each vector.

    Vectors are whole numbers floor(1024 * entry), cut into ``parts`` equal parts; a code names each part's nearest
    entry, two hex digits each, and error adds up their squared distances. label_error is the error of all rows with
    the same label, nulls together.

    Null and empty vectors, and those with a null or non-finite entry, are dropped; vectors of different lengths,
    and entries too far apart for exact distances, are refused. Null ids and repeated rows keep their rows, nearest
    entries at equal distance give the lower index, an empty table an empty result. Other columns are not read.
    """
    if entries > 256:
        raise ValueError("a code's two hex digits name 256 entries at most")
    spark = rows.sparkSession
    vectors = settle(integer_vectors(rows, vec_col, F.col(id_col).alias("id"), F.col(label_col).alias("label")), "code-vectors")
    schema = f"id {rows.schema[id_col].dataType.simpleString()}, label {rows.schema[label_col].dataType.simpleString()}, code string, error long"
    books = fit(vectors, parts, entries, rounds)
    if books is None:
        return spark.createDataFrame([], f"{schema}, label_error long, codebooks_sha256 string").withColumnsRenamed({"id": id_col, "label": label_col})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([f"{i:02x}" for i in range(256)], dtype=object)
        for batch in batches:
            index, distance = _assign(matrix(batch.column(2), parts * books.shape[2]), books)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names[index].sum(1), pa.string()), pa.array(distance.sum(1))], names=["id", "label", "code", "error"])

    coded = settle(vectors.select("id", "label", "x").mapInArrow(encode, schema), "code-rows")
    # A label is found by its text, null by none: equal labels meet, and nulls do.
    named = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    errors = settle(coded.groupBy(named.alias("named")).agg(F.sum("error").alias("label_error")), "code-errors")
    out = join_checked(coded.withColumn("named", named), errors, "named", "inner")
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
