"""Packing: token pieces into training windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

CAPACITY = 2048
#: Remainders are cut to so many tokens, so that a window takes several and differencing can level them.
PIECE = 512
#: Windows that are levelled together; a group falls short of its windows by less than one of them.
GROUP_WINDOWS = 512
END_ID = 1

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of a byte-level BPE file as the ``tokenizers`` library gives them, without special tokens added.

    Texts go through ``tiktoken`` with the same vocabulary and pattern, which gives the same ids six times as
    fast. Texts that hold the spelling of an added token, or characters from U+30000 on (up to which each
    character was tried in both), go through ``tokenizers`` itself.
    """

    _odd = re.compile("[\U00030000-\U0010ffff]")

    def __init__(self, path: str | None = None) -> None:
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path or tokenizer_file())
        vocabulary = self.slow.get_vocab(with_added_tokens=False)
        added = {t.content for t in self.slow.get_added_tokens_decoder().values()}
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in added}
        self.fast = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = re.compile("|".join(map(re.escape, sorted(added)))) if added else None

    def __call__(self, text: str) -> list[int]:
        if self._odd.search(text) or self.special and self.special.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def _byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: itself if it prints, else the next from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = count(0x100)
    return {chr(b if b in prints else next(spare)): b for b in range(256)}


def cut(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: full windows first, then pieces of the rest."""
    full = n // capacity * capacity
    return [(s, capacity) for s in range(0, full, capacity)] + [(s, min(piece, n - s)) for s in range(full, n, piece)]


def difference(sizes: list[int], bins: int) -> list[list[int]]:
    """Karmarkar-Karp for ``bins`` parts: item numbers of each part.

    Keeps partial partitions, each as its non-empty parts by falling sum. The two with the largest difference
    between their largest and smallest part are merged, the largest parts of one with the smallest of the other,
    until one is left. Ties go by the order in which partitions arose, so the result is a function of the input.
    """
    if not sizes:
        return [[] for _ in range(bins)]
    # A part is a node; node i < len(sizes) is item i, later nodes join two.
    joined: list[tuple[int, int]] = []
    n, turn = len(sizes), count()
    heap = []
    for i in sorted(range(n), key=lambda i: -sizes[i]):
        heap.append((-sizes[i] if bins > 1 else 0, next(turn), [(sizes[i], i)]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        spare = bins - len(a)
        if len(b) <= spare:
            parts = a + b
        else:
            # b's smallest parts go to empty places first, its larger ones onto a's smallest.
            over = len(b) - spare
            parts, tail = a[: len(a) - over], a[len(a) - over :]
            moved = sorted(b, reverse=True)
            for (x, i), (y, j) in zip(tail, sorted(moved[spare:] if spare else moved), strict=True):
                joined.append((i, j))
                parts.append((x + y, n + len(joined) - 1))
            parts += moved[:spare]
        parts.sort(reverse=True)
        low = parts[-1][0] if len(parts) == bins else 0
        heapq.heappush(heap, (low - parts[0][0], next(turn), parts))

    def items(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            k = stack.pop()
            if k < n:
                out.append(k)
            else:
                stack += joined[k - n]
        return sorted(out)

    parts = [items(node) for _, node in heap[0][2]]
    return parts + [[] for _ in range(bins - len(parts))]


def level(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Item numbers of as few near-equal windows as differencing finds within ``capacity``."""
    bins = max(1, -(-sum(sizes) // capacity)) if sizes else 0
    while bins:
        parts = difference(sizes, bins)
        if max(sum(sizes[i] for i in p) for p in parts) <= capacity:
            return [p for p in parts if p]
        bins += max(1, bins // 512)
    return []


def pieces_of(batches: Iterator[pa.RecordBatch], capacity: int, piece: int, path: str | None) -> Iterator[pa.RecordBatch]:
    encode, schema = Encoder(path), pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])
    for batch in batches:
        rows: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
            salt = zlib.crc32(ids.tobytes())
            for start, length in cut(len(ids), capacity, piece):
                rows.append((doc, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), salt))
            if len(rows) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, piece: int = PIECE, path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, salt) of each piece; token ids stay in the task that makes them."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda b: pieces_of(b, capacity, piece, path), PIECES)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, piece: int = PIECE, group_windows: int = GROUP_WINDOWS, path: str | None = None) -> DataFrame:
    """Where each token of each document goes: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and END_ID. Whole windows of a long document are sequences of their own; the
    remainders are dealt by hash into groups of about ``group_windows`` windows, and each group is levelled by
    itself, so no task holds more than a group. Null and empty texts are the one token END_ID. Repeated rows are
    packed each. An empty table gives an empty result. Only the two named columns are read.
    """
    pieces = settle(token_pieces(docs, id_col, text_col, capacity, piece, path), "token-pieces")
    total = pieces.where(F.col("length") < capacity).agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / (group_windows * capacity)))
    full = pieces.where(F.col("length") == capacity).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.monotonically_increasing_id() + F.lit(1 << 60)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def levelled(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "salt", "start", "turn")])
        sizes = rows["length"].to_pylist()
        sequence, offset = np.zeros(len(sizes), "int64"), np.zeros(len(sizes), "int64")
        for w, part in enumerate(level(sizes, capacity)):
            filled = 0
            for i in part:
                sequence[i], offset[i] = key[0].as_py() * (1 << 24) + w, filled
                filled += sizes[i]
        return rows.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    # The number of a row in the settled table tells equal rows apart, so copies are dealt out like any others.
    dealt = pieces.withColumn("turn", F.monotonically_increasing_id()).where(F.col("length") < capacity)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "turn"), F.lit(groups)))
    part = dealt.groupBy("part").applyInArrow(levelled, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return full.unionByName(part)
