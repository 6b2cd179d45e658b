"""What the operators on embeddings share: cleaned integer vectors and their shape."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries become floor(SCALE * entry).
SCALE = 1024


def integer_vectors(rows: DataFrame, vec_col: str, *keep: Column, shift: int = 0) -> DataFrame:
    """``keep`` and x, the vector as whole numbers floor(1024 * entry) + ``shift``.

    Rows without a vector (null or empty), or with a null, infinite or NaN entry in it, are dropped.
    """
    vec = F.col(vec_col)
    odd = F.exists(vec, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    whole = F.transform(vec, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + shift)
    return rows.where(vec.isNotNull() & (F.size(vec) > 0) & ~odd).select(*keep, whole.alias("x"))


def shape(vectors: DataFrame) -> tuple[int, int, int, int]:
    """(rows, length of the vectors, smallest entry, largest entry). Vectors of different lengths are refused."""
    n, low, high, least, most = vectors.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x")), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    if low != high:
        raise ValueError(f"vectors have {low} to {high} entries: only vectors of one length can be compared")
    return n, low or 0, least or 0, most or 0


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """An Arrow column of vectors as a matrix of 64-bit whole numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
