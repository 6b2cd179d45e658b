"""Embedding whitening: principal directions by MLlib's SVD of centred distributed rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .whole_vectors import integer_vectors, matrix, shape

#: Added to each whole number.
SHIFT = 100_000
COMPONENTS = 8
#: A direction with a smaller share of the largest variance holds rounding errors only, and is no component.
LEAST_SHARE = 1e-10

WHITE = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """A fitted transformation: rows, sums by dimension, the range of entries, directions by column and their variances."""

    n: int
    sums: list[int]
    span: int
    directions: np.ndarray
    variances: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates, a column for each component."""
        return (x - self.mean) @ (self.directions / np.sqrt(self.variances))

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S)^2, exact: in 64 bits where they hold it, else in Python's whole numbers."""
        if x.shape[1] * (self.n * max(1, self.span)) ** 2 >= 1 << 63:
            x = x.astype(object)
        return ((x * self.n - np.array(self.sums, dtype=x.dtype)) ** 2).sum(1).tolist()


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a settled table of vectors x; None without rows.

    MLlib adds up the Gramian of the centred rows, a square of the vectors' length, over all tasks and decomposes it
    on the driver; all singular values are asked for, as MLlib iterates to a tolerance for few of them. A singular
    value s of centred rows is a variance of s^2 / n.
    """
    n, width, least, most = shape(vectors)
    if not n:
        return None
    totals = vectors.select(F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("total")).collect()
    sums = [t for _, t in sorted((r["pos"], r["total"]) for r in totals)]
    mean = F.array(*[F.lit(s / n) for s in sums])
    centred = vectors.select(array_to_vector(F.zip_with("x", mean, lambda a, b: a - b)).alias("centred"))
    found = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "centred"), n, width).computeSVD(width)
    variances = found.s.toArray() ** 2 / n
    kept = min(components, int((variances > LEAST_SHARE * variances[0]).sum())) if len(variances) else 0
    return Whitening(n, sums, most - least, found.V.toArray()[:, :kept], variances[:kept])


def _totals(vectors: DataFrame, model: Whitening, mean: np.ndarray | None) -> dict[int, tuple[float, int]]:
    """Sums over all rows: whitened coordinates and exact deviations, or with ``mean`` the products of centred coordinates."""
    k, width = len(model.variances), len(model.sums)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, exact, any_row = np.zeros(k if mean is None else k * k), 0, False
        for batch in batches:
            x = matrix(batch.column(0), width)
            white, any_row = model.project(x), True
            if mean is None:
                values += white.sum(0)
                exact += sum(model.deviations(x))
            else:
                values += ((white - mean).T @ (white - mean)).ravel()
        if any_row:  # one row for each sum and task; the exact one has place -1
            yield pa.RecordBatch.from_arrays(
                [pa.array([*range(len(values)), -1], pa.int32()), pa.array([*values, 0.0]), pa.array([*[0] * len(values), exact], pa.decimal128(38, 0))], names=["place", "value", "exact"]
            )

    parts = vectors.select("x").mapInArrow(partial, "place int, value double, exact decimal(38,0)")
    return {r["place"]: (r["value"], int(r["exact"])) for r in parts.groupBy("place").agg(F.sum("value").alias("value"), F.sum("exact").cast("decimal(38,0)").alias("exact")).collect()}


def whitened(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component.

    Vectors are whole numbers x = floor(1024 * entry) + SHIFT, n of them with sums S. deviation is the sum over
    dimensions of (n * x - S)^2, exact; its total over n^3 is the total variance, against which ``explained`` holds
    a component's variance. ``whitened`` is x - S / n along the component over the square root of its variance;
    identity_error the largest entry of (covariance of whitened - identity) over all rows, centred first.

    Null and empty vectors, and those with a null or non-finite entry, are dropped; vectors of different lengths
    are refused. Directions without variance are no components, so copies of one vector, or an empty table, give no
    rows, and n rows at most n - 1 components. Null ids and repeated rows each keep their rows. Other columns are not
    read. To the driver go sums by dimension and, from MLlib, a square matrix of the vectors' length.
    """
    spark = rows.sparkSession
    vectors = settle(integer_vectors(rows, vec_col, F.col(id_col).alias("id"), shift=SHIFT), "whiten-vectors")
    schema = f"{id_col} {rows.schema[id_col].dataType.simpleString()}, {WHITE}"
    model = fit(vectors, components)
    if model is None or not len(model.variances):
        return spark.createDataFrame([], schema)
    k, width = len(model.variances), len(model.sums)
    sums = _totals(vectors, model, None)
    trace = float(Fraction(sums[-1][1], model.n**3))
    centre = np.array([sums[i][0] / model.n for i in range(k)])
    products = _totals(vectors, model, centre)
    covariance = np.array([products[i][0] / model.n for i in range(k * k)]).reshape(k, k)
    error, explained = float(np.abs(covariance - np.eye(k)).max()), model.variances / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), width)
            each, m = np.repeat(np.arange(len(x)), k), len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)),
                    pa.array(model.deviations(x), pa.decimal128(38, 0)).take(pa.array(each)),
                    pa.array(model.project(x).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.select("id", "x").mapInArrow(project, schema)
