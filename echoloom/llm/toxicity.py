"""Toxicity: cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import alnum_words, join_checked, settle, unclashed

#: Feature slots: words are hashed into so many.
SLOTS = 1 << 20
#: The model is fitted on at most so many labelled rows, those with the smallest hash of their id.
SAMPLE = 10_000
#: Slots that enter the model: in at least so many sampled texts, and so many deviations more or less often in toxic
#: ones than by chance. All of them do.
SEEN, DEVIATION = 4, 5.0
#: A document is toxic from this probability of grade 1 or more on.
CUT = 0.5


@dataclass
class OrdinalModel:
    """P(grade <= j) = sigmoid(cuts[j] - weights . x): one weight for each slot, shared by all rising cuts."""

    slots: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(SLOTS, "float32")
        out[self.slots] = self.weights
        return out


#: Lengths of the word beginnings that are features beside the words: inflected forms share them.
STEMS = (4, 5)


def features(text: Column) -> Column:
    """The slots of a text's distinct words (A-Z lower-cased) and of their beginnings, each once: presence features."""
    slot = lambda *key: F.pmod(F.xxhash64(*key), F.lit(SLOTS)).cast("int")
    words = F.array_distinct(alnum_words(text))
    parts = F.transform(words, lambda w: F.array(slot(w), *[slot(F.lit(n), F.substring(w, 1, n)) for n in STEMS]))
    return F.array_distinct(F.flatten(parts))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(offsets: np.ndarray, flat: np.ndarray, grades: np.ndarray, rounds: int = 300, decay: float = 3e-4) -> OrdinalModel:
    """Full-batch Adam on the mean negative log-likelihood with weight decay. ``flat[offsets[i]:offsets[i + 1]]``: row i's slots.

    ``grades``: 0 not toxic, 1 and more toxic, rising with severity. Grades that no row has are left out, so the
    model has a cut below each grade that occurs (with 0 and 1 alone it is a logistic regression).
    """
    grades = np.asarray(grades, "int64")
    n, toxic = len(grades), grades > 0
    if not toxic.any():
        return OrdinalModel(np.zeros(0, "int64"), np.zeros(0), np.full(1, 30.0))
    grades = np.searchsorted(np.unique(np.concatenate([[0], grades])), grades)
    rows = np.repeat(np.arange(n, dtype="int32"), np.diff(offsets))
    seen, with_toxic = np.bincount(flat, minlength=SLOTS), np.bincount(flat, weights=toxic[rows].astype(float), minlength=SLOTS)
    rate = toxic.mean()
    score = np.where(seen >= SEEN, (with_toxic - seen * rate) / np.sqrt(seen * rate * (1 - rate) + 1e-9), 0)
    slots = np.flatnonzero(np.abs(score) >= DEVIATION)
    place = np.full(SLOTS, -1, "int32")
    place[slots] = np.arange(len(slots))
    top = int(grades.max())
    held = place[flat] >= 0
    rows, cols = rows[held], place[flat][held]
    w, cuts = np.zeros(len(slots)), np.array([np.log((grades <= j).mean() / max((grades > j).mean(), 1e-6)) for j in range(top)])
    # Rising cuts: the first one, then logarithms of the steps.
    theta = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])
    m, v = np.zeros(len(w) + top), np.zeros(len(w) + top)
    for step in range(1, rounds + 1):
        cuts = np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))
        s = np.bincount(rows, weights=w[cols], minlength=n)
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        up, low = _sigmoid(np.clip(edge[grades + 1] - s, -35, 35)), _sigmoid(np.clip(edge[grades] - s, -35, 35))
        up, low = np.where(grades == top, 1.0, up), np.where(grades == 0, 0.0, low)
        p = np.maximum(up - low, 1e-12)
        du, dl = up * (1 - up) / p, low * (1 - low) / p
        ds = (du - dl) / n
        g_w = np.bincount(cols, weights=ds[rows], minlength=len(w)) + decay * w
        g_c = np.array([(-du[grades == j].sum() + dl[grades == j + 1].sum()) / n for j in range(top)])
        g_t = np.concatenate([[g_c.sum()], [g_c[j:].sum() * np.exp(theta[j]) for j in range(1, top)]])
        g = np.concatenate([g_w, g_t])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, theta = w - move[: len(w)], theta - move[len(w) :]
    return OrdinalModel(slots, w, np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])])))


def severity_grade() -> Column:
    low = F.coalesce(F.col("quality").cast("int") == 0, F.lit(False))
    return F.when(F.col("toxic").cast("int") > 0, F.when(low, 2).otherwise(1)).when(F.col("toxic").isNotNull(), 0)


def only(slots: Column, kept: DataFrame) -> Column:
    """Those of a row's ``slots`` that are in the settled table ``kept`` (slot), filtered where the row is. The driver gets at most SLOTS numbers."""
    mask = np.zeros(SLOTS, bool)
    mask[[r["slot"] for r in kept.toLocalIterator()]] = True
    mask = kept.sparkSession.sparkContext.broadcast(mask)

    @arrow_udf("array<int>")
    def held(slots: pa.Array) -> pa.Array:
        flat = slots.flatten().to_numpy()
        hit = mask.value[flat]
        ends = np.concatenate([[0], np.cumsum(hit)])[slots.offsets.to_numpy() - slots.offsets[0].as_py()]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[hit], pa.int32()))

    return held(slots)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", grade: Column | None = None) -> OrdinalModel:
    """Fit on at most ``sample`` labelled rows; the driver gets the kept weights.

    Slots are counted by Spark, and those that deviate enough go to the one task that fits the model: of a text, however
    long, it gets the kept slots that occur in it.

    The severity grade of a label is ``grade``: as labels say no more of severity than toxic and quality, it is 0
    where toxic is 0, 1 where it is 1, and 2 where the toxic text is of low quality (0) too. Labels with null id or
    null grade, and those without a document, are left out. Without any toxic label the model finds nothing toxic.
    """
    grade = severity_grade() if grade is None else grade
    chosen = labels.select(F.col(id_col).alias("id"), grade.cast("int").alias("grade")).where("id IS NOT NULL AND grade IS NOT NULL").orderBy(F.xxhash64("id"), "id", "grade").limit(sample)
    chosen = settle(chosen, "label-sample")
    rows = join_checked(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), chosen, "id", "inner").select("id", features(F.col("text")).alias("slots"), "grade")
    # Repeated ids could bring more rows than labels were chosen.
    rows = settle(rows, "label-rows").orderBy(F.xxhash64("id"), "id", F.xxhash64("slots"), "grade").limit(sample)
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()), "label-chosen")
    n, toxic = rows.agg(F.count(F.lit(1)), F.count_if(F.col("grade") > 0)).first()
    rate = toxic / n if n else 0.0
    each = rows.select("row", (F.col("grade") > 0).alias("toxic"), F.explode("slots").alias("slot"))
    seen = each.groupBy("slot").agg(F.count(F.lit(1)).alias("seen"), F.count_if("toxic").alias("with"))
    deviation = (F.col("with") - F.col("seen") * rate) / F.sqrt(F.col("seen") * (rate * (1 - rate)) + 1e-9)
    # A hair less than the bound here, as fit() applies it once more.
    kept = settle(seen.where((F.col("seen") >= SEEN) & (F.abs(deviation) >= DEVIATION * (1 - 1e-9))).select("slot"), "label-slots")
    rows = rows.select("row", F.array_sort(only(F.col("slots"), kept)).alias("slots"), "grade")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, flat, grades = [np.zeros(1, "int64")], [np.zeros(0, "int32")], []
        for b in batches:
            lists = b.column(1)
            sizes.append(np.diff(lists.offsets.to_numpy()))
            flat.append(lists.flatten().to_numpy())
            grades += b.column(2).to_pylist()
        model = fit(np.cumsum(np.concatenate(sizes)), np.concatenate(flat), np.array(grades, "int64"))
        names = [*model.slots.tolist(), *range(-1, -1 - len(model.cuts), -1)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([*model.weights.tolist(), *model.cuts.tolist()], pa.float64())], names=["slot", "weight"])

    found = {r["slot"]: r["weight"] for r in rows.repartition(1).sortWithinPartitions("row").mapInArrow(run, "slot long, weight double").collect()}
    slots = sorted(k for k in found if k >= 0)
    return OrdinalModel(np.array(slots, "int64"), np.array([found[k] for k in slots]), np.array([found[k] for k in sorted((k for k in found if k < 0), reverse=True)]))


def score(docs: DataFrame, model: OrdinalModel, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """``docs`` with severity int (the highest grade reached with probability ``cut``), expected_severity and toxic boolean.

    expected_severity is the sum over grades of the probability to reach them. Null and empty texts have no
    features and get the model's base rate. Each row is scored by itself, in its own task. A table that already has
    one of the three columns is refused.
    """
    unclashed(docs, "severity", "expected_severity", "toxic")
    weights, cuts = docs.sparkSession.sparkContext.broadcast(model.dense()), model.cuts

    @arrow_udf("array<double>")
    def reach(slots: pa.Array) -> pa.Array:
        offsets, flat = slots.offsets.to_numpy(), slots.values.to_numpy()
        sums = np.concatenate([[0.0], np.cumsum(weights.value[flat], dtype="float64")])
        s = sums[offsets[1:]] - sums[offsets[:-1]]
        p = 1 - _sigmoid(cuts[None, :] - s[:, None])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype="int32") * len(cuts)), pa.array(p.ravel()))

    scored = docs.withColumn("_el_reach", reach(features(F.col(text_col))))
    p = F.col("_el_reach")
    return scored.withColumns(
        {
            "severity": F.size(F.filter(p, lambda x: x >= cut)),
            "expected_severity": F.aggregate(p, F.lit(0.0), lambda a, x: a + x),
            "toxic": F.get(p, F.lit(0)) >= cut,
        }
    ).drop("_el_reach")
