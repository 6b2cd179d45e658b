"""A fitted intent classifier: naive Bayes over the words of a text, counted and applied in Spark.

A feature's weight for a class is log((n + 1) / (e + 1)): in how many of the class's rows it is, against how many the class's
share of all features lets expect. A rare feature says little, and a small class is not held to lack what it is too small to show.
Features that deviate from what is expected by less than some standard deviations are noise, of which a long text holds much, and
have no weight.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.settled import settle

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to so many features the weights are broadcast (some 100 bytes each for three classes); beyond it they are joined by shuffle.
BROADCAST_FEATURES = 200_000
OTHER = "other"
#: Standard deviations by which a feature must differ from what is expected, in one class at least.
DEVIATION = 5.0


@dataclass(frozen=True)
class IntentModel:
    """weights (feature, w): an array of one number for each class; of each class its log prior."""

    weights: DataFrame
    features: int
    classes: tuple[str, ...]
    prior: tuple[float, ...]


def features(text: Column) -> Column:
    """Distinct words, and the pairs of characters (after #) of those that are not plain ASCII, so that scripts without blanks have features too."""
    words = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), F.lit(0))
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.concat(F.lit("#"), F.substr(w, i, F.lit(2))))
    distinct = F.array_distinct(words)
    return F.array_distinct(F.concat(distinct, F.flatten(F.transform(F.filter(distinct, lambda w: w.rlike(r"[^\x00-\x7F]")), pairs))))


def fit(rows: DataFrame, text_col: str, label_col: str, classes: tuple[str, ...], deviation: float = DEVIATION) -> IntentModel:
    """The model of ``rows`` labelled by ``classes``; rows of other or no labels are left out, repeated ones count each.

    Every row and feature counts; what reaches the driver is two numbers a class. Without rows no feature is known.
    A ``deviation`` of 0 keeps all features, as suits a few dozen rows.
    """
    known = rows.where(F.col(label_col).isin(*classes)).select(F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    of = lambda c: F.sum(F.when(F.col("label") == c, 1).otherwise(0))
    counts = settle(known.select("label", F.explode(features(F.col("text"))).alias("feature")).groupBy("feature").agg(*[of(c).alias(f"n{i}") for i, c in enumerate(classes)]), "intent-counts")
    total = counts.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(len(classes))]).first()
    docs = known.agg(*[F.coalesce(of(c), F.lit(0)) for c in classes]).first()
    share = [n / max(1, sum(total)) for n in total]
    every = sum((F.col(f"n{i}") for i in range(len(classes))), F.lit(0))
    far = [(F.col(f"n{i}") - every * x) * (F.col(f"n{i}") - every * x) >= deviation**2 * every * x for i, x in enumerate(share)]
    kept = counts.where(F.greatest(*far, F.lit(False)))
    weights = kept.select("feature", F.array(*[F.log1p(f"n{i}") - F.log1p(every * x) for i, x in enumerate(share)]).alias("w"))
    prior = tuple(math.log((n + 1) / (sum(docs) + len(classes))) for n in docs)
    return IntentModel(weights, weights.count(), classes, prior)


def classify(rows: DataFrame, id_col: str, text_col: str, model: IntentModel) -> DataFrame:
    """(id, found): a struct of the likeliest class and its posterior, as intent_gate takes it, for each distinct (id, text).

    All rows are judged, in whatever language; one without a known feature, null and empty texts among them, is "other" with
    nothing. Of equal classes the one named first is taken. With weights beyond the broadcast a frequent word is one key of
    many rows, which the adaptive skew join splits.
    """
    # One null beside a row's features: it keeps rows without any, and counts how often equal rows repeat, so texts need no exchange.
    marked = F.concat(F.array(F.lit(None).cast("string")), features(F.col(text_col)))
    each = rows.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(text_col, F.lit("")))).alias("key"), F.explode(marked).alias("feature"))
    weights = F.broadcast(model.weights) if model.features <= BROADCAST_FEATURES else model.weights
    found = each.join(weights, "feature", "left").groupBy("id", "key").agg(F.count("w").alias("m"), F.count(F.when(F.col("feature").isNull(), 1)).alias("n"), *[F.sum(F.get("w", F.lit(i))).alias(f"s{i}") for i in range(len(model.classes))])
    scores = F.array(*[F.struct((F.col(f"s{i}") / F.col("n") + p).alias("score"), F.lit(-i).alias("first"), F.lit(c).alias("intent")) for i, (c, p) in enumerate(zip(model.classes, model.prior))])
    best = F.array_max(scores)
    share = 1 / F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x["score"] - best["score"]))
    none = F.col("m") == 0
    return found.select(F.col("id").alias(id_col), F.struct(F.when(none, OTHER).otherwise(best["intent"]).alias("intent"), F.when(none, 0.0).otherwise(share).alias("confidence")).alias("found"))
