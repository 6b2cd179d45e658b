"""Draws under a share of the limits: what is left open is drawn once more, and nothing else changes."""

from pyspark.sql import functions as F

from echoloom.llm.fingerprint import MISSED, candidates, edited_fingerprints, samples, weighted_words

from .helpers import corpus, docs


def test_open_draws_are_drawn_again(spark):
    rows = [*corpus(5)[:25], (900, "tick " * 300 + "tock"), (901, " ".join(f"w{i}" for i in range(400)))]
    whole = sorted(map(tuple, edited_fingerprints(docs(spark, rows), count=16, share=1.0).collect()), key=repr)
    for share in (0.01, 0.05):
        assert sorted(map(tuple, edited_fingerprints(docs(spark, rows), count=16, share=share).collect()), key=repr) == whole


def test_share_of_the_limits(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(400))), (2, " "), (3, None)], "row int, text string")
    words = weighted_words(df, {"text": "weight"}, ["row"])
    rows = candidates(words, ["row"], {"weight": "fingerprint"}, 64, 0.1).where(F.col("a0").isNotNull())
    assert 0.7 * 0.1 * MISSED < rows.count() / 64 < 1.3 * 0.1 * MISSED
    prints = {s: {r["row"]: r["fingerprint"] for r in samples(words, ["row"], {"weight": "fingerprint"}, 64, s).collect()} for s in (1.0, 0.025)}
    part, full = prints[0.025][1], prints[1.0][1]
    assert None in part and None not in full
    assert all(x in (None, y) for x, y in zip(part, full, strict=True))
    # Texts without words draw nothing, and are not open.
    assert prints[0.025][2] == prints[0.025][3] == prints[1.0][2] == [-(1 << 15)] * 64


def test_limits_of_two_texts(spark):
    """A term under the limit of the short text alone does not close a draw of the long one."""
    text, edited = " ".join(f"w{i}" for i in range(20)), " ".join(f"w{i}" for i in range(10, 400))
    words = weighted_words(spark.createDataFrame([(1, text, edited)], "row int, text string, edited string"), {"text": "weight", "edited": "edited_weight"}, ["row"])
    part, full = (samples(words, ["row"], {"weight": "one", "edited_weight": "two"}, 256, s).first() for s in (0.05, 1.0))
    for name in ("one", "two"):
        assert None in part[name] and all(x in (None, y) for x, y in zip(part[name], full[name], strict=True))
