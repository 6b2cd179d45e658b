"""Small tables with what real ones hold: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, key string, pos int, words string, id string, n string"


def corpus(seed: int = 1, n: int = 60) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "Is", "été", "STRASSE", "straße", "blue", "red", "stone", "river", "K9", "x-ray", "cc", "by", "nc", *(f"w{i}" for i in range(40))]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = prose(70)
    rows: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two"), (5, None), (6, "")]
    texts: list[str] = []
    for i in range(7, n):
        kind = i % 6
        if kind == 0 and texts:
            text = rng.choice(texts)
        elif kind == 1 and texts:
            words = rng.choice(texts).split(" ")
            words[rng.randrange(len(words))] = "edited"
            text = " ".join(words)
        elif kind == 2:
            text = prose(20) + "\n" + passage + "\n" + prose(15)
        else:
            text = "\n".join(prose(rng.randrange(4, 30)) for _ in range(rng.randrange(1, 6)))
        texts.append(text)
        rows.append((i, text))
    rows.append((n, "\n".join([prose(9)] * 12 + [prose(800)])))
    rows.append(rows[10])
    return rows


def docs(spark, rows):
    """Extra columns have names that operators use for themselves."""
    return spark.createDataFrame([(i, t, "k", 1, "w", "i", "n") for i, t in rows], SCHEMA)


def ascii_lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def alnum(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def solid(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
