"""License scan: phrases, and an exact set-similarity join of text blocks with license notices."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_words, at, join_checked, settle

#: Phrase and label of the base scan.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Opening sentences of public license notices and the label of each.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license to view a copy of this license visit"),
    ("cc0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
)
#: A block meets a template with at least this share of the template's distinct words, in percent.
CONTAINMENT = 80
#: Blocks of twice this many words begin every so many words, so every run of up to this many lies in one block.
STRIDE = 64


def _phrase_places(words: Column, phrase: str) -> Column:
    parts = phrase.split(" ")
    here = lambda i: [at(words, i + j) == F.lit(p) for j, p in enumerate(parts)]

    def matches(i: Column) -> Column:
        first, *rest = here(i)
        for x in rest:
            first = first & x
        return first

    places = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), matches)
    # The joined text is searched first: few documents hold the phrase.
    held = (F.size(words) >= len(parts)) & F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).contains(f" {phrase} ")
    return F.when(held, places).otherwise(F.array().cast("array<int>"))


def _blocks(words: Column, stride: int) -> Column:
    """Overlapping blocks over all words; a text without words has one empty block."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - stride - 1, F.lit(0)), F.lit(stride))
    return F.transform(starts, lambda s: F.slice(words, s + 1, 2 * stride))


def token_order(base: DataFrame, tokens: list[str]) -> list[str]:
    """``tokens`` by the number of blocks that hold them, rarest first, ties by spelling.

    Counted over all rows; what reaches the driver is one count for each of the (fixed, few) template words.
    """
    held = base.select(F.explode(F.flatten("blocks")).alias("token"))
    counts = dict(map(tuple, held.groupBy("token").count().collect()))
    return sorted(tokens, key=lambda t: (counts.get(t, 0), t))


def prefix_index(spark: SparkSession, templates, order: list[str], percent: int) -> tuple[DataFrame, DataFrame]:
    """(token, template, place) of the templates' prefixes, and (template, label, n, need, words, prefix); both settled.

    Words stand in the global order, rarest first. A template of n words needs k = ceil(n * percent / 100) of them, so
    a block that meets it shares one of its first n - k + 1 words: those are its prefix.
    """
    rank = {t: i for i, t in enumerate(order)}
    rows = []
    for i, (label, text) in enumerate(templates):
        words = sorted(set(text.split(" ")), key=rank.__getitem__)
        need = ceil(len(words) * percent / 100)
        rows.append((i, label, len(words), need, words, words[: len(words) - need + 1]))
    table = settle(spark.createDataFrame(rows, "template int, label string, n int, need int, words array<string>, prefix array<string>"), "license-templates")
    index = table.select("template", F.posexplode("prefix").alias("place", "token"))
    return settle(index, "license-prefixes"), table


def block_matches(blocks: DataFrame, index: DataFrame, table: DataFrame, shortest: int) -> DataFrame:
    """(row, i, label, share): blocks (row, i, words in the global order) joined with the templates they meet.

    The join is on words of both prefixes. Of each pair the first shared word alone goes on (prefix filter), if the
    block has as many words as the template needs (length filter) and from that word on both still have enough left
    (positional filter). Survivors are counted exactly.
    """
    head = F.slice("words", 1, F.size("words") - shortest + 1)
    tokens = blocks.where(F.size("words") >= shortest).select("row", "i", "words", F.posexplode(head).alias("at", "token"))
    pairs = join_checked(tokens, index, "token", "inner").withColumnRenamed("words", "block")
    pairs = join_checked(pairs, table, "template", "inner").where((F.size("block") >= F.col("need")) & (F.least(F.size("block") - F.col("at"), F.col("n") - F.col("place")) >= F.col("need")))
    own = F.slice("block", 1, F.size("block") - F.col("need") + 1)
    pairs = pairs.where(F.get(F.array_intersect(own, "prefix"), F.lit(0)) == F.col("token"))
    shared = F.size(F.array_intersect("words", "block"))
    return pairs.where(shared >= F.col("need")).select("row", "i", "label", (shared / F.col("n")).alias("share"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, percent: int = CONTAINMENT, stride: int = STRIDE) -> DataFrame:
    """Licenses named in each text, a row for each row of ``docs``.

    n_base, first_word, last_word and base_labels are of the phrases: places where their words stand
    consecutively, counted over all phrases, and the smallest and largest start. labels adds those of the
    templates of which some block of 2 * ``stride`` words holds ``percent`` of the distinct words. score is 1 with
    a phrase, else the largest such share, else 0. matches lists (block, label, share).

    Null text is empty: no words, no labels, score 0. Repeated rows each get a row, ties among labels are sorted,
    an empty table gives an empty result, and other columns are not read. ``templates`` are (label, text) pairs or a
    table of them, matched by a join; what reaches the driver are they and a count for each of their words.
    ``phrases`` are part of the plan.
    """
    if isinstance(templates, DataFrame):
        templates = [tuple(t) for t in templates.select("label", "text").orderBy("label", "text").collect()]
    worded = docs.select(F.col(id_col), alnum_words(F.col(text_col)).alias("words"))
    tokens = sorted({w for _, t in templates for w in t.split(" ")})
    known = F.array(*map(F.lit, tokens)) if tokens else F.array().cast("array<string>")
    base = worded.select(
        id_col,
        F.size("words").cast("long").alias("n_words"),
        *[_phrase_places(F.col("words"), p).alias(f"p{i}") for i, (p, _) in enumerate(phrases)],
        # Words of no template cannot count towards one, so blocks keep the others alone: a small table.
        F.transform(_blocks(F.col("words"), stride), lambda b: F.array_intersect(known, b)).alias("blocks"),
    )
    # Numbers are fixed by being written, so repeated rows have their own.
    base = settle(base.withColumn("row", F.monotonically_increasing_id()), "license-blocks")
    order = token_order(base, tokens)
    ordered = F.array(*map(F.lit, order)) if order else F.array().cast("array<string>")
    shortest = min((ceil(len(set(t.split(" "))) * percent / 100) for _, t in templates), default=1)
    blocks = base.select("row", F.posexplode("blocks").alias("i", "words")).where(F.size("words") >= shortest).withColumn("words", F.array_intersect(ordered, "words"))
    index, table = prefix_index(docs.sparkSession, templates, order, percent)
    found = block_matches(blocks, index, table, shortest).groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("i").alias("block"), "label", "share"))).alias("matches"))
    found = settle(found, "license-matches")
    places = F.concat(*[F.col(f"p{i}") for i in range(len(phrases))])
    named = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)]))
    base = join_checked(base.drop("blocks"), found, "row", "left")
    none = F.array().cast("array<struct<block:int,label:string,share:double>>")
    out = base.select(id_col, "n_words", places.alias("places"), F.array_sort(F.array_distinct(named)).alias("named"), F.coalesce("matches", none).alias("matches"))
    return out.select(
        id_col,
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("named", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("named", "matches.label"))), ",").alias("labels"),
        F.when(F.size("named") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("matches.share"), F.lit(0.0))).alias("score"),
        "matches",
    )
