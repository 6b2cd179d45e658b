"""Settled tables that later settled tables replace leave the shared folder: what stays is what the result reads."""

import os

from echoloom.llm.common import shared_dir
from echoloom.llm.suffix_dedup import suffix_dedup

from .helpers import corpus, docs


def test_only_the_spans_stay(spark):
    before = set(os.listdir(shared_dir(spark))) if os.path.isdir(shared_dir(spark)) else set()
    out = suffix_dedup(docs(spark, corpus(5)), length=40, gram=8)
    left = sorted(x.rpartition("-")[0] for x in set(os.listdir(shared_dir(spark))) - before)
    assert left == ["suffix-covered"]
    assert out.where("n_removed > 0").count() > 0
