"""A mixture whose leaves give their budgets to the token."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice((0, 1, 5, 40, 900)), rng.choice(("en", "de", None)), f"src{rng.randrange(9)}", 0) for i in range(400)]
    rows += [(1000, None, "en", "src1", 0), (1001, "v " * 50_000, "en", "src1", 0), (7, rows[7][1], *rows[7][2:]), (None, "a b c", "de", "src2", 0)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.mark.parametrize("bucket, share", [(4096, 0.5), (2, 0.1), (2, 0.9)])
def test_budget_is_delivered(docs, monkeypatch, bucket, share):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    cut = mixing.mix(docs, share=share, max_epochs=1, cut=True)
    whole = mixing.mix(docs, share=share, max_epochs=1)
    tokens = docs.select(F.sum(mixing.word_count())).first()[0]
    got = cut.agg(F.sum("taken")).first()[0]
    assert got <= int(tokens * share) and got >= 0.99 * int(tokens * share)
    assert cut.where("taken < 0 OR taken > n_tokens").count() == 0
    # One document of a leaf at most is cut; the others are those of the plain mixture.
    parts = cut.where("taken < n_tokens")
    assert parts.groupBy(*mixing.LEVELS).count().where("count > 1").count() == 0
    uncut = cut.where("taken = n_tokens").select(whole.columns)
    assert uncut.exceptAll(whole).where("n_tokens > 0").count() <= parts.count() + uncut.count() - whole.count()
    assert whole.exceptAll(uncut).count() == 0


def test_nothing_to_mix(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS), cut=True).count() == 0
