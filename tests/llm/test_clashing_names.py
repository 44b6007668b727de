"""Columns of the input named like columns that the operators use themselves."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import exact_dedup, license_scan, line_dedup, mixing, ngram_join, passages, phrases, toxicity, url_filter

NAMES = ["_key", "_row", "_n", "_at", "gone", "_doc", "_grams", "_features", "_raw", "_chance", "_class", "_ruled", "own", "key", "row",
         "doc", "n", "at", "row_key", "id", "digest", "text_sha256", "kept", "copies", "epoch", "bucket", "_url", "_vector", "_score"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["one two three four five six", "one  two three\nfour five six", "alpha beta\ngamma delta", None, "", "alpha beta\nother words here now", "x y z"]
    rows = [(i % 9, t, "en", f"src{i % 3}", 1) for i, t in enumerate(texts * 2)]
    return spark.createDataFrame(rows, DOCS).select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in NAMES])


def values_are_whole(out):
    """Every clashing column still holds what it was given, beside its row's id."""
    rows = out.collect()
    assert rows
    for r in rows:
        for n in NAMES:
            assert r[n] == f"{n}:{r['doc_id']}", n


def test_exact_dedup(docs):
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    values_are_whole(out)


def test_mixed_documents(docs):
    out = mixing.mixed_documents(docs, share=0.6, max_epochs=1)
    assert out.columns == docs.columns
    values_are_whole(out)


def test_remove_repeated_lines(docs):
    for words in (1, 5):
        out = line_dedup.remove_repeated_lines(docs, words=words)
        assert sorted(out.columns) == sorted([*docs.columns, "n_lines", "removed"])
        values_are_whole(out)
    assert line_dedup.remove_repeated_lines(docs.where("false"), words=1).count() == 0


def test_judge_urls(spark, docs):
    pages = docs.withColumn("url", F.lit("https://a.net/x")).withColumn("host", F.lit("mine"))
    out = url_filter.judge_urls(pages)
    values_are_whole(out)
    assert {(r["host"], r["rule"], r["verdict"]) for r in out.collect()} == {("a.net", "net/", "block")}


def test_pipeline_stages(spark, docs, tmp_path):
    spark.createDataFrame([(i, 1, i % 2) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        if name != "toxicity":  # so few rows teach it nothing to rely on
            values_are_whole(out)


def test_operators_that_return_columns_of_their_own(spark, docs):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    same = lambda f: sorted(map(str, f(docs).collect())) == sorted(map(str, f(plain).collect()))
    assert same(exact_dedup.duplicate_groups) and same(ngram_join.similar_documents) and same(license_scan.scan_licenses)
    assert same(lambda d: passages.without_repeats(d, 3)) and same(lambda d: phrases.collocations(d, 2))


def test_repeated_ids_teach_one_text(spark):
    rows = [(1, "b"), (1, "a"), (1, "c"), (2, "z"), (None, "q")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    picks = {tuple(sorted(map(tuple, toxicity.sample_labelled(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), labels).collect()))) for n in (1, 3, 5)}
    assert len(picks) == 1
