"""Repeated lines: what is written on the way and no longer read, and how a line's words are told."""

import os

from pyspark.sql import functions as F

from millrace.llm import line_dedup
from millrace.llm.common import SPACES, ascii_lower
from millrace.scratch import scratch_root


def test_sets_and_postings_do_not_stay(spark):
    left = lambda: {f for f in os.listdir(scratch_root(spark).removeprefix("file:")) if f.startswith(("llm-sets", "llm-word-postings"))}
    before = left()
    rows = [(1, "one two three four\nnothing alike here"), (2, "ONE  two three\tfour \nfive six seven eight"), (3, "five six seven eight nine")]
    got = line_dedup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), words=1)
    assert {r.doc_id: r.removed for r in got.collect()} == {1: [], 2: [0], 3: [0]}
    assert left() == before


def test_words_of_a_line_are_told_as_by_the_patterns(spark):
    texts = ["", " ", "\t\x0b\x0c\r ", " A  b\t", " A ", "\x1cX\x1f ", "ÄÉ Ab İI", "ſK K", "\x00A ", "MIXED case", "z  Z"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.regexp_replace(F.regexp_replace(ascii_lower(F.col("text")), f"^{SPACES}|{SPACES}$", ""), SPACES, " ")
    _, digest = line_dedup._sequence()
    assert df.select(digest, F.sha2(plain.cast("binary"), 256).alias("want")).where("h <> want OR h IS NULL").count() == 0
