"""Repeated lines by words: read again instead of written, frequencies told in part, rows that repeat an id."""

import os
import re

import pyarrow as pa
import pytest

from millrace.llm import line_dedup, ngram_join
from millrace.scratch import scratch_root

ROWS = [
    (1, "one two three four\nnothing alike here\n"), (2, "ONE  two three\tfour \nfive six seven eight\n\n"), (3, "five six seven eight nine"),
    (4, "\nnine ten eleven twelve\nten nine twelve eleven ten"), (5, None), (6, "eleven twelve nine ten more\x0b\n" + "lone " * 3),
]
GONE = {1: [], 2: [0], 3: [0], 4: [2], 5: [], 6: [0]}


def removed(spark, rows):
    got = line_dedup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), words=1)
    return sorted((r.doc_id, r.removed) for r in got.collect())


def test_only_lines_in_pairs_are_written(spark):
    root = scratch_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    assert removed(spark, ROWS) == sorted(GONE.items())
    new = set(os.listdir(root)) - before
    assert not [f for f in new if f.startswith(("llm-ordered", "llm-line-words", "llm-line-sequences"))]
    (tokens,) = [f for f in new if f.startswith("llm-line-tokens")]
    ids = {r.id for r in spark.read.parquet(f"{root}/{tokens}").select("id").collect()}
    assert ids == {(doc << line_dedup.LINE_BITS) + at for doc, at in [(2, 1), (3, 0), (4, 1), (6, 0)]}


@pytest.mark.parametrize("known", [0, 1, 3])
def test_frequencies_told_in_part(spark, monkeypatch, known):
    monkeypatch.setattr(line_dedup, "KNOWN", known)
    assert removed(spark, ROWS) == sorted(GONE.items())


def test_rows_of_one_id_with_other_texts(spark):
    rows = [(1, "a b c d\nx y z w"), (1, "q r s t\nx y z w"), (2, "a b c d e\nq r s t u"), (3, "x y z w"), (5, "x y z w"), (5, "g h i j"), (6, "g h i j k")]
    assert removed(spark, rows) == [(1, []), (1, []), (2, [0, 1]), (3, [0]), (5, [0]), (5, [0]), (6, [0])]


@pytest.mark.parametrize("chunk", [1, 20, 1000])
def test_sets_of_a_batch(monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    texts = ["", "a b\n\nB a a", "\n \nc", None, "d\n", "\x0b\n\t", "a b c D e f g\nb A"]
    found = {}
    for sets in line_dedup._line_sets(pa.array(["skipped", *texts])[1:]):
        keys = list(zip(*sets.keys(), *sets.signs()))
        for i, (text, at, start, n) in enumerate(zip(sets.text.tolist(), sets.at.tolist(), sets.starts.tolist(), sets.n.tolist())):
            found[text, at] = (frozenset(sets.tokens[start : start + n].tolist()), keys[i])
    want = {(i, k): frozenset(re.findall(r"[^\x20\x09-\x0D]+", x.lower())) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n"))}
    want = {k: w for k, w in want.items() if w}
    assert {k: len(w) for k, w in want.items()} == {k: len(s) for k, (s, _) in found.items()}
    for a in want:
        for b in want:
            assert len(want[a] & want[b]) == len(found[a][0] & found[b][0])
            assert (want[a] == want[b]) == (found[a][1] == found[b][1])
