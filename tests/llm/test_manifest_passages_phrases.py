"""The Merkle manifest, repeated passages and collocations against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import merkle, passages, phrases

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = ("key", "place", "part", "rank", "row", "start", "n", "at", "id", "first", "last", "hash", "norm", "whole", "removed", "copies", "f", "words", "mark", "known", "cut", "score")


def H(*parts):  # noqa: N802
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def coded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


# --- the manifest ------------------------------------------------------------


def tree(hashes, fanout=3):
    """(top, per leaf the (before, after) siblings of each level)"""
    paths, groups = [[] for _ in hashes], [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        above, together = [], []
        for i in range(0, len(hashes), fanout):
            run = hashes[i : i + fanout]
            for j in range(len(run)):
                for leaf in groups[i + j]:
                    paths[leaf].append((run[:j], run[j + 1 :]))
            above.append(H(*run))
            together.append(sum(groups[i : i + fanout], []))
        hashes, groups = above, together
    return hashes[0], paths


def plain_manifest(rows, fanout=3):
    """rows: (doc_id, text, lang, source, n_chars)"""
    sources = defaultdict(list)
    for doc, text, lang, source, n in rows:
        leaf = H(*map(coded, (doc, source, lang, n, text)))
        changed = text.replace("\n", "") if text is not None and doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0 else text
        sources[source].append((doc is not None, doc, leaf, H(*map(coded, (doc, source, lang, n, changed)))))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    done = {s: tree([x[2] for x in sorted(sources[s])], fanout) for s in names}
    root, upper = tree([done[s][0] for s in names], fanout)
    out = []
    for s, above in zip(names, upper):
        for (_, doc, leaf, folded), path in zip(sorted(sources[s]), done[s][1]):
            path = path + above
            for before, after in path:
                folded = H(*before, folded, *after)
            out.append((doc, leaf, done[s][0], root, "".join(x for b, a in path for x in b + a), folded, folded == root))
    return sorted(out, key=str)


def manifest_rows(df, **options):
    return sorted((tuple(r) for r in merkle.manifest(df, **options).collect()), key=str)


def source_rows(sizes, seed=1):
    rng, rows = random.Random(seed), []
    for source, n in sizes.items():
        for _ in range(n):
            text = "\n".join("ab" * rng.randint(0, 4) for _ in range(rng.randint(1, 3)))
            rows.append((len(rows) * 7 % 1009, text, rng.choice(("en", "dé", None)), source, len(text)))
    return rows


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 4}, {"a": 27, "b": 1}, {"a": 28}, {"": 5, None: 1, "é": 82, "z": 30, "y": 2, "x": 3}])
def test_manifest_matches_plain_trees(spark, sizes):
    rows = source_rows(sizes)
    assert manifest_rows(spark.createDataFrame(rows, DOCS).repartition(3)) == plain_manifest(rows)


def test_manifest_with_small_blocks_and_other_fanout(spark):
    rows = source_rows({f"s{i}": 1 + i * i % 23 for i in range(14)} | {"big": 90})
    df = spark.createDataFrame(rows, DOCS)
    for fanout, depth in ((3, 1), (2, 2)):
        assert manifest_rows(df, fanout=fanout, depth=depth, piece=2) == plain_manifest(rows, fanout)


def test_manifest_of_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "", "", "", 0), (5, "a\nb", None, "s", 3), (5, "a\nb", None, "s", 3), (5, "c", None, "s", 1)]
    rows += [(9, "x\n" * 50_000, "en", "s", 100_000), (-4, "é\n", "en", None, 2)]
    assert manifest_rows(spark.createDataFrame(rows, DOCS)) == plain_manifest(rows)
    wide = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(1).alias(c) for c in CLASHING])
    assert manifest_rows(wide) == plain_manifest(rows)


def test_manifest_of_nothing(spark):
    done = merkle.manifest(spark.createDataFrame([], DOCS))
    assert done.count() == 0 and done.columns == ["doc_id", "leaf", "subroot", "root", "siblings", "folded_root", "verified"]


def test_no_key_of_the_climb_is_hot(spark):
    """A node near the top has one row per piece, so its climbers are split."""
    runs = spark.sql("SELECT 7L AS id, array(named_struct('at', 0L, 'id', 1L, 'first', 0L, 'last', 999L, 'hash', 'ab'), named_struct('at', 1L, 'id', 2L, 'first', 1000L, 'last', 1010L, 'hash', 'cd')) AS members")
    pieces = Counter(r["id"] for r in merkle._linked(runs, 100).collect())
    assert pieces == {1: 10, 2: 1}


# --- passages ----------------------------------------------------------------


def plain_passages(rows, window):
    texts = [(doc, WORD.findall(text or "")) for doc, text in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in texts for k in range(len(w) - window + 1))
    out = []
    for doc, w in texts:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def passage_rows():
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice(("Ab", "ab", "c", "dé", "e.", "f\x00")) + str(rng.randrange(30)) for _ in range(n))
    shared = [some(n) for n in (34, 35, 36, 60, 200)]
    rows = [(i, some(rng.randint(0, 60)) + " " + rng.choice(shared) + "\n" + some(rng.randint(0, 60))) for i in range(60)]
    rows += [(100 + i, shared[4]) for i in range(5)]  # copies
    rows += [(200, "\t " + shared[4].replace(" ", "\n\n") + "\r"), (300, None), (301, ""), (302, " \n "), (None, shared[3]), (None, shared[3])]
    rows += [(303, "na " * 500), (304, "na " * 34), (305, "na " * 35), (306, some(30_000)), (7, rows[7][1]), (7, rows[7][1]), (7, "other"), (308, "x" * 100_000)]
    rows += [(400 + i, f"start{i} " + shared[3] + f" mid{i} " + shared[3]) for i in range(4)]  # twice in one text
    return rows


def passages_of(df, window, **sizes):
    done = passages.without_repeats(df, window, **sizes).select("doc_id", "n_words", "n_removed", "kept_text")
    return sorted((tuple(r) for r in done.collect()), key=str)


@pytest.mark.parametrize("window", [35, 5])
def test_passages_match_plain_version(spark, window):
    rows = passage_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert passages_of(df, window, block=700, slice_size=300) == plain_passages(rows, window)


def test_crowded_sketch_loses_nothing(spark, monkeypatch):
    """Cells that many anchors share make more suspects and change no result."""
    monkeypatch.setattr(passages, "LOAD", 0)
    rows = passage_rows()[:70]
    assert passages_of(spark.createDataFrame(rows, "doc_id long, text string"), 35) == plain_passages(rows, 35)


def test_passage_spans_and_clashing_names(spark):
    rows = [(1, "a b c d e"), (2, "x b c d y"), (3, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in CLASHING])
    done = {r["doc_id"]: r for r in passages.without_repeats(df, 3).collect()}
    assert [(s["first"], s["words"]) for s in done[1]["removed"]] == [(1, 3)] and done[3]["removed"] == []
    assert [done[i]["kept_text"] for i in (1, 2, 3)] == ["a e", "x y", "q"]


def test_passages_of_nothing(spark):
    assert passages.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- phrases -----------------------------------------------------------------


def plain_phrases(rows, least, best, longest=5):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i : i + k])] += 1
    frequent = {k: v for k, v in counts.items() if v >= least}
    scored = defaultdict(list)
    for (lang, p), a in frequent.items():
        if len(p) < 2:
            continue
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(x == lang and len(q) > len(p) and v >= a and inside(q) for (x, q), v in frequent.items()):
            continue
        n = totals[lang]
        cuts = [(1000 * a * n // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        scored[lang].append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]], n))
    out = []
    for lang, found in scored.items():
        for rank, (score, a, phrase, left, right, n) in enumerate(sorted(found)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def phrase_rows(n=300):
    rng = random.Random(8)
    vocabulary = ["the", "Of", "a", "new", "york", "é", "United", "STATES", "x\x00y", "und", "to", "be"]
    fixed = ["New York City", "to be or not to be", "of the", "a a a a a a", "only in one place here"]
    rows = []
    for i in range(n):
        parts = [rng.choice(vocabulary) if rng.random() < 0.7 else rng.choice(fixed[:4]) for _ in range(rng.randint(0, 30))]
        rows.append((rng.choice((" ", " ", "\t", ", ", "\n", "  ")).join(parts), rng.choice(("en", "en", "de", None, "und"))))
    # Frequent in one document only, so that hardly any sample proposes it.
    rows += [((fixed[4] + "; ") * 60, "en"), (None, "en"), ("", None), (" .,\n", "fr"), ("z" * 70_000, "de"), ("lone", "fr")]
    return rows


def phrases_of(df, least, best, **options):
    done = phrases.collocations(df, least, best, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(tuple(r) for r in done.collect())


@pytest.mark.parametrize("sample", [1, 4, 100_000])
def test_phrases_match_plain_version(spark, sample):
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert phrases_of(df, 20, 15, sample=sample, block=500) == plain_phrases(rows, 20, 15)


def test_small_filter_and_clashing_names(spark, monkeypatch):
    """A full filter lets everything pass and changes no result."""
    monkeypatch.setattr(phrases, "FILTER_BITS", 1)
    rows = phrase_rows(60)
    df = spark.createDataFrame(rows, "text string, lang string").select("*", *[F.lit(1).alias(c) for c in CLASHING])
    assert phrases_of(df, 6, 2000) == plain_phrases(rows, 6, 2000)


def test_border_failures_need_one_more_pass(spark, monkeypatch):
    """Without a sample one more pass finds all, and no phrase is counted twice."""
    seen = []
    whole = phrases._pass
    monkeypatch.setattr(phrases, "_pass", lambda *a: seen.append(a[-1]) or whole(*a))
    rows = phrase_rows(80)
    df = spark.createDataFrame(rows, "text string, lang string")
    found = phrases.frequent_phrases(df, 8, sample=10**9).where("words > 0")
    assert found.where("words > 2").count() > 0
    assert seen.count("phrase-expansion") == 1
    assert found.count() == found.select("lang", "phrase").distinct().count()


def test_exact_scores_past_64_bits(spark):
    rows = spark.createDataFrame([(4_000_000_000, 9_000_000_000_000, 5_000_000_000, 7_000_000_000)], "a long, n long, l long, r long")
    score = "CAST(1000 * a AS DECIMAL(20,0)) * CAST(n AS DECIMAL(18,0)) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"
    assert rows.selectExpr(f"{score} AS s").first()["s"] == 1000 * 4 * 10**9 * 9 * 10**12 // (35 * 10**18)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
