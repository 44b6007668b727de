"""n-gram counts over sentences, as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.sketches import most_frequent

# Fixed patterns: where a sentence ends and what separates words.
SENTENCE_END = r"[.!?\n]+"
NOT_WORD = r"[^\p{L}\p{N}]+"
WORDS = "words"
SAMPLE = 64  # one text in so many proposes what is counted one by one
PROPOSALS = 4096


def sentence_words(df: DataFrame, text: str) -> DataFrame:
    """One row per sentence with its lower-case words, in order."""
    sentences = df.select(F.explode(F.split(F.lower(text), SENTENCE_END)).alias("_s"))
    return sentences.select(F.array_remove(F.split("_s", NOT_WORD), "").alias(WORDS))


def sampled(df: DataFrame, column: str) -> DataFrame:
    """One row in ``SAMPLE``, copies apart, to propose what may be frequent."""
    return df.where(F.pmod(F.xxhash64(column, F.monotonically_increasing_id()), F.lit(SAMPLE)) == 0)


def _windows(sentences: DataFrame, n: int) -> DataFrame:
    """One row per run of ``n`` consecutive words, in columns ``w0`` ... The
    array is zipped with itself moved on, which needs no per-word function."""
    long_enough = sentences.where(F.size(WORDS) >= n)
    count = F.size(WORDS) - (n - 1)
    moved = F.arrays_zip(*[F.slice(WORDS, F.lit(i + 1), count).alias(f"w{i}") for i in range(n)])
    named = moved.cast("array<struct<" + ", ".join(f"w{i}: string" for i in range(n)) + ">>")
    return long_enough.select(F.inline(named))


def _texts(runs: DataFrame, places: list[str]) -> DataFrame:
    return runs.select(F.concat_ws(" ", *places).alias("item"))


def _top(runs: DataFrame, some: DataFrame, places: list[str], k: int) -> DataFrame:
    """The k most frequent texts of ``runs``; the most frequent of ``some`` are proposed."""
    proposed = _texts(some, places).groupBy("item").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "item").limit(PROPOSALS)
    return most_frequent(_texts(runs, places), proposed, k).withColumnRenamed("item", "ngram")


def ngrams(sentences: DataFrame, n: int) -> DataFrame:
    """Every run of ``n`` consecutive words as one text, a row each (``ngram``)."""
    return _windows(sentences, n).select(F.concat_ws(" ", *[f"w{i}" for i in range(n)]).alias("ngram"))


def top_ngrams(sentences: DataFrame, n: int, k: int, some: DataFrame | None = None) -> DataFrame:
    """The k most frequent n-grams, ties by text. ``sentences`` has an array
    column ``words``. Exact: those frequent in ``some`` sentences (a sample taken
    before the words were split, else of ``sentences``) are counted one by one, all
    others in groups, and only groups large enough to hold one of the k are opened."""
    places = [f"w{i}" for i in range(n)]
    return _top(_windows(sentences, n), _windows(sampled(sentences, WORDS) if some is None else some, n), places, k)


def top_context_ngrams(sentences: DataFrame, pattern: list[str | None], k: int, some: DataFrame | None = None) -> DataFrame:
    """The k most frequent fillers of the ``None`` places in a word pattern;
    ``some`` as in ``top_ngrams``."""
    places = [f"w{i}" for i, p in enumerate(pattern) if p is None]
    if not places:
        raise ValueError("the pattern has no open place")
    fixed: list[Column] = [F.col(f"w{i}") == p for i, p in enumerate(pattern) if p is not None]
    runs, few = _windows(sentences, len(pattern)), _windows(sampled(sentences, WORDS) if some is None else some, len(pattern))
    for condition in fixed:
        runs, few = runs.where(condition), few.where(condition)
    return _top(runs, few, places, k)
