"""Phrases whose words occur together more often than apart, by Toivonen's mining.

A sample of the documents proposes: phrases of up to ``MAX_WORDS - 1`` words that
are frequent there under a lowered threshold, level by level. One pass over all
documents then counts exactly every phrase whose parts without its last and
without its first word are proposed (or that is one word): the proposed phrases
and their negative border. If a phrase that was not proposed turns out frequent,
phrases built on it were missed: an expansion pass counts those whose parts are
now known to be frequent or were not counted either. A part that was counted and
is not frequent rules a phrase out, so nothing is left open after it. The sample
decides whether that pass is needed and how much it counts, never the result.

Tasks test the parts against a Bloom filter, at most ``FILTER_BITS`` large whatever
the input; what it lets through too much is counted in vain and nothing is lost.
Counts are summed per block of text, then per task, then over all: a phrase is one
row per task, however often it occurs. Most phrases of the border occur a few times
only, so their texts are not shuffled: before the pass over all documents another one
sums counts by a 36-bit fingerprint, sent sorted as gaps (about two bytes each), and
only phrases whose fingerprint is found often enough are counted by text. A sum is
never less than the count of any phrase under it, so none that is frequent is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import golomb
from millrace.llm.common import small_batches, stored, text_of
from millrace.llm.ngram_join import CHUNK, _batch, _mixed, _power_tables
from millrace.operators.joins import map_join
from millrace.operators.ordering import first_in_groups

MAX_WORDS = 5
MIN_COUNT = 100
BEST = 2000
SAMPLE = 4  # one document in so many proposes
BLOCK = 500_000  # words that are counted together before they leave Python
FILTER_BITS = 1 << 29  # of the filter that all tasks hold: 64 MB
BITS_PER_PHRASE = 16
OUT_ROWS, OUT_BYTES = 100_000, 16_000_000  # about so much leaves Python at once
FINGER_BITS = 36  # of a phrase's mark
COUNT_BITS = 28  # of a count beside it
OWNER_BYTES, MOST_OWNERS = 32_000_000, 14  # text whose fingerprints one owner sums; bits of an owner's number
SPREAD = 64  # parts of a language that are ranked on their own first

_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
#: ``key``: language, a tab, and the phrase, which holds none; without one for all words of the language.
COUNTS_SQL = "key string, f long"
PRINTS = {"owner": pa.int32(), "codes": pa.binary(), "twice": pa.binary(), "more": pa.binary()}
PRINTS_SQL = "owner int, codes binary, twice binary, more binary"
KNOWN_SQL = "lang string, phrase string, words int, f long, mark long, known boolean"
KNOWN = {"lang": pa.string(), "phrase": pa.string(), "words": pa.int32(), "f": pa.int64(), "mark": pa.int64(), "known": pa.bool_()}


class Filter:
    """A Bloom filter of 2^bits places with two hash functions."""

    def __init__(self, words: np.ndarray, bits: int) -> None:
        self.words, self.last = words, np.uint64((1 << bits) - 1)

    def has(self, marks: np.ndarray) -> np.ndarray:
        out = np.ones(len(marks), bool)
        for place in (marks & self.last, (marks >> np.uint64(32)) & self.last):
            out &= (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0
        return out


class Filters(NamedTuple):
    """What a pass goes by: the proposals; in an expansion pass the frequent
    phrases; and, if fingerprints were summed before, those found often enough."""

    proposals: Filter | None = None
    frequent: Filter | None = None
    finalists: Filter | None = None


def filter_of(phrases: DataFrame) -> Filter:
    """The filter of the ``mark`` column; only its bits come to the driver."""
    n = phrases.count()
    bits = max(10, min(FILTER_BITS.bit_length() - 1, (n * BITS_PER_PHRASE).bit_length()))
    last = F.lit((1 << bits) - 1).cast("long")
    places = F.explode(F.array(F.col("mark").bitwiseAND(last), F.shiftrightunsigned("mark", 32).bitwiseAND(last)))
    set_bits = phrases.select(places.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    found = set_bits.toArrow()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy()
    return Filter(words.view(np.uint64), bits)


# ---------------------------------------------------------------- counting in tasks


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CUT = _table(b".,;:!?\n\x0b\x0c\r")
_WORD = ~(_CUT | _table(b" \t"))


class Words:
    """The words of a run of texts: bytes with one space after each word, their
    lengths with it, hashes, pieces and languages."""

    def __init__(self) -> None:
        self.parts: dict[str, list[np.ndarray]] = {k: [] for k in ("data", "lens", "h", "piece", "lang")}
        self.held = self.pieces = 0

    def add(self, b: np.ndarray, ends: np.ndarray, langs: np.ndarray) -> None:
        b = _LOWER[b]
        cut, word = _CUT[b], _WORD[b]
        inner = word[:-1] & word[1:]
        inner[ends[(ends > 0) & (ends < len(b))] - 1] = False
        starts = np.flatnonzero(word & ~np.concatenate(([False], inner))[: len(b)])
        if not len(starts):
            return
        stops = np.flatnonzero(word & ~np.concatenate((inner, [False]))[: len(b)]) + 1
        lens = stops - starts + 1
        data = np.full(int(lens.sum()), 32, np.uint8)
        filled = np.ones(len(data), bool)
        filled[np.cumsum(lens) - 1] = False
        data[filled] = b[word]
        breaks = np.flatnonzero(cut)
        doc = np.searchsorted(ends, starts, "right") - 1  # empty texts end where they start
        piece = np.searchsorted(breaks, starts) + doc  # rises with every break and every text
        up, down = _power_tables(len(b) + 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
        h = _mixed((sums[stops] - sums[starts]) * down[starts])
        values = (data, lens.astype(np.int32), h, (piece + self.pieces).astype(np.int32), langs[doc].astype(np.int32))
        for name, v in zip(self.parts, values):
            self.parts[name].append(v)
        self.held += len(starts)
        self.pieces += len(breaks) + len(ends)

    def joined(self) -> dict[str, np.ndarray]:
        return {k: np.concatenate(v) for k, v in self.parts.items()}


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, ends of texts in them, first text, last + 1) of chunks of a batch."""
    texts = batch.column(1).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        yield data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first, last
        first = last


class Runs:
    """Hashes of consecutive words at given places, from running sums."""

    def __init__(self, h: np.ndarray) -> None:
        self.h, (up, self.down) = h, _power_tables(len(h) + 1)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=self.sums[1:])

    def at(self, places: np.ndarray, n: int) -> np.ndarray:
        if n == 1:
            return self.h[places]
        return _mixed((self.sums[places + n] - self.sums[places]) * self.down[places] + np.uint64(n))


def _candidates(marks, piece: np.ndarray, top: int, possible) -> list[np.ndarray]:
    """Per level, the places of phrases both of whose parts are possible; level 1
    is all words. ``possible(level, places, marks)`` tells for phrases of a level."""
    places = np.arange(len(piece))
    out = [places]
    for level in range(1, top):
        inside = np.zeros(len(piece) + 1, bool)
        inside[places[possible(level, places, marks(places, level))]] = True
        places = np.flatnonzero(inside[:-1] & inside[1:])
        places = places[places + level < len(piece)]
        places = places[piece[places + level] == piece[places]]
        out.append(places)
    return out


def _proposed(marks, piece: np.ndarray, top: int, proposals: Filter | None) -> list[np.ndarray]:
    """What the first pass counts: a function of a phrase's words alone."""
    return _candidates(marks, piece, top, lambda _, places, m: np.zeros(len(places), bool) if proposals is None else proposals.has(m))


def _missed(marks, piece: np.ndarray, top: int, proposals: Filter | None, frequent: Filter) -> list[np.ndarray]:
    """What the first pass did not count and may be frequent all the same."""
    counted = []
    for places in _proposed(marks, piece, top, proposals):
        counted.append(np.zeros(len(piece), bool))
        counted[-1][places] = True
    found = _candidates(marks, piece, top, lambda level, places, m: frequent.has(m) | ~counted[level - 1][places])
    return [places[~counted[level][places]] for level, places in enumerate(found)]


class Found:
    """The phrases to count in a run of texts: their places per level, and their marks."""

    def __init__(self, words: Words, langs: list[str], top: int, filters: Filters) -> None:
        self.w, self.names = words.joined(), _names(langs)
        self.first, piece = Runs(self.w["h"]), self.w["piece"]
        self.places = (
            _proposed(self.marks, piece, top, filters.proposals) if filters.frequent is None
            else _missed(self.marks, piece, top, filters.proposals, filters.frequent)
        )

    def marks(self, places: np.ndarray, k: int) -> np.ndarray:
        return _mixed(self.first.at(places, k) ^ self.names[self.w["lang"][places]])


def _prints(marks: np.ndarray) -> np.ndarray:
    return marks >> np.uint64(64 - FINGER_BITS)


def _sent(bits: int, most: int, top: int, filters):
    """Blocks of words to (owner, codes, twice, more): each owner's fingerprints as
    gaps, a bit for those found repeatedly, and how often these were found, at most ``most``."""
    low = np.uint64(FINGER_BITS - bits)

    def made(words: Words, langs: list[str]) -> Iterator[pa.RecordBatch]:
        found = Found(words, langs, top, filters.value)
        prints = np.sort(_prints(np.concatenate([found.marks(at, k) for k, at in enumerate(found.places, 1)])))
        cuts = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1])))
        counts, prints = np.minimum(np.diff(cuts, append=len(prints)), most), prints[cuts]
        owner = (prints >> low).astype(np.int64)
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        out: dict[str, list] = {k: [] for k in PRINTS}
        for a, z in zip(starts, np.append(starts[1:], len(prints))):
            c = counts[a:z]
            row = (int(owner[a]), golomb.encode(prints[a:z] - (np.uint64(owner[a]) << low)), np.packbits(c > 1).tobytes(), c[c > 1].astype(np.uint32).tobytes())
            for k, v in zip(PRINTS, row):
                out[k].append(v)
        yield _batch(out, PRINTS)

    return made


def _often(bits: int, least: int):
    """Owner side: the fingerprints whose counts make ``least`` in all, as marks for a filter."""

    def run(lists: pd.DataFrame) -> pd.DataFrame:
        packed = []
        for code, twice, more in zip(lists["codes"], lists["twice"], lists["more"]):
            prints = golomb.decode(code)
            counts = np.ones(len(prints), np.uint64)
            counts[np.unpackbits(np.frombuffer(twice, np.uint8), count=len(prints)) > 0] = np.frombuffer(more, np.uint32)
            packed.append(prints << np.uint64(COUNT_BITS) | counts)
        both = np.concatenate(packed)
        both.sort()
        prints, counts = both >> np.uint64(COUNT_BITS), both & np.uint64((1 << COUNT_BITS) - 1)
        starts = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1])))
        own = prints[starts[np.add.reduceat(counts, starts) >= least]] + (np.uint64(lists["owner"].iloc[0]) << np.uint64(FINGER_BITS - bits))
        return pd.DataFrame({"mark": _mixed(own).view(np.int64)})

    return run


def _counted(words: Words, langs: list[str], levels: set[int], filters: Filters) -> Iterator[pa.RecordBatch]:
    found = Found(words, langs, max(levels), filters)
    w, marks, first = found.w, found.marks, found.first
    begin = np.cumsum(w["lens"], dtype=np.int64) - w["lens"]
    second = Runs(_mixed(w["h"] ^ _SECOND))
    for level in sorted(levels):
        at = found.places[level - 1]
        m = marks(at, level)
        if filters.finalists is not None:
            taken = filters.finalists.has(_mixed(_prints(m)))
            at, m = at[taken], m[taken]
        if not len(at):
            continue
        s = second.at(at, level)
        order = np.argsort(m)  # where two phrases share a mark their rows may be several, and are summed later
        at, m, s = at[order], m[order], s[order]
        new = np.ones(len(order), bool)
        new[1:] = (m[1:] != m[:-1]) | (s[1:] != s[:-1])
        cuts = np.flatnonzero(new)
        counts, firsts = np.diff(cuts, append=len(order)), at[cuts]
        near = np.argsort(first.at(firsts, max(1, level - 1)))  # phrases that begin alike follow each other: fewer bytes to shuffle
        counts, firsts = counts[near], firsts[near]
        ends = begin[firsts + level - 1] + w["lens"][firsts + level - 1] - 1
        share = np.cumsum(ends - begin[firsts]) // OUT_BYTES + np.arange(len(firsts)) // OUT_ROWS
        pieces = np.flatnonzero(np.diff(share, prepend=-1))
        for a, z in zip(pieces, np.append(pieces[1:], len(firsts))):
            f, c, sizes = firsts[a:z], counts[a:z], (ends - begin[firsts])[a:z]
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            taken = w["data"][np.arange(offsets[-1]) + np.repeat(begin[f] - offsets[:-1], sizes)]
            phrase = pa.StringArray.from_buffers(len(f), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(taken))
            lang = pa.array(langs, pa.string()).take(pa.array(w["lang"][f]))
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(lang, phrase, "\t"), pa.array(c)], names=["key", "f"])
    if 1 in levels:
        totals = np.bincount(w["lang"], minlength=len(langs))
        rows = [(x + "\t", int(c)) for x, c in zip(langs, totals) if c]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.int64())], names=["key", "f"])


def _names(langs: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], np.uint64)


def _told(filters):
    """(key, f) rows of frequent phrases with their marks and whether all that is
    built on them has been counted: so it is if they were proposed, and always in
    the second pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [k.rpartition("\t") for k in batch.column("key").to_pylist()]
            size = np.array([p.count(" ") + 1 if p else 0 for _, _, p in keys], np.int64)
            words, texts = Words(), [p.encode() for _, _, p in keys]
            ends = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            words.add(np.frombuffer(b"".join(texts), np.uint8), ends, np.zeros(len(texts), np.int64))
            marks = np.zeros(len(keys), np.uint64)
            some = np.flatnonzero(size)
            if len(some):
                h = Runs(words.joined()["h"])
                starts = (np.cumsum(size) - size)[some]
                for k in np.unique(size[some]):
                    own = size[some] == k
                    marks[some[own]] = h.at(starts[own], int(k))
                marks[some] = _mixed(marks[some] ^ _names([keys[i][0] for i in some]))
            given = filters.value
            known = np.ones(len(keys), bool) if given.frequent is not None else np.zeros(len(keys), bool) if given.proposals is None else given.proposals.has(marks)
            yield _batch({"lang": [x for x, _, _ in keys], "phrase": [p or None for _, _, p in keys], "words": size.astype(np.int32),
                          "f": batch.column("f"), "mark": marks.view(np.int64), "known": known}, KNOWN)

    return run


def _in_blocks(block: int, made):
    """(lang, text) rows to what ``made`` gives for the words of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, langs = Words(), {}
        for batch in batches:
            own = np.array([langs.setdefault(x, len(langs)) for x in batch.column(0).to_pylist()], np.int64)
            for data, ends, first, last in _texts(batch):
                words.add(data, ends, own[first:last])
                if words.held >= block:
                    yield from made(words, list(langs))
                    words = Words()
        if words.held:
            yield from made(words, list(langs))

    return run


def _count(levels: set[int], filters, block: int):
    """(lang, text) rows to counts of phrases, by a broadcast of ``Filters``."""
    return _in_blocks(block, lambda words, langs: _counted(words, langs, levels, filters.value))


def _finalists(texts: DataFrame, top: int, proposals: Filter | None, size: int, least: int, block: int) -> Filter:
    """The fingerprints that phrases of the proposals and their border have
    ``least`` times or more. ``size``: about the bytes of the texts; it sets the number of owners."""
    sent = texts.sparkSession.sparkContext.broadcast(Filters(proposals))
    bits = min(MOST_OWNERS, (size // OWNER_BYTES).bit_length())
    most = min(least, (1 << COUNT_BITS) - 1)  # a count this high is enough on its own
    with small_batches(texts.sparkSession):
        prints = texts.mapInArrow(_in_blocks(block, _sent(bits, most, top, sent)), PRINTS_SQL)
        often = stored(prints.groupBy("owner").applyInPandas(_often(bits, most), "mark long"), "phrase-prints")
    return filter_of(often)


def _pass(texts: DataFrame, levels: set[int], filters: Filters, least: int, block: int, label: str) -> DataFrame:
    """(lang, phrase, words, mark, known, f) of phrases found ``least`` times or
    more, and the totals of languages (words = 0)."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(filters)
    with small_batches(spark):
        counts = texts.mapInArrow(_count(levels, sent, block), COUNTS_SQL).groupBy("key").agg(F.sum("f").alias("f"))
        frequent = counts.where((F.col("f") >= least) | F.col("key").endswith("\t"))
        return stored(frequent.mapInArrow(_told(sent), KNOWN_SQL), label)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def lowered(least: int, sample: int) -> int:
    """The threshold in the sample: one deviation below what ``least`` leads to expect."""
    expected = least / sample
    return max(1, math.floor(expected - math.sqrt(expected)))


def frequent_phrases(
    docs: DataFrame, least: int = MIN_COUNT, max_words: int = MAX_WORDS, sample: int = SAMPLE,
    text_column: str = "text", lang_column: str = "lang", block: int = BLOCK,
) -> DataFrame:
    """(lang, phrase, words, f) of every phrase of up to ``max_words`` words that
    occurs ``least`` times or more in a language, and the language's number of
    words as a row without a phrase (words = 0)."""
    text, lang = text_of(text_column), F.coalesce(F.col(lang_column).cast("string"), F.lit("und"))
    texts = docs.select(lang.alias("lang"), text.alias("text"))
    few = stored(texts.where(F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(sample)) == 0), "phrase-sample")
    proposed: list[DataFrame] = []
    current: Filter | None = None
    for level in range(1, max_words):
        found = _pass(few, {level}, Filters(current), lowered(least, sample), block, "phrase-proposals").where("words > 0")
        if not found.limit(1).count():
            break
        proposed.append(found)
        current = filter_of(_union(proposed))
    size = (few.select(F.sum(F.octet_length("text"))).first()[0] or 0) * sample
    finalists = _finalists(texts, max_words, current, size, least, block)
    counted = [_pass(texts, set(range(1, max_words + 1)), Filters(current, finalists=finalists), least, block, "phrase-counts")]
    # Frequent, not proposed, and short enough to be part of a phrase that was missed.
    if counted[0].where(f"words > 0 AND words < {max_words} AND NOT known").limit(1).count():
        frequent = filter_of(counted[0].where(f"words > 0 AND words < {max_words}"))
        counted.append(_pass(texts, set(range(2, max_words + 1)), Filters(current, frequent), least, block, "phrase-expansion"))
    return _union(counted).select("lang", "phrase", "words", "f")


def _part(first: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, size), " ")


def collocations(
    docs: DataFrame, least: int = MIN_COUNT, best: int = BEST, max_words: int = MAX_WORDS, sample: int = SAMPLE,
    text_column: str = "text", lang_column: str = "lang", block: int = BLOCK,
) -> DataFrame:
    """(lang, rank, phrase, words, cut, a, l, r, n, score): each language's ``best``
    phrases of two words and more, by score, count and phrase.

    A phrase found ``least`` times or more is cut after its first words; the cut
    with the lowest floor(1000 * a * n / (l * r)) counts, of equal ones the first.
    Phrases inside a longer one that is found as often are left out.

    Words are lower-cased in A-Z and lie between spaces and tabs; phrases don't
    cross ``. , ; : ! ?`` or line breaks. NULL languages are ``und``. NULL and
    empty texts have no words. Repeated rows count as often as they occur. An
    empty table gives no rows. Other columns of ``docs`` play no part.
    """
    found = stored(frequent_phrases(docs, least, max_words, sample, text_column, lang_column, block), "phrases")
    totals = found.where("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = found.where("words > 0").select("lang", "phrase", "words", "f")
    long = frequent.where("words > 1").withColumnRenamed("f", "a")
    # Whatever holds a phrase and is as frequent contains a phrase one word longer that is, too.
    size = F.col("words") - 1
    inside = long.where("words > 2").select("lang", "a", F.explode(F.array(_part(1, size), _part(2, size))).alias("phrase"))
    covers = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = map_join(long, covers, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a").drop("longer")
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("left", _part(1, F.col("cut"))).withColumn("right", _part(F.col("cut") + 1, F.col("words") - F.col("cut")))
    side = lambda name, value: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    cuts = map_join(map_join(cuts, side("left", "l"), ["lang", "left"]), side("right", "r"), ["lang", "right"])
    cuts = map_join(cuts, totals, ["lang"])
    # Products pass 64 bits; whole decimals of 38 digits hold them.
    cuts = cuts.withColumn("score", F.expr(
        "CAST(1000 * a AS DECIMAL(20,0)) * CAST(n AS DECIMAL(18,0)) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"
    ))
    worst = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "words", "a", "l", "r", "n")).alias("w")).select("lang", "phrase", "w.*")
    order = [("score", "desc"), ("a", "desc"), ("phrase", "asc")]
    # Best of parts of a language first, so that no task ranks all of a large one.
    some = first_in_groups(worst.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))), ["lang", "part"], order, best)
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = some.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "words", "cut", "a", "l", "r", "n", "score")
