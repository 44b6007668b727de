"""Removal of repeated passages: windows of words that start more than once.

1. One pass over the texts hashes words and takes each window's anchor, the
   smallest hash of the ``GRAM``-word runs inside it. Windows of equal words have
   equal anchors, so a window occurs no more often than its anchor; neighbours
   share anchors, about one to ten words.
2. Documents of equal words are settled at once: every window of theirs repeats.
   One of each group stands for it below.
3. Count-min prefilter. Anchors are dealt to slices by hash; in its slice an
   anchor has one cell in each of ``DEPTH`` rows. Blocks of documents send each
   slice the cells they use, marked where used twice; the slice adds the blocks'
   sketches and answers with a bit per cell, set if its sum is two or more. An
   anchor whose cells are all set is estimated to repeat; sums only overestimate,
   so no repeated window is lost.
4. Only documents with such anchors are read again. Their windows under those
   anchors, as 128-bit digests of the words, are sent to owners, distinct per
   block, and grouped exactly; the answer is a bit per digest.
5. Words under a window whose bit is set go.

Messages hold a block's distinct values, so a passage that a third of all
documents share is one entry per block, and no task gets all its places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SPACES, rows_with, small_batches, stored, text_of
from millrace.llm.ngram_join import CHUNK, _batch, _bits, _flags, _mixed, _owners, _pack_gaps, _power_tables, _unpack_gaps
from millrace.skew import checked_broadcast

WINDOW = 35
GRAM = 16  # words of an anchor
DEPTH = 3  # rows of the sketch
LOAD = 4  # cells per row and anchor of a slice
SLICE = 2_000_000  # anchors, or windows, that one owner merges
BLOCK = 500_000  # anchors, or windows, of a block of documents
KEY = 16  # bytes

_ROWS = np.array([0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xD1342543DE82EF95, 0xA0761D6478BD642F], np.uint64)
_SECOND = np.uint64(0xE7037ED1A0B428DB)


def hashed_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, hashes of all words, where each text's words
    begin and end) of chunks of texts. Words lie between white space."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        b, ends = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        word = (b != 32) & ((b < 9) | (b > 13))
        inner = word[:-1] & word[1:]
        cut = ends[(ends > 0) & (ends < len(b))]
        inner[cut - 1] = False
        starts = np.flatnonzero(word & ~np.concatenate(([False], inner))[: len(b)])
        stops = np.flatnonzero(word & ~np.concatenate((inner, [False]))[: len(b)]) + 1
        up, down = _power_tables(len(b) + 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
        yield first, _mixed((sums[stops] - sums[starts]) * down[starts]), np.searchsorted(starts, ends)
        first = last


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words, across the ends of texts too."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    up, down = _power_tables(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return _mixed((sums[n:] - sums[:-n]) * down[: len(hashes) - n + 1])


def _anchors(hashes: np.ndarray, cuts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the word runs, starts of the windows, place of each window's anchor)."""
    grams = _runs(hashes, gram)
    counts = np.maximum(0, np.diff(cuts) - window + 1)
    starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(cuts[:-1], counts)
    if not len(starts):
        return grams, starts, starts
    width = window - gram + 1
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    least = np.empty(len(starts), np.int64)
    for a in range(0, len(starts), 1 << 16):  # the leftmost smallest
        part = starts[a : a + (1 << 16)]
        least[a : a + (1 << 16)] = part + view[part].argmin(axis=1)
    return grams, starts, least


SCAN = {"key": pa.binary(), "n_words": pa.int32(), "sequence": pa.binary(), "anchors": pa.binary(), "places": pa.binary()}
SCAN_SQL = "key binary, n_words int, sequence binary, anchors binary, places binary"


def _scan(window: int, gram: int):
    """(key, text) rows to word counts, digests of the words, and anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for first, hashes, cuts in hashed_words(batch.column(1)):
                grams, starts, least = _anchors(hashes, cuts, window, gram)
                places = least[np.flatnonzero(np.diff(least, prepend=-1))]  # ascending
                at = np.searchsorted(places, cuts)
                out: dict[str, list] = {k: [] for k in SCAN}
                for i, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                    own = places[at[i] : at[i + 1]]
                    out["n_words"].append(z - a)
                    out["sequence"].append(hashlib.blake2b(hashes[a:z].tobytes(), digest_size=KEY).digest())
                    out["anchors"].append(grams[own].tobytes())
                    out["places"].append((own - a).astype(np.uint32).tobytes())
                out["key"] = keys.slice(first, len(cuts) - 1).to_pylist()
                yield _batch(out, SCAN)

    return run


class _Block:
    """Values of a run of documents, with the documents they belong to."""

    def __init__(self) -> None:
        self.keys: list[bytes] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, key: bytes, *arrays: np.ndarray) -> None:
        self.keys.append(key)
        self.parts.append(arrays)
        self.held += len(arrays[0])

    def row(self, sender: int, number: int) -> pa.RecordBatch:
        sizes = np.array([len(p[0]) for p in self.parts], np.uint32)
        values = [np.concatenate([p[k] for p in self.parts]) for k in range(len(self.parts[0]))]
        cells = [sender, number, b"".join(self.keys), sizes.tobytes(), *[v.tobytes() for v in values]]
        return _batch({k: [v] for k, v in zip(BLOCKS, cells)}, BLOCKS)


BLOCKS = {"sender": pa.int32(), "block": pa.int32(), "keys": pa.binary(), "sizes": pa.binary(), "places": pa.binary(), "high": pa.binary(), "low": pa.binary()}
BLOCKS_SQL = "sender int, block int, keys binary, sizes binary, places binary, high binary, low binary"
LISTS = {"sender": pa.int32(), "block": pa.int32(), "owner": pa.int32(), "codes": pa.binary(), "low": pa.binary(), "twice": pa.binary()}
LISTS_SQL = "sender int, block int, owner int, codes binary, low binary, twice binary"
ANSWERS_SQL = "sender int, block int, owner int, bits binary"


def _blocks(values, block: int):
    """Batches to rows of blocks; ``values`` yields (key, places, high, low) of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sender, number, held = TaskContext.get().partitionId(), 0, _Block()
        for batch in batches:
            for document in values(batch):
                held.add(*document)
                if held.held >= block:
                    yield held.row(sender, number)
                    number, held = number + 1, _Block()
        if held.keys:
            yield held.row(sender, number)

    return run


def _anchor_values(batch: pa.RecordBatch) -> Iterator[tuple]:
    none = np.empty(0, np.uint64)
    for key, anchors, places in zip(*[c.to_pylist() for c in batch.columns]):
        yield key, np.frombuffer(places, np.uint32), np.frombuffer(anchors, np.uint64), none


def _window_values(window: int, gram: int):
    """The windows of (key, text, suspects) rows whose anchors are suspect."""

    def run(batch: pa.RecordBatch) -> Iterator[tuple]:
        keys, suspects = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for first, hashes, cuts in hashed_words(batch.column(1)):
            _, starts, least = _anchors(hashes, cuts, window, gram)
            docs = range(len(cuts) - 1)
            wanted = np.concatenate([np.frombuffer(suspects[first + i], np.uint32) + cuts[i] for i in docs]).astype(np.int64)
            flags = np.zeros(len(hashes) + 1, bool)
            flags[wanted] = True
            starts = starts[flags[least]]
            high, low = _runs(hashes, window), _runs(_mixed(hashes ^ _SECOND), window)
            at = np.searchsorted(starts, cuts)
            for i in docs:
                own = starts[at[i] : at[i + 1]]
                if len(own):
                    yield keys[first + i], (own - cuts[i]).astype(np.uint32), high[own], low[own]

    return run


# ---------------------------------------------------------------- the sketch


def _cells(anchors: np.ndarray, owners: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(slice, cells in the rows of its sketch) of each anchor. An anchor is a
    smallest hash of many, so it is mixed again."""
    mixed = _mixed(anchors ^ _SECOND)
    owner = ((mixed >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
    rows = [(_mixed(anchors * _ROWS[k] + _ROWS[k]) % np.uint64(width)) + np.uint64(k * width) for k in range(DEPTH)]
    return owner, np.stack(rows)


def _used(block_anchors: bytes, owners: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells in use, over all slices, ascending; uses of each; cells of each anchor)."""
    anchors = np.frombuffer(block_anchors, np.uint64)
    owner, cells = _cells(anchors, owners, width)
    flat = cells + owner * np.uint64(DEPTH * width)
    used, counts = np.unique(flat, return_counts=True)
    return used, counts, flat


def _by_owner(values: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    owner = (values // np.uint64(size)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(owner, prepend=-1))
    return list(zip(owner[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(values)]))


def _send_cells(owners: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sender, block, anchors in zip(*[batch.column(c).to_pylist() for c in ("sender", "block", "high")]):
                used, counts, _ = _used(anchors, owners, width)
                out: dict[str, list] = {k: [] for k in LISTS}
                for owner, a, z in _by_owner(used, DEPTH * width):
                    codes = _pack_gaps(used[a:z] - np.uint64(owner * DEPTH * width))
                    for k, v in zip(out, (sender, block, owner, codes, b"", _bits(counts[a:z] > 1))):
                        out[k].append(v)
                yield _batch(out, LISTS)

    return run


def _merge_sketches(width: int):
    """A slice: the blocks' sketches are added, sums of two and more told back."""

    def run(lists: pd.DataFrame) -> pd.DataFrame:
        sums, cells = np.zeros(DEPTH * width, np.uint8), []
        for codes, twice in zip(lists["codes"], lists["twice"]):
            own = _unpack_gaps(codes)
            sums[own] = np.minimum(2, sums[own] + 1 + _flags(twice, len(own)))
            cells.append(own)
        return lists[["sender", "block", "owner"]].assign(bits=[_bits(sums[own] > 1) for own in cells])

    return run


def _block_bits(answers: pd.DataFrame, runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    told, out = dict(zip(answers["owner"], answers["bits"])), np.zeros(n, bool)
    for owner, a, z in runs:
        out[a:z] = _flags(told[owner], z - a)
    return out


def _suspects(owners: int, width: int):
    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks) or not len(answers):
            return pd.DataFrame({"key": [], "suspects": []})
        row = blocks.iloc[0]
        used, _, flat = _used(row["high"], owners, width)
        bits = _block_bits(answers, _by_owner(used, DEPTH * width), len(used))
        repeats = bits[np.searchsorted(used, flat)].all(axis=0)
        places = np.frombuffer(row["places"], np.uint32)
        ends = np.cumsum(np.frombuffer(row["sizes"], np.uint32).astype(np.int64))
        found = [(row["keys"][i * KEY : (i + 1) * KEY], places[a:z][repeats[a:z]].tobytes()) for i, (a, z) in enumerate(zip([0, *ends[:-1]], ends)) if repeats[a:z].any()]
        return pd.DataFrame(found, columns=["key", "suspects"])

    return run


# ---------------------------------------------------------------- exact grouping


def _distinct(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(high and low halves of the block's distinct digests, uses, place of each window's digest)."""
    high, low = np.frombuffer(row["high"], np.uint64), np.frombuffer(row["low"], np.uint64)
    order = np.lexsort((low, high))
    h, l = high[order], low[order]  # noqa: E741
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (l[1:] != l[:-1])
    firsts = np.flatnonzero(new)
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(new) - 1
    return h[firsts], l[firsts], np.diff(firsts, append=len(h)), place


def _send_windows(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                high, low, counts, _ = _distinct(row)
                out: dict[str, list] = {k: [] for k in LISTS}
                for owner, a, z in _owners(high, 64, owners):
                    for k, v in zip(out, (row["sender"], row["block"], owner, _pack_gaps(high[a:z]), low[a:z].tobytes(), _bits(counts[a:z] > 1))):
                        out[k].append(v)
                yield _batch(out, LISTS)

    return run


def _group_windows(lists: pd.DataFrame) -> pd.DataFrame:
    """An owner: a bit per digest of each list, set if it occurs twice there or in any other."""
    highs = [_unpack_gaps(c) for c in lists["codes"]]
    sizes = [len(h) for h in highs]
    high, low = np.concatenate(highs), np.concatenate([np.frombuffer(x, np.uint64) for x in lists["low"]])
    order = np.lexsort((low, high))
    h, l = high[order], low[order]  # noqa: E741
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = (h[1:] == h[:-1]) & (l[1:] == l[:-1])
    again = np.empty(len(h), bool)
    again[order] = same[1:] | same[:-1]
    parts = np.split(again, np.cumsum(sizes)[:-1])
    bits = [_bits(p | _flags(t, len(p))) for p, t in zip(parts, lists["twice"])]
    return lists[["sender", "block", "owner"]].assign(bits=bits)


REMOVED_SQL = "key binary, removed array<struct<first:int,words:int>>"


def _covered(owners: int, window: int):
    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks) or not len(answers):
            return pd.DataFrame({"key": [], "removed": []})
        row = blocks.iloc[0]
        high, _, _, place = _distinct(row)
        repeats = _block_bits(answers, _owners(high, 64, owners), len(high))[place]
        places = np.frombuffer(row["places"], np.uint32).astype(np.int64)
        ends = np.cumsum(np.frombuffer(row["sizes"], np.uint32).astype(np.int64))
        found = []
        for i, (a, z) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
            starts = places[a:z][repeats[a:z]]
            if len(starts):
                cuts = np.flatnonzero(np.diff(starts, prepend=-window - 1) > window)
                firsts, lasts = starts[cuts], starts[np.append(cuts[1:], len(starts)) - 1] + window
                spans = [{"first": f, "words": w} for f, w in zip(firsts.tolist(), (lasts - firsts).tolist())]
                found.append((row["keys"][i * KEY : (i + 1) * KEY], spans))
        return pd.DataFrame(found, columns=["key", "removed"])

    return run


def _exchange(blocks: DataFrame, send, owner_side, back, schema: str) -> DataFrame:
    """Blocks to owners and the owners' bits back to the blocks."""
    answers = blocks.mapInArrow(send, LISTS_SQL).groupBy("owner").applyInPandas(owner_side, ANSWERS_SQL)
    return blocks.groupBy("sender", "block").cogroup(answers.groupBy("sender", "block")).applyInPandas(back, schema)


def repeated_spans(texts: DataFrame, window: int = WINDOW, block: int = BLOCK, slice_size: int = SLICE) -> DataFrame:
    """(key, whole, removed) of the (key, text) rows in which a window repeats:
    ``whole`` if all words go, else the spans that do. Rows of one key and text
    are documents of their own; they get one row here."""
    gram = min(GRAM, window)
    spark = texts.sparkSession
    with small_batches(spark):
        rows = stored(texts.mapInArrow(_scan(window, gram), SCAN_SQL), "passage-rows").where(F.col("n_words") >= window)
    classes = stored(rows.groupBy("sequence").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("copies")), "passage-classes")
    heads = classes.select("key", "copies")
    marked = rows.join(heads, "key", "left")
    whole = marked.where("copies IS NULL OR copies > 1").select("key").distinct()
    own = marked.where("copies IS NOT NULL").select("key", "anchors", "places")
    with small_batches(spark):
        blocks = stored(own.mapInArrow(_blocks(_anchor_values, block), BLOCKS_SQL), "passage-anchors")
        total = blocks.agg(F.sum(F.octet_length("high"))).first()[0] or 0
    owners = max(16, -(-total // 8 // slice_size))
    width = max(1 << 10, LOAD * -(-total // 8 // owners))
    with small_batches(spark, 4):  # a block is a large row
        found = stored(_exchange(blocks, _send_cells(owners, width), _merge_sketches(width), _suspects(owners, width), "key binary, suspects binary"), "passage-suspects")
    again = texts.join(checked_broadcast(found), "key")
    with small_batches(spark):
        windows = stored(again.select("key", "text", "suspects").mapInArrow(_blocks(_window_values(window, gram), block), BLOCKS_SQL), "passage-windows")
        total = windows.agg(F.sum(F.octet_length("high"))).first()[0] or 0
    owners = max(16, -(-total // 8 // slice_size))
    with small_batches(spark, 4):
        spans = stored(_exchange(windows, _send_windows(owners), _group_windows, _covered(owners, window), REMOVED_SQL), "passage-spans")
    whole = stored(whole.select("key", F.lit(True).alias("whole")), "passage-whole")
    # Copies of one row may have sent their windows twice; they are among the whole ones.
    spans = rows_with(spans, whole.select("key"), ["key"], "left_anti")
    return whole.unionByName(spans.withColumn("whole", F.lit(False)), allowMissingColumns=True)


def _key(id_column: str, text: Column) -> Column:
    name = F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit(":"), text)
    return F.unhex(F.substring(F.sha2(name.cast("binary"), 256), 1, 2 * KEY))


def without_repeats(
    docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text", **sizes: int
) -> DataFrame:
    """One row per row of ``docs``: the id column, n_words, n_removed, removed
    (spans of word places from 0, NULL if all words go) and kept_text, the words
    that stay, joined by single spaces.

    A word goes if a window of ``window`` consecutive words that covers it starts
    anywhere else, too: in another document or, overlaps included, in the same.
    All places go, the first one too; windows are judged on the input.

    Words lie between spaces, tabs and line breaks and are compared unchanged.
    NULL and empty texts have no words; texts of fewer words than a window lose
    none. Rows that repeat an id count as documents of their own, and if they
    repeat its text, too, they lose all of it. Ids may be NULL and of any type.
    An empty table gives no rows. Other columns of ``docs`` play no part. Windows
    are compared by 128-bit digests.
    """
    text = text_of(text_column)
    texts = docs.select(_key(id_column, text).alias("key"), text.alias("text"))
    spans = stored(repeated_spans(texts, window, **sizes), "passage-verdicts")
    rows = docs.select(F.col(id_column).alias("id"), _key(id_column, text).alias("key"), F.regexp_replace(F.regexp_replace(text, f"^{SPACES}|{SPACES}$", ""), SPACES, " ").alias("norm"))
    rows = rows.join(checked_broadcast(spans), "key", "left")
    words = F.when(F.col("norm") == "", F.array().cast("array<string>")).otherwise(F.split("norm", " ", -1))
    rows = rows.withColumn("n_words", F.when(F.col("norm") == "", 0).otherwise(F.size(F.split("norm", " ", -1))).cast("long"))
    # Between the spans, before the first and after the last one.
    starts = F.expr("concat(array(0), transform(removed, s -> s.first + s.words))")
    stops = F.concat(F.expr("transform(removed, s -> s.first)"), F.array(F.col("n_words").cast("int")))
    pieces = F.zip_with(starts, stops, lambda a, z: F.slice(words, a + 1, z - a))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    kept = F.when(F.col("whole"), F.lit("")).when(F.col("removed").isNotNull(), F.array_join(F.flatten(pieces), " ")).otherwise(F.col("norm"))
    return rows.select(
        F.col("id").alias(id_column), "n_words",
        F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce(gone, F.lit(0).cast("long"))).alias("n_removed"),
        F.when(~F.coalesce("whole", F.lit(False)), F.coalesce("removed", F.array().cast("array<struct<first:int,words:int>>"))).alias("removed"),
        kept.alias("kept_text"),
    )
