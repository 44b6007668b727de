"""Near-duplicate lines across all documents, by an exact set-similarity join.

A line's tokens are its distinct words or, with ``words`` above 1, shingles of so
many words, ordered by rarity. Lines whose prefixes (the n - need + 1 first
tokens) share a token are verified by counting common tokens; of two lines that
reach the Jaccard threshold the later goes. Equal lines are collapsed to one.

Words meet by prefix token, a range of tokens per group, with length and
positional filters and a bound from signatures; what leaves a group is not the
pairs that pass all three but the components they form, a row per line. Only
lines in a component have their words moved, to a task for many small components
or two tiles of a large one, where each line looks for the earliest it matches.
Shingles take the join of ``ngram_join``: lines that share none of their smallest
hashes with any other line are settled first, the rest is joined in independent
parts.

Lines are addressed by one number, id * 2^24 + place, so their order is that of
documents and of lines within them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import golomb
from millrace.llm.common import SPACES, ascii_lower, packed, small_batches, stored, text_of
from millrace.llm.components import components
from millrace.llm.ngram_join import OWNER_BYTES, PART, SHORT, _batch, _mixed, _owners, _short, chunks, linked_sets, need, need_pair, screened, word_hashes
from millrace.scratch import passing
from millrace.skew import checked_broadcast

PERCENT = 75
WORDS = 5
BLOCK = 1_000_000
BLANKS = " \t\n\x0b\f\r"  # the characters of SPACES
LINE_BITS = 24  # lines of a document
ID_LIMIT = 1 << (63 - LINE_BITS)


def _place(line: str) -> Column:
    return F.expr(f"cast(pmod({line}, {1 << LINE_BITS}) as int)")


def _doc(line: str) -> Column:
    return F.expr(f"({line} - pmod({line}, {1 << LINE_BITS})) div {1 << LINE_BITS}")


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc, text) of every row with an id."""
    key = F.col(id_column).cast("long")
    safe = F.when(F.abs(key) < ID_LIMIT, key).otherwise(F.raise_error(F.lit(f"ids must be below {ID_LIMIT}")).cast("long"))
    return docs.where(key.isNotNull()).select(safe.alias("doc"), text_of(text_column).alias("text"))


def _lines(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, text) of every line."""
    cut = _texts(docs, id_column, text_column).select("doc", F.posexplode(F.split("text", "\n", -1)).alias("at", "text"))
    return cut.select((F.col("doc") * (1 << LINE_BITS) + F.col("at")).alias("id"), "text")


def _sequence() -> tuple[Column, Column]:
    """(key, digest it is taken from) of a line's word sequence: equal words, equal sets."""
    ascii_only = F.octet_length("text") == F.char_length("text")  # there `lower` does the same, and faster
    text = F.when(ascii_only, F.lower("text")).otherwise(ascii_lower(F.col("text")))
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.expr("left(h, 32)"), F.sha2(F.regexp_replace(trimmed, SPACES, " ").cast("binary"), 256).alias("h")


def _picked(docs: DataFrame, picked: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, text) of the lines whose addresses are in ``picked``: fetched by
    document, so that whole texts move only where the list is too long to copy."""
    by_doc = picked.select(_doc("id").alias("doc"), _place("id").alias("at")).groupBy("doc").agg(F.collect_set("at").alias("wanted"))  # bounded by the document's own lines
    rows = docs.select(F.col(id_column).cast("long").alias("doc"), text_of(text_column).alias("text"))
    cut = rows.join(checked_broadcast(by_doc), "doc").withColumn("lines", F.split("text", "\n", -1))
    found = cut.select("doc", "lines", F.explode("wanted").alias("at")).where(F.col("at") < F.size("lines"))
    return found.select((F.col("doc") * (1 << LINE_BITS) + F.col("at")).alias("id"), F.get("lines", F.col("at")).alias("text"))


SIGNED = np.array([40, 80, 160, 320])  # most tokens of lines with signatures of 1, 2, 4 and 8 words; beyond that, 16
PAIRS = 500_000  # pairs looked at together
MESSAGES = 1_000_000  # bytes of signatures in a batch of messages
KNOWN = 1 << 20  # words whose frequency class is told to all tasks
BITS = 29  # at most so many bits (as a power of 2) tell which words are in several lines
_KEYS = np.array([0x8CB92BA72F3D8DD7, 0x4F2162926E40C299], np.uint64)


@dataclass
class _Sets:
    """The word sets of the lines of a chunk that have words: their tokens side by side."""

    text: np.ndarray  # of each line: number of its text in the batch,
    at: np.ndarray  # its place in the text,
    starts: np.ndarray  # its first token,
    n: np.ndarray  # and number of tokens
    tokens: np.ndarray
    levels: np.ndarray | None  # of each token: its frequency class

    def keys(self) -> list[np.ndarray]:
        """A digest of each set, as two numbers."""
        return [np.add.reduceat(_mixed(self.tokens ^ k), self.starts).view(np.int64) for k in _KEYS]

    def signs(self) -> list[list[bytes]]:
        """The parity of each line's tokens at each place of its signature."""
        bits = 64 << _level(self.n)
        ends = np.cumsum(bits)
        spots = (self.tokens & np.repeat(bits - 1, self.n).astype(np.uint64)).astype(np.int64) + np.repeat(ends - bits, self.n)
        raw = np.packbits((np.bincount(spots, minlength=bits.sum()) & 1).astype(np.uint8), bitorder="little").tobytes()
        return [[raw[a:z] for a, z in zip(((ends - bits) >> 3).tolist(), (ends >> 3).tolist())]]


def _level(n: np.ndarray) -> np.ndarray:
    """The words of a signature, as a power of 2; folded in half it is that of a lower power."""
    return np.searchsorted(SIGNED, n)


@dataclass
class _Order:
    """Frequency classes of words by the leading ``SHORT`` bits of their hashes:
    0 surely in one line only, 1 rare, above that by rising frequency."""

    known: np.ndarray
    level: np.ndarray
    twice: np.ndarray  # a bit for each value of the first bits of these

    def ranks(self, words: np.ndarray) -> np.ndarray:
        short = _short(words)
        slot = short >> np.uint64(SHORT - (8 * len(self.twice)).bit_length() + 1)
        ranks = self.twice[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1
        if len(self.known):
            place = np.minimum(np.searchsorted(self.known, short), len(self.known) - 1)
            ranks = np.where(self.known[place] == short, self.level[place] + np.uint8(1), ranks)
        return ranks


def _line_sets(texts: pa.Array, by: _Order | None = None) -> Iterator[_Sets]:
    """The lines' distinct words by (class, hash), or by hash."""
    for first, data, ends in chunks(texts):
        spots, words = word_hashes(data, ends)
        if not len(words):
            continue
        breaks = np.flatnonzero(data == 10)
        text = np.searchsorted(ends, spots, "right")
        at = np.searchsorted(breaks, spots) - np.searchsorted(breaks, np.concatenate(([0], ends[:-1])))[text]
        heads = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(at, prepend=-1) != 0))
        line = np.repeat(np.arange(len(heads), dtype=np.uint16 if len(heads) < 1 << 16 else np.int64), np.diff(heads, append=len(words)))
        order = np.argsort(words)
        words, line, ranks = words[order], line[order], None
        if by is not None:
            new = np.diff(words, prepend=~words[:1]) != 0
            ranks = by.ranks(words[new])[np.cumsum(new) - 1]
            order = np.argsort(ranks, kind="stable")
            words, line, ranks = words[order], line[order], ranks[order]
        order = np.argsort(line, kind="stable")
        words, line = words[order], line[order]
        keep = np.ones(len(words), bool)
        keep[1:] = (words[1:] != words[:-1]) | (line[1:] != line[:-1])
        starts = np.flatnonzero(np.diff(line[keep].astype(np.int64), prepend=-1))
        tokens = words[keep]
        yield _Sets(first + text[heads], at[heads], starts, np.diff(starts, append=len(tokens)), tokens, None if ranks is None else ranks[order][keep])


LINES = {"id": pa.int64(), "k0": pa.int64(), "k1": pa.int64(), "owner": pa.int32(), "codes": pa.binary(), "counts": pa.binary()}
LINES_SQL = "id long, k0 long, k1 long, owner int, codes binary, counts binary"


def _line_keys(owners: int, block: int):
    """(address, digest of the word set) of the lines of (doc, text) rows, and
    for each owner of a range of words those of a block with their frequencies."""

    def told(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        words, counts = _summed(*zip(*held))
        runs = _owners(words, SHORT, owners)
        values = {"owner": [o for o, _, _ in runs], "codes": [golomb.encode(words[a:z]) for _, a, z in runs],
                  "counts": [zlib.compress(counts[a:z].astype(np.uint32).tobytes(), 1) for _, a, z in runs]}
        return _batch(values | {k: pa.nulls(len(runs), pa.int64()) for k in ("id", "k0", "k1")}, LINES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            docs = batch.column(0).to_numpy()
            for sets in _line_sets(batch.column(1)):
                k0, k1 = sets.keys()
                none = {"owner": pa.nulls(len(k0), pa.int32())} | {k: pa.nulls(len(k0), pa.binary()) for k in ("codes", "counts")}
                yield _batch({"id": docs[sets.text] * (1 << LINE_BITS) + sets.at, "k0": k0, "k1": k1} | none, LINES)
                held.append(np.unique(_short(sets.tokens), return_counts=True))
                if sum(len(w) for w, _ in held) > block:
                    held = [_summed(*zip(*held))]
                    if len(held[0][0]) > block // 2:
                        yield told(held)
                        held = []
        if held:
            yield told(held)

    return run


def _summed(words: Sequence[np.ndarray], counts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(np.concatenate(words), return_inverse=True)
    return distinct, np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)


def _owned_levels(lists: pd.DataFrame) -> pd.DataFrame:
    """An owner's words of more than one line, by the bit length of their frequency less one."""
    counts = [np.frombuffer(zlib.decompress(c), np.uint32) for c in lists["counts"]]
    words, total = _summed([golomb.decode(c) for c in lists["codes"]], counts)
    level = np.frexp((total - 1).astype(np.float64))[1]
    rows = [(lists["owner"].iloc[0], k, words[level == k]) for k in np.unique(level[level > 0]).tolist()]
    return pd.DataFrame([(o, k, len(w), golomb.encode(w)) for o, k, w in rows], columns=["owner", "level", "n", "codes"])


def _owned_bits(owners: int, bits: int):
    """An owner's part of the bits that tell which words are in several lines."""

    def run(lists: pd.DataFrame) -> pd.DataFrame:
        owner = int(lists["owner"].iloc[0])
        slots = np.concatenate([golomb.decode(c) for c in lists["codes"]]) >> np.uint64(SHORT - bits)
        flags = np.zeros((1 << bits) // owners, np.uint8)
        flags[slots.astype(np.int64) - owner * len(flags)] = 1
        return pd.DataFrame({"owner": [owner], "twice": [np.packbits(flags, bitorder="little").tobytes()]})

    return run


POSTINGS = {"owner": pa.int32(), "first": pa.int64()} | {c: pa.binary() for c in ("tokens", "docs", "places", "sizes", "ats", "signs")}
POSTINGS_SQL = "owner int, first long, tokens binary, docs binary, places binary, sizes binary, ats binary, signs binary"


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold each."""
    kind = next(k for k in (1, 2, 4, 8) if -(1 << (8 * k - 1)) <= values.min() and values.max() < 1 << (8 * k - 1))
    return bytes([kind]) + values.astype(f"i{kind}").tobytes()


def _wide(blobs: pd.Series) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, f"i{b[0]}", offset=1) for b in blobs]).astype(np.int64)


def _word_postings(percent: int, by: _Order, owners: int, block: int):
    """The prefix tokens of each line of (doc, text, copies), but for its
    ``copies`` of earlier lines, with their places and the line's signature: a
    message for each owner of a range of tokens and block."""
    width = np.uint64(owners.bit_length() - 1)

    def told(held: list[tuple[np.ndarray, ...]], signs: list[bytes]) -> Iterator[pa.RecordBatch]:
        tokens, docs, places, n, at, line = (np.concatenate(x) for x in zip(*held))
        owner = (tokens >> (np.uint64(64) - width)).astype(np.uint16 if owners <= 1 << 16 else np.uint32)
        tokens = ((tokens << width) >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(owner, kind="stable")
        cuts = np.flatnonzero(np.diff(owner[order].astype(np.int64), prepend=-1))
        out: dict[str, list] = {k: [] for k in POSTINGS}
        for mine in np.split(order, cuts[1:]):
            doc = docs[mine]
            row = {"owner": int(owner[mine[0]]), "first": int(doc[0]), "tokens": tokens[mine].tobytes(), "docs": _narrow(np.diff(doc, prepend=doc[:1])),
                   "places": _narrow(places[mine]), "sizes": _narrow(n[mine]), "ats": _narrow(at[mine]), "signs": b"".join([signs[k] for k in line[mine].tolist()])}
            for k, v in row.items():
                out[k].append(v)
            if sum(map(len, out["signs"])) >= MESSAGES:
                yield _batch(out, POSTINGS)
                out = {k: [] for k in POSTINGS}
        if out["owner"]:
            yield _batch(out, POSTINGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        signs: list[bytes] = []
        count = 0
        for batch in batches:
            docs, copies = batch.column(0).to_numpy(), batch.column(2)
            gone = copies.flatten()  # leaves out NULL lists
            sizes = pc.fill_null(pc.list_value_length(copies), 0).to_numpy(zero_copy_only=False)
            gone_at = np.repeat(np.arange(len(docs)), sizes) * (1 << LINE_BITS) + gone.field("at").to_numpy(zero_copy_only=False)
            gone_key = gone.field("k0").to_numpy(zero_copy_only=False)
            for sets in _line_sets(batch.column(1), by):
                n, lines = sets.n, sets.text * (1 << LINE_BITS) + sets.at
                stay = np.ones(len(n), bool)
                if len(gone_at):
                    place = np.minimum(np.searchsorted(lines, gone_at), len(lines) - 1)
                    same = (lines[place] == gone_at) & (sets.keys()[0][place] == gone_key)
                    stay[place[same]] = False
                skip = np.add.reduceat((sets.levels == 0).astype(np.int64), sets.starts)
                stay &= n - skip >= need(n, percent)  # others share too few words with any line
                counts = np.where(stay, n - need(n, percent) + 1 - skip, 0)
                row = np.repeat(np.arange(len(n)), counts)
                at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + skip[row]
                small = [x.astype(np.int32) for x in (sets.at[row], n[row], at, len(signs) + row)]
                held.append((sets.tokens[sets.starts[row] + at], docs[sets.text[row]], *small))
                signs += sets.signs()[0]
                count += len(row)
                if count >= block:
                    yield from told(held, signs)
                    held, signs, count = [], [], 0
        if count:
            yield from told(held, signs)

    return run


def _tie(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the trees of each a and b. All nodes point to the least of their tree."""
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


class _Signs:
    """Signatures of postings in the order of ``order``, folded to all lower powers."""

    def __init__(self, data: np.ndarray, n: np.ndarray, order: np.ndarray):
        words = 1 << _level(n)
        begin, self.level = (np.cumsum(words) - words)[order], _level(n[order])
        self.folds: list[tuple[np.ndarray, np.ndarray]] = []
        rows, fold = np.empty(0, np.int64), np.empty((0, 2 << len(SIGNED)), np.uint64)
        for k in range(len(SIGNED), -1, -1):
            own = np.flatnonzero(self.level == k)
            rows, fold = np.concatenate((own, rows)), np.concatenate((data[begin[own][:, None] + np.arange(1 << k)], fold[:, : 1 << k] ^ fold[:, 1 << k :]))
            place = np.zeros(len(order), np.int32)
            place[rows] = np.arange(len(rows))
            self.folds.insert(0, (place, fold))

    def within(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which pairs can have at most ``most`` tokens that only one of them has."""
        place, fold = self.folds[0]
        fits = np.bitwise_count(fold[place[a], 0] ^ fold[place[b], 0]) <= most
        least = np.minimum(self.level[a], self.level[b])
        for k in range(1, len(self.folds)):
            mine = np.flatnonzero(fits & (least == k))
            place, fold = self.folds[k]
            fits[mine] = np.bitwise_count(fold[place[a[mine]]] ^ fold[place[b[mine]]]).sum(axis=1) <= most[mine]
        return fits


def _owned_links(percent: int, repeated: bool):
    """(id, root) of the lines that some pair of an owner's postings ties to a
    smaller id: the components of the pairs that pass all filters."""

    def run(lists: pd.DataFrame) -> pd.DataFrame:
        tokens = np.concatenate([np.frombuffer(b, np.uint32) for b in lists["tokens"]])
        docs = np.concatenate([first + np.cumsum(_wide([d])) for first, d in zip(lists["first"], lists["docs"])])
        ids = docs * (1 << LINE_BITS) + _wide(lists["places"])
        n, at = _wide(lists["sizes"]), _wide(lists["ats"])
        order = np.lexsort((n, tokens))
        data = np.frombuffer(b"".join(lists["signs"]), np.uint64)
        if repeated:  # rows of one id and text say the same
            words = 1 << _level(n)
            ends = np.cumsum(words)
            each = pd.DataFrame({"token": tokens, "id": ids, "n": n, "at": at, "sign": [data[a:z].tobytes() for a, z in zip(ends - words, ends)]})
            order = order[~each.duplicated().to_numpy()[order]]
        signs = _Signs(data, n, order)
        tokens, ids, n, at = tokens[order], ids[order], n[order], at[order]
        count, known = len(order), np.unique(ids)
        node, parent = np.searchsorted(known, ids), np.arange(len(known))
        base = (np.cumsum(np.diff(tokens, prepend=tokens[:1]) != 0)) * (n.max() + 1)
        longest = (100 + percent) * (n - at) // percent - n  # of which the words from here on can be enough
        stop = np.searchsorted(base + n, base + np.clip(longest, 0, n.max()), "right")
        start = 0
        while start < count:
            # Lines followed by none but of their own component need not be looked at again.
            tree = parent[node]
            turns = np.append(np.flatnonzero(tree[1:] != tree[:-1]) + 1, count)
            rows = np.arange(start, min(start + PAIRS, count))
            partners = np.where(turns[np.searchsorted(turns, rows, "right")] >= stop[rows], 0, np.maximum(stop[rows] - rows - 1, 0))
            ends = np.cumsum(partners)
            rows = rows[: max(1, int(np.searchsorted(ends, PAIRS, "right")))]
            start += len(rows)
            partners, ends = partners[: len(rows)], ends[: len(rows)]
            a = np.repeat(rows, partners)
            b = np.arange(len(a)) - np.repeat(ends - partners, partners) + a + 1
            common = need_pair(n[a], n[b], percent)
            fits = (np.minimum(n[a] - at[a], n[b] - at[b]) >= common) & (ids[a] != ids[b])
            a, b, common = a[fits], b[fits], common[fits]
            fits = signs.within(a, b, n[a] + n[b] - 2 * common)
            _tie(parent, node[a[fits]], node[b[fits]])
        tied = np.flatnonzero(parent != np.arange(len(known)))
        return pd.DataFrame({"id": known[tied], "root": known[parent[tied]]})

    return run


TOKENS = {"id": pa.int64(), "comp": pa.int64(), "tokens": pa.binary()}


def _wanted_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(address, component, tokens) of the wanted lines of (doc, text, wanted) rows."""
    for batch in batches:
        docs, wanted = batch.column(0).to_numpy(), batch.column(2)
        sizes, asked = pc.list_value_length(wanted).to_numpy(zero_copy_only=False), wanted.flatten()
        spots = np.repeat(np.arange(len(docs)), sizes) * (1 << LINE_BITS) + asked.field("at").to_numpy(zero_copy_only=False)
        order = np.argsort(spots)
        spots, comps = spots[order], asked.field("comp").to_numpy(zero_copy_only=False)[order]
        for sets in _line_sets(batch.column(1)):
            lines = sets.text * (1 << LINE_BITS) + sets.at
            place = np.minimum(np.searchsorted(spots, lines), len(spots) - 1)
            pick = np.flatnonzero(spots[place] == lines)
            tokens = [np.sort(sets.tokens[a:z]).tobytes() for a, z in zip(sets.starts[pick].tolist(), (sets.starts + sets.n)[pick].tolist())]
            yield _batch({"id": docs[sets.text[pick]] * (1 << LINE_BITS) + sets.at[pick], "comp": comps[place[pick]], "tokens": tokens}, TOKENS)


def earliest_in_tile(frame: pd.DataFrame, percent: int = PERCENT) -> pd.DataFrame:
    """(id, first) of the lines of (id, comp, tokens) that match one of a smaller
    id in their component, with the smallest: a prefix join that stops at it."""
    frame = frame.sort_values(["comp", "id"], ignore_index=True)
    ids, comp = frame["id"].to_numpy(np.int64), frame["comp"].to_numpy(np.int64)
    n = frame["tokens"].str.len().to_numpy(np.int64) // 8
    ends = np.cumsum(n)
    starts = ends - n
    line = np.repeat(np.arange(len(n)), n)
    turns = np.diff(comp, prepend=~comp[:1]) != 0
    heads = np.flatnonzero(turns)[np.cumsum(turns) - 1]
    _, word = np.unique(np.concatenate([np.frombuffer(t, np.uint64) for t in frame["tokens"]]), return_inverse=True)
    _, word, df = np.unique(heads[line] * (word.max() + 1) + word, return_inverse=True, return_counts=True)  # words of one component
    flag = np.zeros(len(df), bool)
    flag[word[heads[line] == line]] = True
    common = np.add.reduceat(flag[word].astype(np.int64), starts)
    # Most match the earliest line of all.
    first = np.where((100 * common >= percent * (n + n[heads] - common)) & (ids > ids[heads]), heads, -1)  # its place
    rest = np.flatnonzero((first < 0) & (ids > ids[heads]))
    if len(rest):
        flag[:] = False
        order = np.lexsort((word, df[word], line))  # rarest first
        at = np.arange(len(line)) - starts[line]
        shared = order[(at <= (n - need(n, percent))[line]) & (df[word[order]] > 1)]
        own = np.searchsorted(line[shared], np.arange(len(n) + 1))
        by_word = np.argsort(word[shared], kind="stable")
        lists, begin = line[shared][by_word], np.searchsorted(word[shared][by_word], word[shared])
        until = np.empty(len(shared), np.int64)
        until[by_word] = np.arange(len(shared))
        for x in rest.tolist():
            met = [lists[a:z] for a, z in zip(begin[own[x] : own[x + 1]].tolist(), until[own[x] : own[x + 1]].tolist()) if a < z]
            if not met:
                continue
            rows = np.unique(np.concatenate(met))
            rows = rows[(ids[rows] < ids[x]) & (100 * np.minimum(n[rows], n[x]) >= percent * np.maximum(n[rows], n[x]))]
            flag[word[starts[x] : ends[x]]] = True
            done, step = 0, 64
            while done < len(rows) and first[x] < 0:
                some = rows[done : done + step]
                sizes = n[some]
                offsets = np.cumsum(sizes) - sizes
                spots = np.repeat(starts[some] - offsets, sizes) + np.arange(int(sizes.sum()))
                common = np.add.reduceat(flag[word[spots]].astype(np.int64), offsets)
                hits = np.flatnonzero(100 * common >= percent * (n[x] + sizes - common))
                if len(hits):
                    first[x] = some[hits[0]]
                done, step = done + step, 2 * step
            flag[word[starts[x] : ends[x]]] = False
    found = np.flatnonzero(first >= 0)
    return pd.DataFrame({"id": ids[found], "first": ids[first[found]]})


def _order(found: DataFrame, owners: int) -> _Order:
    """The classes of at most the ``KNOWN`` most frequent words, and bits for all
    words of several lines. Any order of words is exact: those not known count as
    equally rare, and of single ones those that share a bit as in several lines."""
    lists = found.where("owner IS NOT NULL").select("owner", "codes", "counts")
    levels = stored(lists.groupBy("owner").applyInPandas(_owned_levels, "owner int, level int, n long, codes binary"), "word-levels")
    sizes = levels.groupBy("level").agg(F.sum("n").alias("n")).collect()  # at most 64 rows
    least, known = 64, 0
    for row in sorted(sizes, reverse=True):
        known += row["n"]
        if known > KNOWN:
            break
        least = row["level"]
    rows = levels.where(F.col("level") >= least).select("level", "codes").collect()  # at most KNOWN words
    words = [golomb.decode(r["codes"]) for r in rows]
    level = np.concatenate([np.empty(0, np.uint8), *(np.full(len(w), r["level"], np.uint8) for w, r in zip(words, rows))])
    words = np.concatenate([np.empty(0, np.uint64), *words])
    order = np.argsort(words)
    bits = max(owners.bit_length() + 2, min(BITS, (16 * sum(r["n"] for r in sizes)).bit_length()))
    part = (1 << bits) // owners // 8
    twice = np.zeros((1 << bits) // 8, np.uint8)
    for row in levels.groupBy("owner").applyInPandas(_owned_bits(owners, bits), "owner int, twice binary").collect():  # 2^BITS bits in all
        twice[row["owner"] * part : (row["owner"] + 1) * part] = np.frombuffer(row["twice"], np.uint8)
    return _Order(words[order], level[order], twice)


def _by_doc(lines: DataFrame, value: Column, name: str) -> DataFrame:
    """One row per document with a list, bounded by the document's own lines."""
    return lines.select(_doc("id").alias("doc"), value.alias("value")).groupBy("doc").agg(F.collect_set("value").alias(name))


def _later_by_words(docs: DataFrame, percent: int, id_column: str, text_column: str, block: int, owner_bytes: int, part: int) -> DataFrame:
    """(id, first) of the lines that an earlier one matches in its distinct
    words. No line's words are written but those of lines in pairs: the texts
    are read again. Pairs never become rows."""
    spark, texts = docs.sparkSession, _texts(docs, id_column, text_column)
    repeated = bool(docs.groupBy(F.col(id_column).cast("long")).count().where("count > 1").limit(1).count())
    size = texts.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    owners = 1 << min(BITS - 3, max(4, (size // owner_bytes).bit_length()))
    with small_batches(spark), passing(texts.mapInArrow(_line_keys(owners, block), LINES_SQL), "llm-line-words") as found:
        by = _order(found, owners)
        lines = found.where("id IS NOT NULL")
        heads = lines.groupBy("k0", "k1").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last")
        heads = stored(heads.select("k0", "k1", "head"), "line-heads")
        copies = stored(lines.join(checked_broadcast(heads), ["k0", "k1"]).where("id <> head").select("id", "head", "k0"), "line-copies")
    gone = _by_doc(copies, F.struct(_place("id").alias("at"), "k0"), "copies")
    with small_batches(spark):
        rows = texts.join(checked_broadcast(stored(gone, "line-gone")), "doc", "left").select("doc", "text", "copies")
        postings = rows.mapInArrow(_word_postings(percent, by, owners, max(1, block // 4)), POSTINGS_SQL)
        tied = postings.groupBy("owner").applyInPandas(_owned_links(percent, repeated), "id long, root long")
        parts = components(stored(tied, "line-ties"), "id", "root")
        # Most lines are in no pair: their tokens need not move.
        wanted = stored(_by_doc(parts.withColumnRenamed("node", "id"), F.struct(_place("id").alias("at"), F.col("root").alias("comp")), "wanted"), "lines-wanted")
        tokens = texts.join(checked_broadcast(wanted), "doc").select("doc", "text", "wanted").mapInArrow(_wanted_tokens, "id long, comp long, tokens binary")
        tokens = stored(tokens.distinct() if repeated else tokens, "line-tokens")
    weights = tokens.groupBy("comp").agg((F.sum(F.octet_length("tokens").cast("long")) / 8 / part).alias("w"))
    total = weights.agg(F.sum("w").alias("w")).first()["w"] or 0
    tiles = stored(weights.where("w > 1").select("comp", F.ceil("w").cast("int").alias("tiles")), "line-tiles")
    placed = tokens.join(checked_broadcast(tiles), "comp", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    large = F.col("tiles") > 1
    several = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).where(~large | (F.col("tile") != F.col("other")))
    bundle = F.pmod(F.xxhash64("comp"), F.lit(int(total) + 1)).cast("long")
    tasks = several.select(
        F.when(large, F.col("comp")).otherwise(bundle).alias("task"), large.alias("large"),
        F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"), "id", "comp", "tokens",
    )
    joined = tasks.groupBy("task", "large", "one", "two").applyInPandas(lambda f: earliest_in_tile(f, percent), "id long, first long")
    links = stored(joined.groupBy(F.col("id").alias("b")).agg(F.min("first").alias("first")), "line-links")
    equal = copies.join(links.withColumnRenamed("b", "head"), "head", "left").select("id", F.least("head", F.coalesce("first", "head")).alias("first"))
    return equal.unionByName(links.withColumnRenamed("b", "id")).groupBy("id").agg(F.min("first").alias("first"))


def _later_by_shingles(
    docs: DataFrame, percent: int, words: int, id_column: str, text_column: str, block: int, owner_bytes: int, part: int
) -> DataFrame:
    """(id, first) of the lines that an earlier one matches in its shingles."""
    lines = _lines(docs, id_column, text_column)
    left, digest = _sequence()
    maybe = screened(lines, words, percent, block, owner_bytes, prefix=True)
    own = _picked(docs, maybe.where("maybe").select("id"), id_column, text_column)
    # A line needs a whole shingle; shorter ones are left alone.
    own = own.where(F.size(F.split(F.btrim("text", F.lit(BLANKS)), SPACES)) >= words)
    classes = stored(own.select("id", digest).select("id", left.alias("seq")), "line-sequences")
    heads = stored(classes.groupBy("seq").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("copies")), "line-heads")
    texts = _picked(docs, heads.select(F.col("head").alias("id")), id_column, text_column)
    # Ids may repeat with other texts, so the line's own sequence is matched, too.
    texts = texts.select("id", "text", digest).withColumn("seq", left)
    texts = texts.join(heads.select(F.col("head").alias("id"), "seq", "copies"), ["id", "seq"]).dropDuplicates(["id", "seq"])
    links = linked_sets(texts.select("id", "text", "copies"), percent, words, block, owner_bytes, part)
    found = classes.join(heads, "seq").join(links.select(F.col("id").alias("head"), "first"), "head", "left")
    first = F.least("head", F.coalesce("first", "head"))
    return found.select("id", first.alias("first")).where("first < id").groupBy("id").agg(F.min("first").alias("first"))


def later_lines(
    docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id_column: str = "doc_id", text_column: str = "text",
    block: int = BLOCK, owner_bytes: int = OWNER_BYTES, part: int = PART,
) -> DataFrame:
    """(doc, line, first_doc, first_line): every line that an earlier line
    matches, with the earliest it matches directly."""
    if words == 1:  # most words occur in many lines: nothing to screen by
        earlier = _later_by_words(docs, percent, id_column, text_column, block, owner_bytes, part)
    else:
        earlier = _later_by_shingles(docs, percent, words, id_column, text_column, block, owner_bytes, part)
    return earlier.select(
        _doc("id").alias("doc"), _place("id").alias("line"), _doc("first").alias("first_doc"), _place("first").alias("first_line")
    )


def remove_repeated_lines(
    docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id_column: str = "doc_id", text_column: str = "text", **sizes: int
) -> DataFrame:
    """``docs`` without the lines that an earlier line matches, and two more
    columns: ``n_lines`` and ``removed``, the places (from 0) of lines removed.

    Lines match if 100 * common >= percent * union of their distinct shingles of
    lower-cased words; with ``words`` = 1 these are the words themselves. A line goes if any earlier line matches it, whether or not
    that one stays; earlier means a smaller id, or an earlier place in the same
    text. Lines of fewer than ``words`` words, empty ones among them, stay. A
    NULL text stays NULL with no lines; rows without an id are left as they are.
    Rows that repeat an id count as one document: their lines do not remove each
    other's, and what goes from one goes from all. Ids are whole numbers below
    2^39, lines of a text fewer than 2^24. An empty table gives no rows.
    """
    gone = later_lines(docs, percent, words, id_column, text_column, **sizes).groupBy("doc").agg(F.collect_set("line").alias("gone"))
    rows = packed(docs, leave_out=("n_lines", "removed", text_column.lower()), doc=F.col(f"`{id_column}`").cast("long"), text=F.col(f"`{text_column}`"))
    rows = rows.join(checked_broadcast(stored(gone, "gone")), "doc", "left")
    # Lines are cut once, and only where some go.
    rows = rows.withColumn("lines", F.when(F.col("gone").isNotNull(), F.split("text", "\n", -1)))
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    removed = F.coalesce(F.array_sort("gone"), F.array().cast("array<int>"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.transform(places, lambda at: F.get("lines", at))
    return rows.select(
        "own.*", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias(text_column),
        F.coalesce(n_lines, F.lit(0)).alias("n_lines"), removed.alias("removed"),
    )
