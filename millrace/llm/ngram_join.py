"""Documents that share most of their five-word shingles, by a grouped prefix join.

Documents are sets of distinct shingles; two are linked if their Jaccard
similarity reaches ``percent`` / 100. Steps, each exact:

1. Shingles seen once cannot be shared. Input partitions send, per block of
   documents and owner (a range of hashes), the distinct shingles of the lower
   half of the hash space as sorted gaps of about two bytes; owners answer with one bit
   each, set if the shingle occurs again. Of a document's m shingles in that half
   at least m - (n - need) must be shared, need being ceil(percent * n / 100);
   documents below that have no link and are done.
2. What is left is reduced to one document per word sequence, and its shingles
   are ordered by rising document frequency (exchanged the same way).
3. Documents with the same size and the same prefix (the n - need + 1 rarest
   shingles) form a group. Groups that share a prefix shingle are candidates; the
   components of that relation cut the work into independent parts.
4. A task gets many small parts, or two tiles of a large one. It joins groups by
   their prefixes with length and overlap filters, expands the group pairs that
   pass and verifies the members by counting common shingles. Only each
   document's root and number of links leave the task, never pairs.
5. Components of the roots give the result.

Shingles are 64-bit hashes of lower-cased words; sets are compared by them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SPACES, ascii_lower, rows_with, small_batches, stored, text_of
from millrace.llm.components import components
from millrace.scratch import passing

WORDS = 5
PERCENT = 75
BLOCK = 1_000_000  # shingles of a block of documents
OWNER_BYTES = 8_000_000  # bytes of text for each owner of hashes
PART = 500_000  # shingles that one task joins; larger parts are tiled
CHUNK = 1_000_000  # bytes of text hashed at a time
SHORT = 40  # leading bits of a shingle by which its frequency is counted

_P, _MULT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEPS = np.array([pow(0xD6E8FEB86659FD93, 2 * k + 1, 1 << 64) for k in range(16)], dtype=np.uint64)
_powers: list[np.ndarray] = []


def need(n, percent: int = PERCENT):
    """Fewest shingles a set of n shares with any set it is linked to."""
    return (percent * n + 99) // 100


def need_pair(n, m, percent: int = PERCENT):
    """Fewest common shingles of linked sets of n and m: 100 c >= percent (n + m - c)."""
    return (percent * (n + m) + 99 + percent) // (100 + percent)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * _MULT
    h ^= h >> np.uint64(29)
    h = h * _P
    return h ^ (h >> np.uint64(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        up, down = np.full(size, _P), np.full(size, _INV)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash in lower case) of each word of a chunk; ``ends`` are text ends in ``data``."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    b = data + (((data >= 65) & (data <= 90)) * np.uint8(32))
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.zeros(len(b) + 1, bool)
    edge[np.concatenate(([0], ends))] = True
    word = ~space
    before = np.concatenate(([True], space[:-1])) | edge[:-1]
    after = np.concatenate((space[1:], [True])) | edge[1:]
    starts, stops = np.flatnonzero(word & before), np.flatnonzero(word & after)
    up, down = _power_tables(len(b))
    sums = np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], dtype=np.uint64)
    prior = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    return starts, _mixed((sums[stops] - prior) * down[starts])


def _hash_chunk(data: np.ndarray, ends: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a chunk; ``ends`` are text ends in ``data``."""
    empty = np.empty(0, np.uint64)
    if not len(data):
        return [empty] * len(ends)
    starts, hashes = word_hashes(data, ends)
    cuts = np.searchsorted(starts, np.concatenate(([0], ends)))
    rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        rolled += hashes[k : k + len(rolled)] * _STEPS[k]
    rolled = _mixed(rolled)
    out = []
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        n = z - a
        if n >= words:
            part = np.sort(rolled[a : z - words + 1])
            keep = np.ones(len(part), bool)
            np.not_equal(part[1:], part[:-1], out=keep[1:])
            out.append(part[keep])
        elif n:
            short = (hashes[a:z] * _STEPS[:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append(_mixed(np.array([short], np.uint64)))
        else:
            out.append(empty)
    return out


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, text ends in them) of about ``CHUNK`` bytes of texts each."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first + 1 : last + 1] - offsets[first]
        first = last


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text. A text of fewer words gives
    its whole sequence as one, a text without words (or NULL) none."""
    for _, data, ends in chunks(texts):
        yield from _hash_chunk(data, ends, words)


def _pack_gaps(values: np.ndarray) -> bytes:
    """Ascending integers as gaps of the fewest bytes that hold the largest."""
    gaps = np.diff(values, prepend=np.uint64(0))
    top = int(gaps.max()) if len(gaps) else 0
    kind = 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([kind]) + gaps.astype(f"u{kind}").tobytes()


def _unpack_gaps(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, f"u{blob[0]}", offset=1), dtype=np.uint64)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


def _flags(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n, bitorder="little").astype(bool)


def _owners(values: np.ndarray, width: int, owners: int) -> list[tuple[int, int, int]]:
    """(owner, first, last + 1) of the runs of ascending values of ``width`` bits."""
    low = max(0, width - 32)
    owner = (((values >> np.uint64(low)) * np.uint64(owners)) >> np.uint64(width - low)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(owner, prepend=-1))
    return list(zip(owner[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(values)]))


def _batch(columns: dict, schema: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in schema.items()], names=list(schema))


BLOCKS = {"sender": pa.int32(), "block": pa.int32(), "owner": pa.int32(), "codes": pa.binary(), "twice": pa.binary(),
          "firsts": pa.binary(), "docs": pa.binary(), "ids": pa.binary(), "sizes": pa.binary()}
BLOCKS_SQL = "sender int, block int, owner int, codes binary, twice binary, firsts binary, docs binary, ids binary, sizes binary"


def _send_blocks(words: int, width: int, owners: int, block: int, percent: int, prefix: bool):
    """Map side of step 1: blocks of (id, text) rows, one message per owner. The
    hashes sent are those of the lower half, or each set's n - need + 1 smallest."""
    top = np.uint64(1 << 63)

    def chosen(hashes: np.ndarray) -> tuple[np.ndarray, int]:
        """(the hashes that are sent, how many of them must be shared)"""
        n = len(hashes)
        if prefix:
            return hashes[: n - need(n, percent) + 1], min(n, 1)
        lower = hashes[: np.searchsorted(hashes, top)]
        return lower, max(0, len(lower) - (n - need(n, percent)))

    def message(sender: int, number: int, ids: list[int], sets: list[np.ndarray], sizes: list[tuple]) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in BLOCKS}

        def row(**values) -> None:
            for k in out:
                out[k].append(values.get(k))

        sent = np.array([len(s) for s in sets], np.int64)
        row(sender=sender, block=number, owner=-1, ids=np.array(ids, np.int64).tobytes(),
            sizes=np.array(sizes, np.uint32).tobytes())
        tokens = _mixed(np.concatenate(sets)) >> np.uint64(64 - width)  # mixed again, so that owners get equal shares
        kind = "u2" if len(ids) < 1 << 16 else "u4"
        where = np.repeat(np.arange(len(ids), dtype=kind), sent)
        order = np.argsort(tokens, kind="stable")
        tokens, where = tokens[order], where[order]
        firsts = np.diff(tokens, prepend=~tokens[:1]) != 0
        places = np.flatnonzero(firsts)
        distinct = tokens[places]
        counts = np.diff(places, append=len(tokens))
        for owner, a, z in _owners(distinct, width, owners):
            i, j = places[a], places[z] if z < len(places) else len(tokens)
            row(sender=sender, block=number, owner=owner, codes=_pack_gaps(distinct[a:z]), twice=_bits(counts[a:z] > 1),
                firsts=_bits(firsts[i:j]), docs=kind.encode() + where[i:j].tobytes())
        return _batch(out, BLOCKS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sender, number, held = TaskContext.get().partitionId(), 0, 0
        ids: list[int] = []
        sets: list[np.ndarray] = []
        sizes: list[tuple[int, int]] = []
        for batch in batches:
            for doc, hashes in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), words)):
                sent, must = chosen(hashes)
                ids.append(doc)
                sizes.append((len(hashes), must))
                sets.append(sent)
                held += len(sent)
                if held >= block or len(ids) == (1 << 16) - 1:  # places in a block fit two bytes
                    yield message(sender, number, ids, sets, sizes)
                    ids, sets, sizes, held, number = [], [], [], 0, number + 1
        if ids:
            yield message(sender, number, ids, sets, sizes)

    return send


def _again(lists: pd.DataFrame) -> pd.DataFrame:
    """Owner side of step 1: a bit per shingle of each list, set if it occurs twice anywhere."""
    codes = [_unpack_gaps(c) for c in lists["codes"]]
    sizes = [len(c) for c in codes]
    whole = np.concatenate(codes)
    order = np.argsort(whole, kind="stable")
    ranked = whole[order]
    same = np.zeros(len(whole) + 1, bool)
    np.equal(ranked[1:], ranked[:-1], out=same[1:-1])
    shared = np.empty(len(whole), bool)
    shared[order] = same[1:] | same[:-1]
    parts = np.split(shared, np.cumsum(sizes)[:-1])
    bits = [_bits(p | _flags(t, len(p))) for p, t in zip(parts, lists["twice"])]
    return lists[["sender", "block", "owner"]].assign(bits=bits)


def _count_shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sender side: how many shared shingles each document of a block has, per owner."""
    for frame in batches:
        counts = []
        for docs, firsts, bits in zip(frame["docs"], frame["firsts"], frame["bits"]):
            where = np.frombuffer(docs, docs[:2].decode(), offset=2)
            place = np.cumsum(_flags(firsts, len(where))) - 1
            shared = _flags(bits, int(place[-1]) + 1)[place]
            counts.append(zlib.compress(np.bincount(where[shared]).astype(np.uint32).tobytes(), 1))
        yield frame[["sender", "block"]].assign(counts=counts, ids=None, sizes=None)


def _decide(rows: pd.DataFrame) -> pd.DataFrame:
    head = rows[rows["ids"].notna()].iloc[0]
    ids = np.frombuffer(head["ids"], np.int64)
    n, must = np.frombuffer(head["sizes"], np.uint32).astype(np.int64).reshape(-1, 2).T
    shared = np.zeros(len(ids), np.int64)
    for blob in rows["counts"].dropna():
        part = np.frombuffer(zlib.decompress(blob), np.uint32)
        shared[: len(part)] += part
    return pd.DataFrame({"id": ids, "n_shingles": n, "maybe": (n > 0) & (shared >= must)})


def screened(docs: DataFrame, words: int, percent: int, block: int, owner_bytes: int, prefix: bool = False) -> DataFrame:
    """(id, n_shingles, maybe) of every (id, text) row; without ``maybe`` it has no link.

    Whole texts send the lower half of their hashes: much is shared by chance or
    in common passages, and the count of shared ones rules that out. With
    ``prefix``, for short texts, each set sends its n - need + 1 smallest hashes,
    of which linked sets have one in common: half as many.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    owners = max(16, -(-size // owner_bytes))
    width = min(63, max(32, (size // 4).bit_length() + 6))
    with small_batches(docs.sparkSession):
        sent = stored(docs.mapInArrow(_send_blocks(words, width, owners, block, percent, prefix), BLOCKS_SQL), "shingles")
    lists = sent.where("owner >= 0")
    answers = lists.select("sender", "block", "owner", "codes", "twice").groupBy("owner").applyInPandas(
        _again, "sender int, block int, owner int, bits binary"
    )
    told = lists.select("sender", "block", "owner", "docs", "firsts").join(answers, ["sender", "block", "owner"])
    counted = told.mapInPandas(_count_shared, "sender int, block int, counts binary, ids binary, sizes binary")
    heads = sent.where("owner < 0").selectExpr("sender", "block", "cast(null as binary) AS counts", "ids", "sizes")
    return stored(
        counted.unionByName(heads).groupBy("sender", "block").applyInPandas(_decide, "id long, n_shingles long, maybe boolean"),
        "screened",
    )


SETS_SQL = "sender int, block int, ids binary, copies binary, sizes binary, tokens binary"
SETS = {"sender": pa.int32(), "block": pa.int32(), "ids": pa.binary(), "copies": pa.binary(), "sizes": pa.binary(), "tokens": pa.binary()}


def _set_blocks(words: int, block: int):
    """Blocks of the sets of (id, text, copies) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sender, number, held = TaskContext.get().partitionId(), 0, 0
        rows: list[tuple[int, int, np.ndarray]] = []

        def full() -> pa.RecordBatch:
            ids, copies = (np.array([r[k] for r in rows], np.int64).tobytes() for k in (0, 1))
            sizes = np.array([len(r[2]) for r in rows], np.uint32).tobytes()
            tokens = np.concatenate([r[2] for r in rows]).tobytes()
            values = {"sender": [sender], "block": [number], "ids": [ids], "copies": [copies], "sizes": [sizes], "tokens": [tokens]}
            return _batch(values, SETS)

        for batch in batches:
            for doc, copies, hashes in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle_sets(batch.column(1), words)):
                rows.append((doc, copies, hashes))
                held += len(hashes)
                if held >= block:
                    yield full()
                    rows, held, number = [], 0, number + 1
        if rows:
            yield full()

    return run


def _short(tokens: np.ndarray) -> np.ndarray:
    """Leading bits, by which frequencies are counted: a function of the shingle, so any order by it is total."""
    return tokens >> np.uint64(64 - SHORT)


def _send_tokens(owners: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for sender, block, tokens in zip(frame["sender"], frame["block"], frame["tokens"]):
                distinct, counts = np.unique(_short(np.frombuffer(tokens, np.uint64)), return_counts=True)
                rows = [
                    (sender, block, o, _pack_gaps(distinct[a:z]), zlib.compress(counts[a:z].astype(np.uint32).tobytes(), 1))
                    for o, a, z in _owners(distinct, SHORT, owners)
                ]
                yield pd.DataFrame(rows, columns=["sender", "block", "owner", "codes", "counts"])

    return run


def _frequencies(lists: pd.DataFrame) -> pd.DataFrame:
    """Owner side of step 2: bit length of each shingle's document frequency less one (0: seen once)."""
    codes = [_unpack_gaps(c) for c in lists["codes"]]
    counts = np.concatenate([np.frombuffer(zlib.decompress(c), np.uint32) for c in lists["counts"]])
    _, place = np.unique(np.concatenate(codes), return_inverse=True)
    df = np.bincount(place, weights=counts).astype(np.int64) - 1
    level = np.frexp(df.astype(np.float64))[1].astype(np.uint8)[place]
    parts = np.split(level, np.cumsum([len(c) for c in codes])[:-1])
    return lists[["sender", "block", "owner"]].assign(levels=[zlib.compress(p.tobytes(), 1) for p in parts])


ORDERED = "id long, copies long, n int, skip int, g long, gkey binary, tokens binary"


def _ordered(percent: int):
    """Rare shingles first: (id, n, how many are seen once, group key, tokens in order)."""

    def run(blocks: pd.DataFrame, levels: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in blocks.itertuples():
            tokens = np.frombuffer(row.tokens, np.uint64)
            short = _short(tokens)
            distinct = np.unique(short)
            level = np.concatenate([
                np.frombuffer(zlib.decompress(x), np.uint8) for x in levels.sort_values("owner")["levels"]
            ]) if len(levels) else np.empty(0, np.uint8)
            own = level[np.searchsorted(distinct, short)]
            sizes = np.frombuffer(row.sizes, np.uint32)
            ends = np.cumsum(sizes)
            for doc, copies, n, end in zip(np.frombuffer(row.ids, np.int64), np.frombuffer(row.copies, np.int64), sizes.tolist(), ends.tolist()):
                part, ranks = tokens[end - n : end], own[end - n : end]
                skip = int((ranks == 0).sum())
                if n - skip < need(n, percent):
                    continue  # too few shared shingles for any link
                part = part[np.argsort(ranks, kind="stable")]  # equal ranks stay in the order of hashes
                prefix = part[: n - need(n, percent) + 1]
                key = hashlib.blake2b(prefix.tobytes() + n.to_bytes(4, "little"), digest_size=16).digest()
                out.append((int(doc), int(copies), n, skip, int.from_bytes(key[:8], "little", signed=True), key, part.tobytes()))
        return pd.DataFrame(out, columns=["id", "copies", "n", "skip", "g", "gkey", "tokens"])

    return run


def _postings(percent: int):
    """(token, g) of the shared prefix shingles of each set's group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            parts = [
                np.frombuffer(tokens, np.int64)[skip : n - need(n, percent) + 1]
                for n, skip, tokens in zip(frame["n"].tolist(), frame["skip"].tolist(), frame["tokens"])
            ]
            if parts:
                yield pd.DataFrame({"token": np.concatenate(parts), "g": np.repeat(frame["g"].to_numpy(), [len(x) for x in parts])})

    return run


def join_tile(frame: pd.DataFrame, percent: int = PERCENT) -> pd.DataFrame:
    """(id, root, links, first) of the documents of one task: the grouped prefix join.

    ``first`` is the smallest id linked directly, if any. ``frame`` has id, copies, n, skip, gkey, tokens and tile; ``one`` and ``two``
    name the tiles that meet here (equal: all pairs inside).
    """
    frame = frame.sort_values(["n", "gkey", "id"], ignore_index=True)
    sets = [np.frombuffer(t, np.uint64) for t in frame["tokens"]]
    n = frame["n"].to_numpy(np.int64)
    ids, copies = frame["id"].to_numpy(np.int64), frame["copies"].to_numpy(np.int64)
    skip, tile = frame["skip"].to_numpy(np.int64), frame["tile"].to_numpy(np.int64)
    one, two = int(frame["one"].iloc[0]), int(frame["two"].iloc[0])
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(n)
    starts = ends - n
    # Groups: consecutive rows of the same size and prefix.
    key = frame["gkey"].tolist()
    cuts = np.flatnonzero([i == 0 or key[i] != key[i - 1] for i in range(len(key))])
    stops = np.append(cuts[1:], len(frame))
    p = n - need(n, percent) + 1
    index: dict[int, list[int]] = {}
    parent = list(range(len(frame)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = np.zeros(len(frame), np.int64)
    none = np.iinfo(np.int64).max
    first = np.full(len(frame), none)
    flag = np.zeros(int(local.max()) + 1 if len(local) else 0, bool)
    for g, (a, z) in enumerate(zip(cuts.tolist(), stops.tolist())):
        size = n[a]
        prefix = local[starts[a] + skip[a] : starts[a] + p[a]].tolist()
        lists = [index[t] for t in prefix if t in index]
        candidates = np.empty(0, np.int64)
        if lists:
            hits = np.bincount(np.concatenate([np.asarray(x) for x in lists]), minlength=g)
            candidates = np.flatnonzero(hits)
            heads = cuts[candidates]
            m = n[heads]
            # Length filter, and overlap: beyond the common prefix shingles at most the longer remainder can be shared.
            rest = np.maximum(size - p[a], m - p[heads])
            fits = (m >= need(size, percent)) & (hits[candidates] + rest >= need_pair(size, m, percent))
            candidates = candidates[fits]
        members = [np.arange(cuts[c], stops[c]) for c in candidates.tolist()]
        others = np.concatenate(members) if members else np.empty(0, np.int64)
        for x in range(a, z):  # expand: this group's members against the others' and one another
            rows = np.concatenate((others, np.arange(a, x)))
            if one != two:
                rows = rows[tile[rows] != tile[x]]
            if not len(rows):
                continue
            own = local[starts[x] : ends[x]]
            flag[own] = True
            lengths = n[rows]
            offsets = np.cumsum(lengths) - lengths
            spots = np.repeat(starts[rows] - offsets, lengths) + np.arange(int(lengths.sum()))
            common = np.add.reduceat(flag[local[spots]].astype(np.int64), offsets)
            flag[own] = False
            linked = rows[100 * common >= percent * (size + lengths - common)]
            if len(linked):
                links[x] += copies[linked].sum()
                links[linked] += copies[x]
                first[x] = min(first[x], ids[linked].min())
                first[linked] = np.minimum(first[linked], ids[x])
                root = find(x)
                for y in linked.tolist():
                    r = find(y)
                    if r != root:
                        parent[max(r, root)] = min(r, root)
                        root = min(r, root)
        for t in prefix:
            index.setdefault(t, []).append(g)
    least = {}
    roots = [find(x) for x in range(len(frame))]
    for x, r in enumerate(roots):
        least[r] = min(least.get(r, ids[x]), ids[x])
    seen = pd.array(np.where(first == none, 0, first), dtype="Int64")
    seen[first == none] = pd.NA
    return pd.DataFrame({"id": ids, "root": [least[r] for r in roots], "links": links, "first": seen})


def _sequence(words: str = "text") -> Column:
    """Digest of the word sequence: equal words, equal sets."""
    trimmed = F.regexp_replace(ascii_lower(F.col(words)), f"^{SPACES}|{SPACES}$", "")
    return F.sha2(F.regexp_replace(trimmed, SPACES, " ").cast("binary"), 256)


def similar_documents(
    docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id_column: str = "doc_id", text_column: str = "text",
    block: int = BLOCK, owner_bytes: int = OWNER_BYTES, part: int = PART,
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, n_links.

    Links join documents with 100 * common >= percent * union of their distinct
    shingles; ``component_id`` is the smallest id reachable, ``n_links`` the
    number of other documents linked directly. Texts of fewer words are one
    shingle; texts without words, or NULL, are linked with nothing. Ids are whole
    numbers; rows that repeat an id and its text count as copies of each other,
    and get the smallest component and the largest number of links of their id.
    Rows without an id take no part in links and have a NULL component. An empty
    table gives no rows. Other columns of ``docs`` play no part.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
    known, unknown = rows.where("id IS NOT NULL"), rows.where("id IS NULL")
    sizes = screened(known, words, percent, block, owner_bytes)
    maybe = rows_with(known, sizes.where("maybe").select("id").distinct(), ["id"])
    classes = stored(maybe.where(F.trim(F.regexp_replace("text", SPACES, " ")) != "").select("id", _sequence().alias("seq")), "sequences")
    heads = stored(classes.groupBy("seq").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("copies")), "heads")
    # The head's own row: ids may repeat with other texts, so the sequence is matched, too.
    keys = heads.select(F.col("head").alias("id"), "seq", "copies")
    texts = rows_with(known, keys.select("id"), ["id"]).withColumn("seq", _sequence())
    texts = texts.join(keys, ["id", "seq"]).dropDuplicates(["id", "seq"]).select("id", "text", "copies")
    labels = linked_sets(texts, percent, words, block, owner_bytes, part)
    tied = classes.join(heads, "seq").join(labels.withColumnRenamed("id", "head"), "head", "left")
    found = tied.groupBy("id").agg(
        F.min(F.coalesce("root", "head")).alias("component_id"),
        F.max(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    out = sizes.join(found, "id", "left").select(
        F.col("id").alias(id_column), "n_shingles", F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
    if unknown.limit(1).count():
        size_of = screened(unknown.withColumn("id", F.lit(0).cast("long")), words, percent, block, owner_bytes)
        out = out.unionByName(size_of.select(
            F.lit(None).cast("long").alias(id_column), "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(0).cast("long").alias("n_links"),
        ))
    return out


def ordered_sets(texts: DataFrame, percent: int, words: int, block: int, owner_bytes: int) -> DataFrame:
    """Step 2 for (id, text, copies) rows: their shingles by rising frequency;
    sets with too few shared shingles for any link are left out."""
    with ExitStack() as held:
        with small_batches(texts.sparkSession):
            sets = held.enter_context(passing(texts.mapInArrow(_set_blocks(words, max(1, block // 2)), SETS_SQL), "llm-sets"))
        size = sets.agg(F.sum(F.length("tokens")).alias("b")).first()["b"] or 0
        owners = max(16, -(-size // owner_bytes))
        sent = sets.select("sender", "block", "tokens").mapInPandas(
            _send_tokens(owners), "sender int, block int, owner int, codes binary, counts binary"
        )
        levels = sent.groupBy("owner").applyInPandas(_frequencies, "sender int, block int, owner int, levels binary")
        return stored(
            sets.groupBy("sender", "block").cogroup(levels.groupBy("sender", "block")).applyInPandas(_ordered(percent), ORDERED),
            "ordered",
        )


def linked_sets(texts: DataFrame, percent: int, words: int, block: int, owner_bytes: int, part: int) -> DataFrame:
    """Steps 2 to 5 for (id, text, copies) rows with different word sequences:
    (id, root, links, first) of those that have a candidate, once each."""
    ordered = ordered_sets(texts, percent, words, block, owner_bytes)
    postings = ordered.select("n", "skip", "g", "tokens").mapInPandas(_postings(percent), "token long, g long")
    postings = stored(postings.distinct(), "postings")  # members of a group post the same
    shared = postings.groupBy("token").agg(F.min("g").alias("low"), F.count(F.lit(1)).alias("k")).where("k > 1")
    edges = postings.join(shared, "token").where("g <> low").select(F.col("g").alias("a"), F.col("low").alias("b")).distinct()
    parts = components(edges).withColumnRenamed("node", "g")
    sized = ordered.groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("n").cast("long")).alias("w"))
    sized = sized.join(parts, "g", "left").select("g", F.coalesce("root", "g").alias("comp"), "k", "w")
    sized = stored(sized, "group-parts")
    weights = sized.groupBy("comp").agg(F.sum("k").alias("k"), F.sum("w").alias("w")).where("k > 1")
    weights = stored(weights.select("comp", "w", F.ceil(F.col("w") / part).cast("int").alias("tiles")), "parts")
    total = weights.agg(F.sum("w").alias("w")).first()["w"] or 0
    where = sized.select("g", "comp").join(weights.select("comp", "tiles"), "comp")
    placed = ordered.join(where, "g").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    bundle = F.pmod(F.xxhash64("comp"), F.lit(max(1, -(-total // part)))).cast("long")
    several = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    large = F.col("tiles") > 1
    tasks = several.select(
        F.when(large, F.col("comp")).otherwise(bundle).alias("task"), large.alias("large"), F.least("tile", "other").alias("one"),
        F.greatest("tile", "other").alias("two"), "id", "copies", "n", "skip", "gkey", "tokens", "tile",
    )
    joined = stored(
        tasks.groupBy("task", "large", "one", "two").applyInPandas(
            lambda f: join_tile(f, percent), "id long, root long, links long, first long"
        ),
        "joined",
    )
    if not weights.where("tiles > 1").limit(1).count():
        return joined
    # Tiles of a large part met in several tasks: their roots are tied together.
    each = joined.groupBy("id").agg(F.sum("links").alias("links"), F.min("first").alias("first"))
    roots = components(joined.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    return stored(
        each.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"), "links", "first"),
        "labels",
    )
