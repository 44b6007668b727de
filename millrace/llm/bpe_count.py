"""Token counts by byte-pair merging with a heap over a linked list.

A text is cut at the special strings, then into pieces by the vocabulary's
pattern. Each piece starts as one symbol per byte; the adjacent pair with the
lowest rank is merged again and again, the leftmost first among equal ranks. The
count of a piece is its bytes less its merges. No identifiers are made.

Counts of pieces are kept per Python worker, since words repeat far more often
than not: two tables of at most ``KEPT`` entries, the older one given up when the
younger is full. The driver reads the vocabulary once and broadcasts its merges,
a table of fixed size.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

#: How byte-level vocabularies cut a text before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT = 800_000
LONG = 64  # longer pieces are counted each time, not kept
SHIFT = 32
MASK = (1 << SHIFT) - 1


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def load(path: str) -> dict:
    """Merges and special strings of a byte-level BPE file: ``pairs`` (left << 32 |
    right) and ``merged`` by rank, ``bytes`` (symbol of each byte), ``special``."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    vocab = whole["model"]["vocab"]
    pairs, merged = [], []
    for pair in whole["model"]["merges"]:
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        pairs.append(vocab[left] << SHIFT | vocab[right])
        merged.append(vocab[left + right])
    special = [t["content"] for t in whole.get("added_tokens", [])]
    return {"pairs": pairs, "merged": merged, "bytes": [vocab[c] for _, c in sorted(byte_symbols().items())], "special": special}


def piece_counter(model: dict) -> Callable[[bytes], int]:
    """A function from the bytes of a piece to its number of tokens."""
    first, pair_of, merged_of = model["bytes"], model["pairs"], model["merged"]
    look = {pair: rank for rank, pair in reversed(list(enumerate(pair_of)))}.get  # the first rank of a pair counts

    def count(piece: bytes) -> int:
        n = len(piece)
        if n < 2:
            return n
        symbols = [first[b] for b in piece]
        # Heap entries are rank << SHIFT | place of the left symbol: the lowest rank, then the leftmost.
        heap = []
        left = symbols[0]
        for i in range(1, n):
            right = symbols[i]
            rank = look(left << SHIFT | right)
            if rank is not None:
                heap.append(rank << SHIFT | i - 1)
            left = right
        if not heap:
            return n
        heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        left_over = n
        while heap:
            entry = heappop(heap)
            i = entry & MASK
            j = after[i]
            rank = entry >> SHIFT
            # Stale: one side was merged away or has become another symbol.
            if j >= n or symbols[i] << SHIFT | symbols[j] != pair_of[rank]:
                continue
            merged = merged_of[rank]
            symbols[i] = merged
            symbols[j] = -1
            left_over -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = look(merged << SHIFT | symbols[k])
                if rank is not None:
                    heappush(heap, rank << SHIFT | i)
            h = before[i]
            if h >= 0:
                rank = look(symbols[h] << SHIFT | merged)
                if rank is not None:
                    heappush(heap, rank << SHIFT | h)
        return left_over

    return count


def text_counter(model: dict, kept: int = KEPT) -> Callable[[str], int]:
    """A function from a text to its number of tokens; special strings count one each."""
    import regex

    pieces_of = regex.compile(PATTERN).findall
    special = sorted((s for s in model["special"] if s), key=len, reverse=True)
    cut = regex.compile("|".join(map(regex.escape, special))).split if special else None
    count = piece_counter(model)
    young: dict[str, int] = {}
    old: dict[str, int] = {}

    def pieces(text: str) -> int:
        nonlocal young, old
        total = 0
        get = young.get
        for piece in pieces_of(text):
            n = get(piece)
            if n is None:
                n = old.get(piece)
                if n is None:
                    raw = piece.encode("utf-8", "surrogatepass")
                    n = count(raw)
                if len(piece) <= LONG:
                    if len(young) >= kept:
                        young, old = {}, young
                        get = young.get
                    young[piece] = n
            total += n
        return total

    def whole(text: str) -> int:
        if cut is None:
            return pieces(text)
        parts = cut(text)
        return len(parts) - 1 + sum(pieces(p) for p in parts if p)

    return whole


_counters: dict[str, Callable[[str], int]] = {}  # of this worker, by vocabulary


def count_tokens(
    docs: DataFrame, path: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``path`` is a byte-level BPE file as the ``tokenizers`` library reads it. No
    begin, end or added special tokens; special strings inside a text are one
    token each. A NULL text counts as empty, an empty text has no tokens, texts
    are never cut. Rows that repeat are counted again; an empty table gives no
    rows. Other columns of ``docs`` play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _counters:
            _counters.clear()
            _counters[key] = text_counter(shared.value)
        whole = _counters[key]
        for batch in batches:
            sizes, tokens = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                sizes.append(len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass")))
                tokens.append(whole(text))
            over = pa.array([t > limit for t in tokens], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), over],
                names=[id_column, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select(id_column, text_column).mapInArrow(run, schema)
