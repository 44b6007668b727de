"""Best-fit packing into sequences of several permitted lengths.

Documents longer than the largest length are cut into pieces of it. Best-fit
decreasing depends only on how many pieces there are of each length, so the
driver plans bins on that histogram (at most as many entries as the largest
length, however large the table): pieces go, longest first, to the fullest open
bin that holds them; where none does, a bin is opened of the length that costs
least per token, looking ahead to what is left to fill it. Bins with the same
content are planned as one entry with a count. Finally each bin shrinks to the
smallest permitted length that holds its content.

On the cluster every piece gets its rank among the pieces of its length and, by
a join with the planned intervals of ranks, its bin and offset. Ranks come from
counts by length and leading digits of a digest, so no length is sorted in one
task, not even one that a third of all pieces have.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import stored, word_count

SIZES = (512, 1024, 2048, 4096)
BUCKET_ROWS = 4096


def sequence_cost(size: int) -> float:
    """Cost of one sequence: a linear part and a quadratic one for attention."""
    return size + size * size / 8192


class _Open:
    """Open bins by free space; bins with the same content are one entry."""

    def __init__(self) -> None:
        self.spaces: list[int] = []  # ascending, those with bins
        self.at: dict[int, list[tuple[int, int, tuple]]] = {}  # space -> (count, size, items)

    def add(self, space: int, count: int, size: int, items: tuple) -> None:
        if not count:
            return
        if space not in self.at:
            self.at[space] = []
            insort(self.spaces, space)
        self.at[space].append((count, size, items))

    def take(self, length: int) -> tuple[int, int, int, tuple] | None:
        """The entry with the least space that holds ``length``."""
        i = bisect_left(self.spaces, length)
        if i == len(self.spaces):
            return None
        space = self.spaces[i]
        count, size, items = self.at[space].pop()
        if not self.at[space]:
            del self.at[space]
            self.spaces.pop(i)
        return space, count, size, items


def _filled(size: int, lengths: list[int], left: Mapping[int, int]) -> int:
    """Tokens a new bin of ``size`` would hold, always taking the longest piece that fits."""
    space, end = size, len(lengths)
    while space and end:
        end = bisect_right(lengths, space, 0, end)
        if not end:
            break
        end -= 1
        length = lengths[end]
        space -= length * min(space // length, left[length])
    return size - space


def plan_bins(
    histogram: Mapping[int, int], sizes: Sequence[int] = SIZES, cost: Callable[[int], float] = sequence_cost
) -> list[tuple[int, int, tuple[tuple[int, int], ...]]]:
    """[(bins, size, ((length, how many), …))]: every piece of the histogram in one
    bin, no bin above its size, each of the smallest permitted size that holds it."""
    sizes = sorted(set(sizes))
    if any(length < 1 or length > sizes[-1] for length in histogram):
        raise ValueError(f"lengths must lie between 1 and {sizes[-1]}")
    left = {k: v for k, v in histogram.items() if v}
    lengths = sorted(left)
    bins = _Open()
    while lengths:
        length = lengths[-1]
        n = left[length]
        while n:
            found = bins.take(length)
            if found is None:
                left[length] = n
                size = min((s for s in sizes if s >= length), key=lambda s: (cost(s) / _filled(s, lengths, left), -s))
                found = size, -(-n // (size // length)), size, ()
            space, count, size, items = found
            each = space // length  # the bin just filled stays the fullest, so it takes all it can
            whole = min(count, n // each)
            bins.add(space - each * length, whole, size, (*items, (length, each)))
            n -= whole * each
            count -= whole
            if count and 0 < n < each:
                bins.add(space - n * length, 1, size, (*items, (length, n)))
                n, count = 0, count - 1
            bins.add(space, count, size, items)
        lengths.pop()
    out = []
    for space, entries in sorted(bins.at.items()):
        for count, size, items in entries:
            used = size - space
            out.append((count, next(s for s in sizes if s >= used), items))
    return out


def _intervals(plan: list[tuple[int, int, tuple]]) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """Per length, which ranks go to which bins: (length, first, last, each, bin, offset, size, used)."""
    ranks: dict[int, int] = {}
    rows, first_bin = [], 0
    for count, size, items in plan:
        offset, used = 0, sum(length * each for length, each in items)
        for length, each in items:
            start = ranks.get(length, 0)
            ranks[length] = start + count * each
            rows.append((length, start, start + count * each - 1, each, first_bin, offset, size, used))
            offset += length * each
        first_bin += count
    return rows


def pack(
    docs: DataFrame, sizes: Sequence[int] = SIZES, cost: Callable[[int], float] = sequence_cost,
    tokens: Column | None = None, id_column: str = "doc_id",
) -> DataFrame:
    """One row per piece: id, piece (from 0), first_token (in the document),
    n_tokens, bin_id, bin_offset, bin_size, bin_used.

    Tokens are words unless ``tokens`` says otherwise. Bins are numbered from 0
    without gaps. A document without tokens (NULL or empty text) gives one row
    with no tokens and a NULL bin. Rows that repeat are packed again. Pieces of
    one length are dealt by a digest of id and piece. An empty table gives no
    rows. Other columns of ``docs`` play no part.
    """
    top = max(sizes)
    n = F.coalesce((word_count() if tokens is None else tokens).cast("long"), F.lit(0))
    base = stored(docs.select(F.col(id_column).alias("id"), n.alias("n")), "pack-tokens")
    last = F.greatest(F.ceil(F.col("n") / top) - 1, F.lit(0)).cast("int")
    cut = base.select("id", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = cut.select(
        "id", "piece", (F.col("piece") * F.lit(top)).cast("long").alias("first_token"),
        F.least(F.lit(top), F.col("n") - F.col("piece") * top).cast("long").alias("length"),
    )
    # At most one row per token count up to the largest size comes back.
    counted = pieces.where("length > 0").groupBy("length").count().collect()
    histogram = {r["length"]: r["count"] for r in counted}
    spark = docs.sparkSession
    schema = "length long, first long, last long, each long, bin long, offset long, bin_size int, bin_used int"
    slots = spark.createDataFrame(_intervals(plan_bins(histogram, sizes, cost)), schema)
    sums = spark.createDataFrame(
        [(k, max(0, math.ceil(math.log(v / BUCKET_ROWS, 16)))) for k, v in histogram.items()], "length long, digits int"
    )
    name = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("piece").cast("string"))
    # Both tables are bounded by the largest size, so they are copied.
    keyed = pieces.withColumn("digest", F.md5(name.cast("binary"))).join(F.broadcast(sums), "length")
    keyed = keyed.withColumn("bucket", F.substring("digest", F.lit(1), F.col("digits"))).drop("digits")
    buckets = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("here"))
    before = F.sum("here").over(Window.partitionBy("length").orderBy("bucket")) - F.col("here")
    starts = buckets.select("length", "bucket", before.alias("start"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("digest", "id")) - 1
    ranked = keyed.withColumn("inside", inside).join(starts, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("start") + F.col("inside")).alias("p")
    s = F.broadcast(slots).alias("s")
    match = (F.col("p.length") == F.col("s.length")) & F.col("p.rank").between(F.col("s.first"), F.col("s.last"))
    place = F.col("rank") - F.col("first")
    packed = ranked.join(s, match).select(
        F.col("id").alias(id_column), "piece", "first_token", F.col("p.length").alias("n_tokens"),
        (F.col("bin") + F.expr("(rank - first) div each")).alias("bin_id"),
        (F.col("offset") + place % F.col("each") * F.col("p.length")).alias("bin_offset"), "bin_size", "bin_used",
    )
    empty = pieces.where("length = 0").select(F.col("id").alias(id_column), "piece", "first_token", F.col("length").alias("n_tokens"))
    return packed.unionByName(empty, allowMissingColumns=True)
