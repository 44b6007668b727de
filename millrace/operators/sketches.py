"""Aggregates from sketches that merge: distinct counts, quantiles, heavy hitters.

A sketch summarises a block of rows in bounded space. Sketches of blocks, tasks or
days merge without another look at the rows, so appended data costs one scan of
itself, and what is shuffled does not depend on the number of distinct values.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.scratch import materialize
from millrace.skew import checked_broadcast

HLL_BITS = 12  # 2^12 registers: a standard error of 1.6 %
KLL_SIZE = 400  # ranks within about 0.7 % with one sketch or many
HEAVY_COUNTERS = 4096
SLOTS = 1 << 15  # what is not proposed is counted in so many groups


# ---------------------------------------------------------------- distinct values


def distinct_sketch(column: str, kind: T.DataType, bits: int = HLL_BITS) -> Column:
    """A mergeable sketch of the distinct values that are not NULL. Types the
    sketch does not take are counted by their text."""
    c = F.col(f"`{column}`")
    taken = isinstance(kind, (T.IntegerType, T.LongType, T.StringType, T.BinaryType))
    return F.hll_sketch_agg(c if taken else c.cast("string"), F.lit(bits))


def distinct_estimates(sketches: DataFrame, columns: list[str], keys: list[str] | None = None, prefix: str = "distinct_") -> DataFrame:
    """Estimated distinct values over all blocks (or per key) from the columns
    ``distinct_c`` of their sketches. Groups without values have none."""
    estimates = [F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(f"{prefix}{c}")), F.lit(0)).alias(c) for c in columns]
    return sketches.groupBy(*(keys or [])).agg(*estimates)


# ---------------------------------------------------------------- quantiles


def quantile_sketches(df: DataFrame, keys: list[str], value: str, size: int = KLL_SIZE) -> DataFrame:
    """(keys, sketch): a KLL sketch of each group's values that are neither NULL
    nor NaN. Keep it with a block and merge it later."""
    v = F.col(f"`{value}`").cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(F.kll_sketch_agg_double(v, F.lit(size)).alias("sketch"))


def merge_quantile_sketches(sketches: DataFrame, keys: list[str], size: int = KLL_SIZE) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, points: dict[str, float]) -> DataFrame:
    """The estimated quantiles of each row's sketch: ``sketch`` becomes one column per point."""
    rest = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*rest, *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(n) for n, p in points.items()])


def rank_errors(df: DataFrame, keys: list[str], value: str, estimates: DataFrame, points: dict[str, float]) -> DataFrame:
    """(keys, point, error): how far each estimate's rank lies from the wanted one,
    as a share of the group, counted exactly in one pass."""
    v = F.col(f"`{value}`").cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).join(checked_broadcast(estimates), keys)
    below = [F.count_if(v < F.col(n)).alias(f"below_{n}") for n in points]
    upto = [F.count_if(v <= F.col(n)).alias(f"upto_{n}") for n in points]
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("all"), *below, *upto)
    one = lambda n, p: F.struct(  # noqa: E731  a value shared by many rows covers all ranks it has
        F.lit(n).alias("point"),
        (F.greatest(F.lit(0.0), F.col(f"below_{n}") - F.lit(p) * F.col("all"), F.lit(p) * F.col("all") - F.col(f"upto_{n}")) / F.col("all")).alias("error"),
    )
    return counted.select(*keys, F.inline(F.array(*[one(n, p) for n, p in points.items()])))


# ---------------------------------------------------------------- heavy hitters


def _fold(held: dict, losses: int, counters: int) -> tuple[dict, int]:
    """Misra-Gries: down to ``counters`` entries by taking the next largest count
    from all. True counts are at most ``losses`` above what is kept."""
    if len(held) <= counters:
        return held, losses
    cut = sorted(held.values(), reverse=True)[counters]
    return {k: v - cut for k, v in held.items() if v > cut}, losses + cut


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        losses = rows = 0
        for batch in batches:
            counted = pc.value_counts(batch.column(0).drop_null())
            for item, n in zip(counted.field("values").to_pylist(), counted.field("counts").to_pylist()):
                held[item] = held.get(item, 0) + n
            rows += batch.num_rows - batch.column(0).null_count
            if len(held) > 4 * counters:
                held, losses = _fold(held, losses, counters)
        held, losses = _fold(held, losses, counters)
        if rows:
            out = [(k, v, losses, 0) for k, v in held.items()] + [(None, 0, losses, rows)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["item", "kept", "lost", "rows"])

    return run


def heavy_hitters(items: DataFrame, counters: int = HEAVY_COUNTERS) -> DataFrame:
    """(item, lower, upper) of a column of texts: counts are between the two, and
    every item found more often than the summaries lost is among them.

    Each task sends at most ``counters`` entries and what it lost, however many
    distinct items there are; losses are at most rows / ``counters``.
    """
    kept = items.mapInArrow(_summaries(counters), "item string, kept long, lost long, rows long")
    # Each task's losses once: an item it does not name may have been lost there.
    summed = kept.groupBy("item").agg(F.sum("kept").alias("lower"), F.sum("lost").alias("named"))
    total = summed.where("item IS NULL").select(F.col("named").alias("all_lost"))
    return summed.where("item IS NOT NULL").crossJoin(F.broadcast(total)).selectExpr("item", "lower", "lower + all_lost AS upper")  # one row


def most_frequent(items: DataFrame, proposed: DataFrame, k: int, slots: int = SLOTS) -> DataFrame:
    """(item, frequency): the k most frequent items of a column of texts, ties by
    text. ``proposed``: a few texts (``item``) that are likely among them.

    One pass counts the proposed texts exactly and all others together per slot of
    their hash, so a task sends at most ``slots`` rows beside the proposals. A slot
    that holds less than the k-th proposal found hides nothing; items of the others
    are counted in a second pass. The proposals decide how much that is, never the result.
    """
    rows = items.select(F.col(f"`{items.columns[0]}`").alias("item")).where("item IS NOT NULL").withColumn("mark", F.xxhash64("item"))
    names = proposed.where("item IS NOT NULL").groupBy(F.xxhash64("item").alias("mark")).agg(F.min("item").alias("name"))
    names = materialize(names, "proposals")
    known = F.col("item").eqNullSafe(F.col("name"))
    beside = rows.join(checked_broadcast(names), "mark", "left").withColumn("known", known)
    slot = F.when(F.col("known"), F.col("mark")).otherwise(F.pmod("mark", F.lit(slots)))
    beside = beside.withColumn("slot", slot)
    counted = materialize(beside.groupBy("known", "slot").agg(F.count(F.lit(1)).alias("frequency")), "slots")
    found = counted.where("known").join(checked_broadcast(names), F.col("slot") == F.col("mark")).select(F.col("name").alias("item"), "frequency")
    floor = found.orderBy(F.desc("frequency")).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("frequency").alias("least")).first()
    least = floor["least"] if floor["n"] == k else 0
    left = counted.where((~F.col("known")) & (F.col("frequency") >= least)).select("slot")
    if left.limit(1).count():
        rest = beside.where("NOT known").join(checked_broadcast(left), "slot", "left_semi")
        found = found.unionByName(rest.groupBy("item").agg(F.count(F.lit(1)).alias("frequency")))
    return found.orderBy(F.desc("frequency"), "item").limit(k)


def frequent_exactly(items: DataFrame, k: int, counters: int = HEAVY_COUNTERS, some: DataFrame | None = None) -> DataFrame:
    """(item, frequency): the k most frequent items of a column of texts, ties by
    text, counted exactly. Summaries of ``some`` (a sample of the items; by default
    all of them) propose; ``most_frequent`` tells what else can be among them.
    """
    bounds = heavy_hitters(items if some is None else some, counters)
    return most_frequent(items, bounds.orderBy(F.desc("lower"), "item").limit(counters).select("item"), k)
