"""Join forms beyond a plain ``DataFrame.join``."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.scratch import materialize
from millrace.skew import (
    LEFT_SALT,
    LEFT_WAYS,
    RIGHT_SALT,
    RIGHT_WAYS,
    _marked,
    _marks,
    _spread,
    checked_broadcast,
    fits_broadcast,
    hot_keys,
    skew_join,
)

# What stands for NULL beside the flag that says so; any value of the type does.
FILLERS = {
    T.StringType: "", T.BinaryType: b"", T.BooleanType: False, T.ByteType: 0, T.ShortType: 0, T.IntegerType: 0, T.LongType: 0,
    T.DecimalType: 0, T.FloatType: 0.0, T.DoubleType: 0.0, T.DateType: datetime.date(1970, 1, 1),
    T.TimestampType: datetime.datetime(1970, 1, 1), T.TimestampNTZType: datetime.datetime(1970, 1, 1),
}


def null_safe_join(
    left: DataFrame, right: DataFrame, pairs: dict[str, str], how: str = "inner", hot_rows: int | None = None,
    unique_right: bool = False,
) -> DataFrame:
    """Join on ``<=>`` for each (left column, right column): NULL matches NULL.

    Each key column becomes a pair of columns, is NULL or not and its value or a
    filler, which an ordinary join compares; so hot keys, NULL among them, are
    split like any other. The sides' columns must not share names. Arrays and
    structs, and pairs of different types, are left to Spark's own comparison.
    """
    keys = [f"_key_{i}{part}" for i in range(len(pairs)) for part in ("n", "v")]
    kinds = [left.schema[a].dataType for a in pairs]
    if not all(k == right.schema[b].dataType and type(k) in FILLERS for k, b in zip(kinds, pairs.values())):
        cond = reduce(lambda x, y: x & y, [left[a].eqNullSafe(right[b]) for a, b in pairs.items()])
        return left.join(right, cond, how)

    def keyed(df: DataFrame, names: list[str]) -> DataFrame:
        cols = []
        for i, (name, kind) in enumerate(zip(names, kinds)):
            c = F.col(f"`{name}`")
            cols += [c.isNull().alias(f"_key_{i}n"), F.coalesce(c, F.lit(FILLERS[type(kind)]).cast(kind)).alias(f"_key_{i}v")]
        return df.select("*", *cols)

    joined = skew_join(keyed(left, list(pairs)), keyed(right, list(pairs.values())), keys, how, hot_rows, unique_right=unique_right)
    return joined.drop(*keys)


def outer_join_with_filters(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str,
    left_on: Column | None = None,
    right_on: Column | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Outer join with one-sided conditions in the ON clause: a row that fails
    its condition stays, unmatched, where its side is the outer one.

    Such rows get NULL join keys, which match nothing. The sides' other columns
    must not share names; the join keys themselves are not part of the result.
    """
    masked = [f"_on_{k}" for k in keys]

    def mask(df: DataFrame, on: Column | None) -> DataFrame:
        cols = [F.when(on, F.col(k)) if on is not None else F.col(k) for k in keys]
        return df.select("*", *[c.alias(m) for c, m in zip(cols, masked)]).drop(*keys)

    return skew_join(mask(left, left_on), mask(right, right_on), masked, how, hot_rows).drop(*masked)


def map_join(fact: DataFrame, dimension: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Broadcast join if the dimension's measured size allows it, else a
    shuffled join that splits hot keys."""
    side = checked_broadcast(dimension)
    if side is dimension:
        return skew_join(fact, dimension, keys, how)
    return fact.join(side, keys, how)


def cross_with_one_row(df: DataFrame, single: DataFrame) -> DataFrame:
    """Cross join with a table of at most one row; the query fails if it has more."""
    names = single.columns
    checked = single.limit(2).groupBy().agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in names])).alias("_one"))
    ok = F.assert_true(F.size("_one") <= 1, F.lit("more than one row on the right of a cross join"))
    one = checked.where(ok.isNull()).select(F.inline("_one"))
    return df.crossJoin(F.broadcast(one))


def theta_join(df: DataFrame, table: DataFrame, condition: Column, max_rows: int = 10_000, max_bytes: int = 16 << 20) -> DataFrame:
    """Join on any condition with a table proven small by its rows and bytes. A
    larger one is refused: without an equality each pair of rows would be
    compared. Intervals have one: see ``interval_join``."""
    if not fits_broadcast(table, max_rows, max_bytes):
        raise ValueError(f"theta join with more than {max_rows} rows or {max_bytes} bytes on the small side")
    return df.join(F.broadcast(table), condition)


def interval_join(
    df: DataFrame, value: str, intervals: DataFrame, low: str, high: str, width: float,
    condition: Column | None = None, hot_rows: int | None = None,
) -> DataFrame:
    """Rows of ``df`` with the intervals that hold ``value``: low <= value < high,
    or ``condition`` if given, which must lie within low <= value <= high.

    Both sides get a cell number, value divided by ``width``, and meet on it: an
    interval has one copy per cell it touches, so neither side is bounded. A
    width near the usual interval's length keeps copies and comparisons few.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(float(width))).cast("bigint")
    wide = intervals.withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    inside = (F.col(value) >= F.col(low)) & (F.col(value) < F.col(high)) if condition is None else condition
    return skew_join(df.withColumn("_cell", cell(value)), wide, ["_cell"], "inner", hot_rows).where(inside).drop("_cell")


def interval_counts(df: DataFrame, value: str, intervals: DataFrame, low: str, high: str, name: str = "n", hot_rows: int | None = None) -> DataFrame:
    """``df`` with the number of intervals that hold ``value``: low <= value < high.

    No pair is made. Up to a value as many intervals hold it as have begun without
    having ended: a running sum over all ends and the distinct values, cut into
    pieces along the values.
    """
    from millrace.operators.windows import running  # which uses this module

    kind = df.schema[value].dataType
    rows = df.withColumn("_at", F.col(f"`{value}`"))
    real = intervals.select(F.col(f"`{low}`").alias("_lo"), F.col(f"`{high}`").alias("_hi")).where("_lo < _hi")
    steps = real.select(F.inline(F.array(
        F.struct(F.col("_lo").alias("_at"), F.lit(1).cast("long").alias("_step")), F.struct(F.col("_hi").alias("_at"), F.lit(-1).cast("long").alias("_step")))))
    if steps.schema["_at"].dataType != kind:
        raise ValueError(f"{value} and the intervals' ends are of different types; cast one of them")
    asked = rows.select("_at", F.lit(0).cast("long").alias("_step"), F.lit(1).alias("_asked"))
    ends = steps.withColumn("_asked", F.lit(0)).unionByName(asked).where("_at IS NOT NULL")
    ends = materialize(ends.groupBy("_at").agg(F.sum("_step").alias("_step"), F.max("_asked").alias("_asked")), "interval-ends")
    begun = running(ends, [], [("_at", "asc")], {name: ("sum", "_step")}, hot_rows).where("_asked = 1").select("_at", name)
    joined = skew_join(rows, begun, ["_at"], "left", hot_rows, unique_right=True)
    return joined.select(*df.columns, F.coalesce(name, F.lit(0)).alias(name))


def semi_join(big: DataFrame, small: DataFrame, column: str, hot_rows: int | None = None) -> DataFrame:
    """Rows of ``big`` whose ``column`` occurs in ``small``. Keys that are few, by
    measure, are copied and nothing is shuffled; else hot keys are split, and
    Spark's own runtime filter thins the big side where it pays."""
    keys = small.select(column).distinct()
    side = checked_broadcast(keys)
    return skew_join(big, keys, [column], "left_semi", hot_rows) if side is keys else big.join(side, column, "left_semi")


# ---------------------------------------------------------------- bucketed tables


def bucketed_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    buckets: int,
    save: Callable[[str, DataFrame, tuple[int, list[str]]], DataFrame],
    how: str = "inner",
    hot_rows: int | None = None,
) -> DataFrame:
    """Write both sides bucketed by the join keys, then join without an exchange.

    ``save(label, df, (buckets, columns))`` stores a table and returns it. Rows
    are brought together by bucket first, so a bucket is one file. If a key is hot,
    both sides of an inner join are bucketed by key and salt, so a bucket never
    holds all rows of that key; for other joins the rows of hot keys are joined
    apart, split, and the rest through the bucketed tables.
    """
    hot_l, hot_r = hot_keys(left, keys, hot_rows), hot_keys(right, keys, hot_rows)
    if not hot_l and not hot_r:
        a = save("left", left.repartition(buckets, *keys), (buckets, keys))
        b = save("right", right.repartition(buckets, *keys), (buckets, keys))
        return a.join(b, keys, how)
    if how != "inner":
        hot = _marks(left, keys, hot_l, hot_r).select(*keys)
        part = lambda df, way: df.join(F.broadcast(hot), keys, way)  # noqa: E731  at most a key per task slot
        a, b = part(left, "left_anti"), part(right, "left_anti")
        a = save("left", a.repartition(buckets, *keys), (buckets, keys))
        b = save("right", b.repartition(buckets, *keys), (buckets, keys))
        split = skew_join(part(left, "left_semi"), part(right, "left_semi"), keys, how, hot_rows)
        return a.join(b, keys, how).unionByName(split)
    marks, cols = _marks(left, keys, hot_l, hot_r), [*keys, LEFT_SALT, RIGHT_SALT]
    a = _spread(_marked(left, marks, keys), (LEFT_SALT, LEFT_WAYS), (RIGHT_SALT, RIGHT_WAYS))
    b = _spread(_marked(right, marks, keys), (RIGHT_SALT, RIGHT_WAYS), (LEFT_SALT, LEFT_WAYS))
    a = save("left", a.repartition(buckets, *cols), (buckets, cols))
    b = save("right", b.repartition(buckets, *cols), (buckets, cols))
    return a.join(b, cols).drop(LEFT_SALT, RIGHT_SALT)


@contextmanager
def uneven_buckets(spark: SparkSession, ratio: int = 16) -> Iterator[None]:
    """Inside, tables whose bucket counts are multiples of each other are joined
    without an exchange: buckets of the finer table are read together, as many as
    the coarser one needs, up to ``ratio`` to one. Run the query inside, too."""
    wanted = {
        "spark.sql.bucketing.coalesceBucketsInJoin.enabled": "true",
        "spark.sql.bucketing.coalesceBucketsInJoin.maxBucketRatio": str(ratio),
        "spark.sql.sources.bucketing.autoBucketedScan.enabled": "true",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def append_bucketed(df: DataFrame, name: str, buckets: int, keys: list[str]) -> None:
    """Create or extend a table bucketed and sorted by ``keys``. An append must
    name the table's own buckets; rows are brought together by bucket first, so it
    adds one file per bucket."""
    gathered = df.repartition(buckets, *keys)
    gathered.write.mode("append").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
