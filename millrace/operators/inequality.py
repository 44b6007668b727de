"""Joins on two inequalities, with no side small.

Both sides are cut into a grid of cells at sampled quantiles of the two values;
crowded cells are split further by a hash of the row, so no block has more than
about ``BLOCK`` rows, also where all rows share one value. Pairs of blocks whose
minima and maxima rule the condition out never meet. Blocks are paired through
boxes around boxes, level by level, so that no list of pairs is made by comparing
all blocks of a large table with each other.

Inside a pair of blocks the rows are walked in the order of the first value, with
a bit per left row in the order of the second: the partners of a right row are the
bits set so far on one side of a place.

Counts and sums over the pairs need no pairs. Each side of a condition becomes a
place in one common order, so that a right row matches where it lies after the
left one in both orders, and both orders are cut into strips. A right row then
lies in the left row's strip of the second order, or else in its strip of the
first, or beyond both: two passes over strips and a grid of their totals add up to
all of them, with work that grows like a sort.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.scratch import materialize
from millrace.skew import checked_broadcast, fits_broadcast, lookup

BLOCK = 1000  # rows of a block: a pair of blocks has at most its square of results
STRIPS = 512  # cuts of the grid in one direction
NESTED = 2000  # boxes of a side that may be compared one by one
STRIP_ROWS = 100_000  # rows of a strip where pairs are only counted
GRID = 1024  # strips of an order at most: their totals are a grid of its square
GROUPS = 16  # groups of the right side whose sums are kept beside each other
OPS = {"<", "<=", ">", ">="}
X, Y, CELL = "_ineq_x", "_ineq_y", "_ineq_block"

Condition = tuple[str, str, str]  # (left column, operator, right column)


def _kind(left: T.DataType, right: T.DataType) -> T.DataType:
    """The type both sides' values are compared in."""
    if isinstance(left, T.DecimalType) and isinstance(right, T.DecimalType):
        scale = max(left.scale, right.scale)
        digits = max(left.precision - left.scale, right.precision - right.scale) + scale
        if digits > 38:
            raise ValueError("decimals of more than 38 digits together")
        return T.DecimalType(digits, scale)
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if isinstance(left, whole) and isinstance(right, whole):
        return T.LongType()
    if isinstance(left, (T.FloatType, T.DoubleType)) and isinstance(right, (T.FloatType, T.DoubleType)):
        return T.DoubleType()
    if left == right and isinstance(left, (T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType, T.BooleanType)):
        return left
    raise ValueError(f"{left.simpleString()} and {right.simpleString()} have no common order here; cast one of them")


def _steering(column: Column, kind: T.DataType) -> Column:
    """A number that rises with the value, exactly or not: it only chooses cells."""
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, T.StringType):  # the first six bytes
        return F.conv(F.rpad(F.hex(F.substring(column.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return column.cast("timestamp").cast("double")
    if isinstance(kind, T.BooleanType):
        return column.cast("int").cast("double")
    return column.cast("double")


def _cuts(values: DataFrame, strips: int) -> list[list[float]]:
    """Quantiles of the columns, distinct: at most ``strips`` each come to the driver."""
    if strips < 2:
        return [[] for _ in values.columns]
    points = [i / strips for i in range(1, strips)]
    found = values.agg(*[F.percentile_approx(c, points, 20 * strips).alias(c) for c in values.columns]).first()
    return [sorted({p for p in found[c] or [] if not math.isnan(p)}) for c in values.columns]


def _strip(column: Column, cuts: list[float]) -> Column:
    """Number of cuts at or below the value, found by halving."""

    def halve(a: int, z: int) -> Column:
        if a == z:
            return F.lit(a)
        mid = (a + z) // 2
        return F.when(column < F.lit(cuts[mid]), halve(a, mid)).otherwise(halve(mid + 1, z))

    return halve(0, len(cuts))


def _blocks(df: DataFrame, values: list[tuple[str, T.DataType]], block: int, label: str) -> DataFrame:
    """``df`` with the values to compare and the block of each row, written once.
    Rows with a NULL among the values match nothing and are left out."""
    names = [X, Y]
    rows = df.select("*", *[F.col(f"`{c}`").cast(kind).alias(n) for n, (c, kind) in zip(names, values)])
    rows = rows.where(F.col(X).isNotNull() & F.col(Y).isNotNull())  # NaN stays
    n = rows.count()
    strips = min(STRIPS, math.ceil(math.sqrt(n / block))) if n else 1
    steer = [_steering(F.col(n), kind) for n, (_, kind) in zip(names, values)]
    if strips > 1:
        cuts = _cuts(rows.select(*[s.alias(n) for s, n in zip(steer, names)]), strips)
        rows = rows.select("*", *[_strip(s, c).alias(f"_ineq_s{i}") for i, (s, c) in enumerate(zip(steer, cuts))])
    else:
        rows = rows.select("*", F.lit(0).alias("_ineq_s0"), F.lit(0).alias("_ineq_s1"))
    hashed = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()], F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("_ineq_h", hashed), f"inequality-{label}")
    sizes = rows.groupBy("_ineq_s0", "_ineq_s1").count()  # at most STRIPS squared
    rows = rows.join(checked_broadcast(sizes), ["_ineq_s0", "_ineq_s1"])
    # Half full on average, so that chance leaves few above `block`.
    part = F.pmod(F.col("_ineq_h"), F.ceil(F.col("count") * 2 / block).cast("long"))
    name = F.concat_ws("/", F.col("_ineq_s0"), F.col("_ineq_s1"), part)
    return rows.withColumn(CELL, name).drop("_ineq_s0", "_ineq_s1", "_ineq_h", "count")


def _boxes(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy(CELL).agg(
        F.min(X).alias("x0"), F.max(X).alias("x1"), F.min(Y).alias("y0"), F.max(Y).alias("y1")
    ).withColumnRenamed(CELL, "box")


def _may_meet(ops: tuple[str, str]) -> Column:
    """Can any row of the left box satisfy both conditions with one of the right?"""

    def one(axis: str, op: str) -> Column:
        low, high = ("0", "1") if op[0] == "<" else ("1", "0")
        a, b = F.col(f"l_{axis}{low}"), F.col(f"r_{axis}{high}")
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

    return one("x", ops[0]) & one("y", ops[1])


def _sided(boxes: DataFrame, side: str) -> DataFrame:
    return boxes.select(*[F.col(c).alias(f"{side}_{c}") for c in boxes.columns])


def _pairs(left: DataFrame, right: DataFrame, ops: tuple[str, str]) -> DataFrame:
    """(l_box, r_box) of the boxes that may meet. Long lists are paired through
    larger boxes around theirs first."""
    sizes = [left.count(), right.count()]
    if max(sizes) <= NESTED:
        small = _sided(right, "r")
        assert fits_broadcast(small, NESTED)
        return _sided(left, "l").join(F.broadcast(small), _may_meet(ops)).select("l_box", "r_box")
    outer, kept = [], []
    for boxes, n, label in zip((left, right), sizes, "lr"):
        # Neighbours in the first value share a box, and the name says how far they lie in the second.
        groups = max(1, math.ceil(n / 64))
        placed = boxes.repartitionByRange(min(groups, NESTED), "x0", "y0", "box").withColumn("around", F.spark_partition_id())
        placed = materialize(placed, f"boxes-{label}")
        around = placed.groupBy("around").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
        outer.append(around.withColumnRenamed("around", "box"))
        kept.append(placed)
    met = materialize(_pairs(outer[0], outer[1], ops), "box-pairs")
    l = _sided(kept[0], "l").join(met.toDF("l_around", "met"), "l_around")  # noqa: E741
    joined = l.join(_sided(kept[1], "r"), F.col("met") == F.col("r_around"))
    return joined.where(_may_meet(ops)).select("l_box", "r_box")


# ---------------------------------------------------------------- inside a pair of blocks


def _ranks(left: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides' values as whole numbers of the same order. NaN is above all."""
    both = pa.chunked_array([*left.chunks, *right.chunks], left.type).combine_chunks()
    if pa.types.is_decimal(both.type) or pa.types.is_string(both.type) or pa.types.is_large_string(both.type):
        order = np.array([x.encode() if isinstance(x, str) else x for x in both.to_pylist()], dtype=object)
        rank = {v: i for i, v in enumerate(sorted(set(order)))}
        ranks = np.array([rank[v] for v in order], np.int64)
    else:
        if pa.types.is_temporal(both.type):
            both = both.cast(pa.int32() if pa.types.is_date32(both.type) else pa.int64())
        _, ranks = np.unique(both.to_numpy(zero_copy_only=False), return_inverse=True)
    return ranks[: len(left)], ranks[len(left) :]


def matches(lx: np.ndarray, rx: np.ndarray, ly: np.ndarray, ry: np.ndarray, ops: tuple[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """Places (left, right) of the pairs with lx op rx and ly op ry."""
    if ops[0][0] == ">":
        lx, rx = -lx, -rx
    if ops[1][0] == ">":
        ly, ry = -ly, -ry
    by_x, by_y = np.argsort(lx, kind="stable"), np.argsort(ly, kind="stable")
    place = np.empty(len(ly), np.int64)
    place[by_y] = np.arange(len(ly))
    walk = np.argsort(rx, kind="stable")
    # How many left rows the first condition has let in, and up to which place the second one reaches.
    upto = np.searchsorted(lx[by_x], rx[walk], "right" if ops[0][1:] else "left")
    reach = np.searchsorted(ly[by_y], ry[walk], "right" if ops[1][1:] else "left")
    bits, done = np.zeros(len(ly), bool), 0
    found, counts = [np.empty(0, np.int64)], np.zeros(len(walk), np.int64)
    entering = place[by_x]
    for i, (n, r) in enumerate(zip(upto.tolist(), reach.tolist())):
        if n > done:
            bits[entering[done:n]] = True
            done = n
        if done and r:
            hit = np.flatnonzero(bits[:r])
            counts[i] = len(hit)
            found.append(hit)
    return by_y[np.concatenate(found)], np.repeat(walk, counts)


def _join_blocks(ops: tuple[str, str], left_columns: list[str], right_columns: list[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        i, j = matches(*_ranks(left[X], right[X]), *_ranks(left[Y], right[Y]), ops)
        cells = [left.select(left_columns).take(pa.array(i)), right.select(right_columns).take(pa.array(j))]
        return pa.Table.from_arrays([c for t in cells for c in t.columns], [*left_columns, *right_columns])

    return run


def _met(left: DataFrame, right: DataFrame, first: Condition, second: Condition, block: int):
    ops = (first[1], second[1])
    if not set(ops) <= OPS:
        raise ValueError(f"operators must be among {sorted(OPS)}")
    kinds = [_kind(left.schema[c[0]].dataType, right.schema[c[2]].dataType) for c in (first, second)]
    a = materialize(_blocks(left, list(zip((first[0], second[0]), kinds)), block, "left"), "inequality-left-blocks")
    b = materialize(_blocks(right, list(zip((first[2], second[2]), kinds)), block, "right"), "inequality-right-blocks")
    pairs = materialize(_pairs(_boxes(a), _boxes(b), ops), "inequality-pairs")
    # A block meets as many others as its box allows; its rows are copied to each.
    a2 = a.join(pairs.withColumnRenamed("l_box", CELL), CELL).withColumnRenamed(CELL, "l_box")
    b2 = b.join(pairs.withColumnRenamed("r_box", CELL), CELL).withColumnRenamed(CELL, "r_box")
    keys = ["l_box", "r_box"]
    return ops, a2.groupBy(*keys).cogroup(b2.groupBy(*keys))


def inequality_join(left: DataFrame, right: DataFrame, first: Condition, second: Condition, block: int = BLOCK) -> DataFrame:
    """Pairs of rows with ``left.a op right.b`` for both conditions, as an inner
    join. Column names of the sides must differ.

    Values are compared as in Spark: NULL matches nothing, NaN is above all. A task
    holds two blocks of about ``block`` rows at a time and at most all pairs of
    these, whatever the values' distribution.
    """
    if set(left.columns) & set(right.columns):
        raise ValueError("the sides' columns must not share names")
    ops, met = _met(left, right, first, second, block)
    schema = T.StructType([*left.schema.fields, *right.schema.fields])
    return met.applyInArrow(_join_blocks(ops, left.columns, right.columns), schema)


# ---------------------------------------------------------------- counts and sums without pairs


def later_and_above(value: np.ndarray, asks: np.ndarray, weights: list[np.ndarray]) -> list[np.ndarray]:
    """For each row that asks: the sums of the weights of the other rows that come
    later and have a larger value (whole numbers from 0). Runs of rows are merged
    two by two; only what is counted is ever added."""
    n = len(value)
    size = 1 << max(1, (n - 1).bit_length())
    key = np.full(size, -1, np.int64)
    key[:n] = 2 * value + asks  # among equal values those that ask come first, from above
    asking = np.zeros(size, bool)
    asking[:n] = asks
    held = [np.concatenate([np.where(asks, 0, w), np.zeros(size - n, w.dtype)]) for w in weights]
    sums = [np.zeros(size, w.dtype) for w in weights]
    half = 1
    while half < size:
        order = np.argsort(-key.reshape(-1, 2 * half), axis=1, kind="stable")
        late = order >= half
        order += np.arange(0, size, 2 * half)[:, None]
        wanted = ~late & asking[order]
        to = order[wanted]
        for w, s in zip(held, sums):
            s[to] += np.cumsum(np.where(late, w[order], 0), axis=1)[wanted]
        half *= 2
    return [s[:n] for s in sums]


def _weights(rows: pa.Table, measures: list[str], groups: int) -> list[np.ndarray]:
    """Each measure once per group, 0 in the rows of the others."""
    group = rows["_ineq_g"].to_numpy()
    return [np.where(group == g, rows[m].to_numpy(), 0) for g in range(groups) for m in measures]


def _inside_second(measures: list[str], groups: int, names: list[str]):
    def run(batches):
        rows = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        _, place = np.unique(rows["_ineq_at"].to_numpy(), return_inverse=True)
        for name, s in zip(names, later_and_above(place, rows["_ineq_q"].to_numpy(), _weights(rows, measures, groups))):
            rows = rows.append_column(name, pa.array(s))
        yield from rows.drop_columns(["_ineq_y", "_ineq_t2"]).to_batches()

    return run


def _inside_first(measures: list[str], groups: int, names: list[str], payload: list[str]):
    def run(rows: pa.Table, beyond: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows["_ineq_at"].to_numpy())))
        asks, strip = rows["_ineq_q"].to_numpy(), rows["_ineq_s2"].to_numpy()
        sums = later_and_above(strip.astype(np.int64), asks, _weights(rows, measures, groups))
        group, place = beyond["_ineq_g"].to_numpy(), beyond["_ineq_s2"].to_numpy()
        for i, s in enumerate(sums):
            mine, column = group == i // len(measures), beyond[measures[i % len(measures)]].to_numpy()
            after = np.zeros(int(place.max()) + 2, s.dtype)
            after[place[mine]] = column[mine]
            after = np.cumsum(after[::-1])[::-1]  # from a strip onward
            s += after[strip + 1]
        out = rows.select(payload)
        for name, s in zip(names, sums):
            out = out.append_column(name, pa.array(s + rows[name].to_numpy()))
        return out.filter(pa.array(asks))

    return run


def _in_reach(rows: DataFrame, other: DataFrame, ops: list[str]) -> DataFrame:
    """Without the rows that match nothing because the other side's values all lie elsewhere."""
    ends = other.agg(*[f(c).alias(f"_ineq_{n}{c}") for c in (X, Y) for n, f in (("min", F.min), ("max", F.max))])
    conditions = []
    for c, op in zip((X, Y), ops):
        a, b = F.col(c), F.col(f"_ineq_{'max' if op[0] == '<' else 'min'}{c}")
        conditions.append({"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op])
    return rows.crossJoin(F.broadcast(ends)).where(conditions[0] & conditions[1]).select(*rows.columns)  # one row


def _matched(left: DataFrame, right: DataFrame, first: Condition, second: Condition, measures: list[str], groups: int, strip_rows: int) -> DataFrame:
    """The other columns of ``left`` with ``_ineq_sum0``, ...: the sums of the
    measures of ``right``, group by group (``_ineq_g``), over the rows that match.
    Left rows that cannot match may be missing."""
    ops = [first[1], second[1]]
    if not set(ops) <= OPS:
        raise ValueError(f"operators must be among {sorted(OPS)}")
    kinds = [_kind(left.schema[c[0]].dataType, right.schema[c[2]].dataType) for c in (first, second)]

    def compared(df: DataFrame, names: list[str], rest: list[Column]) -> DataFrame:
        values = [F.col(f"`{c}`").cast(k) for c, k in zip(names, kinds)]
        values = [v + F.lit(0.0) if isinstance(k, T.DoubleType) else v for v, k in zip(values, kinds)]  # one zero
        return df.select(values[0].alias(X), values[1].alias(Y), *rest).where(F.col(X).isNotNull() & F.col(Y).isNotNull())

    payload = [c for c in left.columns if c not in (first[0], second[0])]
    zero = lambda m: F.lit(0).cast(right.schema[m].dataType).alias(m)
    empty = lambda c: F.lit(None).cast(left.schema[c].dataType).alias(c)
    asking = compared(left, [first[0], second[0]], [*[F.col(f"`{c}`") for c in payload], F.lit(True).alias("_ineq_q"), F.lit(0).alias("_ineq_g"), *map(zero, measures)])
    given = compared(right, [first[2], second[2]], [*map(empty, payload), F.lit(False).alias("_ineq_q"), F.col("_ineq_g"), *[F.col(m) for m in measures]])
    turned = [{"<": ">", ">": "<"}[op[0]] + op[1:] for op in ops]
    both = _in_reach(asking, given, ops).unionByName(_in_reach(given, asking, turned))
    # A right row matches if it lies after the left one. Of equal values the left ones come
    # first if equality matches, else the right ones; rows beyond that may lie in any order.
    ties = [F.col("_ineq_q") if len(op) == 1 else ~F.col("_ineq_q") for op in ops]
    both = both.select("*", *[t.alias(f"_ineq_t{i + 1}") for i, t in enumerate(ties)], F.xxhash64(F.monotonically_increasing_id()).alias("_ineq_h"))
    both = materialize(both, "inequality-both")
    strips = max(1, min(GRID, math.ceil(both.count() / strip_rows)))

    def placed(df: DataFrame, column: str, tie: str, op: str) -> DataFrame:
        order = [F.col(column).asc() if op[0] == "<" else F.col(column).desc(), F.col(tie), F.col("_ineq_h")]
        return df.repartitionByRange(strips, *order).sortWithinPartitions(*order)

    by_first = placed(both, X, "_ineq_t1", ops[0]).select(
        *[c for c in both.columns if c not in (X, "_ineq_t1")], F.spark_partition_id().alias("_ineq_s1"), F.monotonically_increasing_id().alias("_ineq_at"))
    by_first = materialize(by_first, "inequality-first")
    kept = [*payload, "_ineq_q", "_ineq_g", *measures, "_ineq_s1", "_ineq_at"]
    by_second = placed(by_first, Y, "_ineq_t2", ops[1]).select(*kept, F.spark_partition_id().alias("_ineq_s2"), Y, "_ineq_t2")
    names = [f"_ineq_sum{i}" for i in range(groups * len(measures))]
    sums = [T.StructField(n, right.schema[measures[i % len(measures)]].dataType) for i, n in enumerate(names)]
    fields = [f for f in by_second.schema.fields if f.name not in (Y, "_ineq_t2")]
    inside = by_second.mapInArrow(_inside_second(measures, groups, names), T.StructType([*fields, *sums]))
    inside = materialize(inside, "inequality-second")
    cells = inside.where(~F.col("_ineq_q")).groupBy("_ineq_s1", "_ineq_s2", "_ineq_g").agg(*[F.sum(m).alias(m) for m in measures])
    # The grid has a row for each pair of strips: what lies in later strips of the first order.
    grid = left.sparkSession.range(strips * strips * groups).selectExpr(
        f"CAST(id DIV {strips * groups} AS INT) AS _ineq_s1", f"CAST(id DIV {groups} % {strips} AS INT) AS _ineq_s2", f"CAST(id % {groups} AS INT) AS _ineq_g")
    later = Window.partitionBy("_ineq_s2", "_ineq_g").orderBy(F.desc("_ineq_s1")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = grid.join(cells, ["_ineq_s1", "_ineq_s2", "_ineq_g"], "left").select(
        "_ineq_s1", "_ineq_s2", "_ineq_g", *[F.coalesce(F.sum(m).over(later), F.lit(0)).cast(right.schema[m].dataType).alias(m) for m in measures])
    joined = inside.groupBy("_ineq_s1").cogroup(beyond.groupBy("_ineq_s1"))
    out = T.StructType([*[left.schema[c] for c in payload], *sums])
    return joined.applyInArrow(_inside_first(measures, groups, names, payload), out)


def inequality_counts(left: DataFrame, right: DataFrame, first: Condition, second: Condition, name: str = "n", block: int = STRIP_ROWS) -> DataFrame:
    """``left`` with the number of rows of ``right`` that satisfy both conditions.
    No pair is made: a task holds a strip of about ``block`` rows (more above
    ``GRID`` strips), and each row is sorted twice."""
    rows = materialize(left.withColumn("_ineq_row", F.monotonically_increasing_id()), "inequality-rows")
    needed = rows.select("_ineq_row", *[F.col(f"`{c[0]}`").alias(f"_ineq_l{i}") for i, c in enumerate((first, second))])
    other = right.select(*[F.col(f"`{c[2]}`").alias(f"_ineq_r{i}") for i, c in enumerate((first, second))], F.lit(0).alias("_ineq_g"), F.lit(1).cast("long").alias("_ineq_m0"))
    conditions = [(f"_ineq_l{i}", c[1], f"_ineq_r{i}") for i, c in enumerate((first, second))]
    counts = _matched(needed, other, *conditions, ["_ineq_m0"], 1, block).withColumnRenamed("_ineq_sum0", name)
    out = rows.join(counts, "_ineq_row", "left")
    return out.select(*left.columns, F.coalesce(name, F.lit(0)).cast("long").alias(name))


def inequality_sums(
    left: DataFrame, right: DataFrame, first: Condition, second: Condition, by_left: list[str], by_right: list[str],
    sums: dict[str, str], name: str = "n", block: int = STRIP_ROWS,
) -> DataFrame:
    """``inequality_join(...).groupBy(*by_left, *by_right)`` with the number of pairs
    and sums of columns of ``right``, whole numbers or floating ones, without pairs.

    With more than ``GROUPS`` groups on the right the pairs are made after all.
    """
    found = right.select(*by_right).distinct().limit(GROUPS + 1).collect()
    if len(found) > GROUPS:
        pairs = inequality_join(left, right, first, second)
        return pairs.groupBy(*by_left, *by_right).agg(F.count(F.lit(1)).alias(name), *[F.sum(c).alias(n) for n, c in sums.items()])
    spark = left.sparkSession
    schema = T.StructType([*[right.schema[c] for c in by_right], T.StructField("_ineq_g", T.IntegerType())])
    groups = spark.createDataFrame([(*r, i) for i, r in enumerate(found)], schema)
    measures = [F.lit(1).cast("long").alias("_ineq_m0")]  # all pairs; then a sum and the values in it for each column
    for column in sums.values():
        kind = right.schema[column].dataType
        if not isinstance(kind, (T.IntegralType, T.FloatType, T.DoubleType)):
            raise ValueError(f"{column} is {kind.simpleString()}: sums are of whole or floating numbers")
        wide, value = "long" if isinstance(kind, T.IntegralType) else "double", F.col(f"`{column}`")
        measures += [F.coalesce(value.cast(wide), F.lit(0).cast(wide)).alias(f"_ineq_m{len(measures)}"),
                     value.isNotNull().cast("long").alias(f"_ineq_m{len(measures) + 1}")]
    marked = lookup(right, F.broadcast(groups), by_right) if by_right else right.withColumn("_ineq_g", F.lit(0))
    other = marked.select(*[F.col(f"`{c[2]}`").alias(f"_ineq_r{i}") for i, c in enumerate((first, second))], "_ineq_g", *measures)
    asked = left.select(*by_left, *[F.col(f"`{c[0]}`").alias(f"_ineq_l{i}") for i, c in enumerate((first, second))])
    conditions = [(f"_ineq_l{i}", c[1], f"_ineq_r{i}") for i, c in enumerate((first, second))]
    k, n_groups = len(measures), max(1, len(found))
    matched = _matched(asked, other, *conditions, [f"_ineq_m{i}" for i in range(k)], n_groups, block)
    totals = matched.groupBy(*by_left).agg(*[F.sum(f"_ineq_sum{i}").alias(f"_ineq_sum{i}") for i in range(k * n_groups)])

    def row(g: int) -> Column:
        at = lambda i: F.col(f"_ineq_sum{g * k + i}")
        cells = [F.when(at(2 + 2 * i) > 0, at(1 + 2 * i)).alias(f"_ineq_out{i}") for i in range(len(sums))]
        return F.struct(F.lit(g).alias("_ineq_g"), at(0).alias("_ineq_n"), *cells)

    spread = totals.select(*by_left, F.inline(F.array(*[row(g) for g in range(n_groups)]))).where("_ineq_n > 0")
    return spread.join(F.broadcast(groups), "_ineq_g").select(
        *by_left, *by_right, F.col("_ineq_n").alias(name), *[F.col(f"_ineq_out{i}").alias(n) for i, n in enumerate(sums)])
