"""Joins and size checks that hold when one key owns a third of all rows.

Hot keys are *detected* on a sample and only steer how work is spread; which
keys are found never changes a result.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key with fewer rows than this fits comfortably in one task.
MIN_HOT_ROWS = 1_000_000
# No task gets more rows of one key than this, whatever the number of partitions.
MAX_TASK_ROWS = 50_000_000
# Keys are counted on about this many rows when the input is larger.
COUNTED_ROWS = 2_000_000
# Limits for a side that is copied to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_ROWS = 1_000_000

# Detections that are remembered, and for how long.
REMEMBERED, REMEMBERED_SECONDS = 256, 300.0
_detected: dict = {}  # what was asked -> (when, hot keys)

LEFT_SALT, RIGHT_SALT, LEFT_WAYS, RIGHT_WAYS = "_salt_l", "_salt_r", "_ways_l", "_ways_r"


@dataclass(frozen=True)
class HotKey:
    key: tuple
    rows: int
    pieces: int


def lookup(df: DataFrame, table: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Add the other columns of ``table`` (one row per key) to ``df``; keys
    compare null-safe, so NULL finds the entry of NULL. Without keys ``table``
    is the single row that belongs to all."""
    if not keys:
        return df.crossJoin(table)
    renamed = table.select(
        *[F.col(k).alias(f"_lookup_{k}") for k in keys], *[c for c in table.columns if c not in keys]
    )
    if table.columns == keys:
        raise ValueError("nothing to look up")
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_lookup_{k}")) for k in keys])
    return df.join(renamed, match, how).drop(*[f"_lookup_{k}" for k in keys])


def _task_slots(df: DataFrame) -> int:
    return max(200, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int | None = None) -> list[HotKey]:
    """Keys too large for one task, with the number of pieces to cut each into.

    A key is hot above ``max(hot_rows, total / slots)`` rows, where ``slots`` is
    the number of shuffle partitions (200 at least), and above ``MAX_TASK_ROWS``
    in any case. So at most ``slots`` keys come back, or one per
    ``MAX_TASK_ROWS`` rows where that is more: 20,000 for 10^12 rows.
    """
    floor = MIN_HOT_ROWS if hot_rows is None else hot_rows
    # The same input under the same keys is looked at once for a while: several joins of a
    # query share it. What was found steers the work only, so an old answer is never wrong.
    asked = (id(df.sparkSession), df.select(*keys).semanticHash(), tuple(keys), floor, _task_slots(df))
    known = _detected.get(asked)
    if known is not None and time.monotonic() - known[0] < REMEMBERED_SECONDS:
        return known[1]
    found = _detect(df, keys, floor)
    if len(_detected) >= REMEMBERED:
        _detected.clear()
    _detected[asked] = (time.monotonic(), found)
    return found


def _detect(df: DataFrame, keys: list[str], floor: int) -> list[HotKey]:
    total = df.count()
    if total <= floor:
        return []
    limit = max(floor, min(total // _task_slots(df), MAX_TASK_ROWS))
    fraction = min(1.0, COUNTED_ROWS / total)
    counted = df.select(*keys)
    if fraction < 1.0:
        counted = counted.sample(fraction, seed=11)
    found = (
        counted.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > limit * fraction)
        .collect()
    )
    out = []
    for row in found:
        rows = int(row["_rows"] / fraction)
        out.append(HotKey(tuple(row[k] for k in keys), rows, -(-rows // limit) + 1))
    return out


def _hashable(field: T.StructField) -> bool:
    return "map<" not in field.dataType.simpleString()


def row_salt(df: DataFrame, ways: Column) -> Column:
    """A number in ``[0, ways)`` that depends on the row and the input partition
    it sits in, never on row order: a task that runs again gives the same
    answer, and copies of one row in different partitions still spread."""
    cols = [F.col(f"`{f.name}`") for f in df.schema.fields if _hashable(f)]
    return F.pmod(F.xxhash64(*cols) + F.spark_partition_id(), ways).cast("int")


def row_bytes(df: DataFrame) -> Column:
    """Estimated bytes of one row, measured for strings and nested values."""
    total = F.lit(0).cast("bigint")
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            part = F.coalesce(F.octet_length(col), F.lit(0)) + 16
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            part = F.coalesce(F.octet_length(F.to_json(F.struct(col))), F.lit(0)) + 16
        else:
            part = F.lit(16)
        total = total + part.cast("bigint")
    return total


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Count rows and bytes of ``df``: one partial aggregate, nothing collected."""
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(row_bytes(df)).alias("bytes")).first()
    return size["rows"] <= max_rows and (size["bytes"] or 0) <= max_bytes


def checked_broadcast(df: DataFrame, **limits: int) -> DataFrame:
    """Mark ``df`` for broadcast if its measured size allows; otherwise leave the
    choice to Spark (a shuffled join, split by AQE where skewed)."""
    return F.broadcast(df) if fits_broadcast(df, **limits) else df


def _marks(left: DataFrame, keys: list[str], hot_l: list[HotKey], hot_r: list[HotKey]) -> DataFrame:
    ways: dict[tuple, list[int]] = {}
    for h in hot_l:
        ways.setdefault(h.key, [1, 1])[0] = h.pieces
    for h in hot_r:
        ways.setdefault(h.key, [1, 1])[1] = h.pieces
    schema = T.StructType(
        [T.StructField(k, left.schema[k].dataType) for k in keys]
        + [T.StructField(LEFT_WAYS, T.IntegerType()), T.StructField(RIGHT_WAYS, T.IntegerType())]
    )
    return left.sparkSession.createDataFrame([(*k, *w) for k, w in ways.items()], schema)


def _marked(df: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    # At most one hot key per task slot and side (see hot_keys), so this broadcast is bounded.
    return lookup(df, F.broadcast(marks), keys).fillna(1, [LEFT_WAYS, RIGHT_WAYS])


def _spread(
    df: DataFrame, own: tuple[str, str], other: tuple[str, str], own_hot: bool = True, other_hot: bool = True
) -> DataFrame:
    """Give each row its own salt and one copy per salt of the other side. A
    side without hot keys needs no salts, and then the other one no copies."""
    if own_hot:
        salt = F.when(F.col(own[1]) > 1, row_salt(df, F.col(own[1]))).otherwise(F.lit(0))
        df = df.withColumn(own[0], salt)
    if other_hot:
        df = df.withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other[1]) - 1)))
    return df.drop(own[1], other[1])


def _grid_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str, left_hot: bool, right_hot: bool
) -> DataFrame:
    """Join two marked sides on keys plus salts."""
    salts = [s for s, hot in ((LEFT_SALT, left_hot), (RIGHT_SALT, right_hot)) if hot]
    a = _spread(left, (LEFT_SALT, LEFT_WAYS), (RIGHT_SALT, RIGHT_WAYS), left_hot, right_hot)
    b = _spread(right, (RIGHT_SALT, RIGHT_WAYS), (LEFT_SALT, LEFT_WAYS), right_hot, left_hot)
    return a.join(b, [*keys, *salts], how).drop(*salts)


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "inner",
    hot_rows: int | None = None,
    probe_left: DataFrame | None = None,
    probe_right: DataFrame | None = None,
    unique_left: bool = False,
    unique_right: bool = False,
) -> DataFrame:
    """``left.join(right, keys, how)`` with the rows of hot keys spread over tasks.

    A hot key is cut into pieces by a row salt on the side where it is hot; the
    rows of the other side with that key are copied once per piece. Key columns
    of both sides must have the same type.

    Keys are counted on the inputs themselves. If an input is costly to compute,
    name a plain scan with the same key columns as its ``probe_*``; if its keys
    are unique (a grouped result), say so and it is not counted at all.
    """
    if how in ("left_semi", "left_anti"):
        right = right.select(*keys).distinct()  # copies on the right add nothing
        unique_right = True
    if how in ("inner", "left", "full", "left_semi", "left_anti"):
        hot_l = [] if unique_left else hot_keys(left if probe_left is None else probe_left, keys, hot_rows)
        hot_r = [] if unique_right else hot_keys(right if probe_right is None else probe_right, keys, hot_rows)
    elif how == "right":
        swapped = skew_join(
            right, left, keys, "left", hot_rows, probe_right, probe_left, unique_right, unique_left
        )
        rest = [c for c in left.columns if c not in keys] + [c for c in right.columns if c not in keys]
        return swapped.select(*keys, *rest)
    else:
        raise ValueError(f"unknown join type {how!r}")
    if not hot_l and not hot_r:
        return left.join(right, keys, how)
    marks = _marks(left, keys, hot_l, hot_r)
    a, b = _marked(left, marks, keys), _marked(right, marks, keys)
    if how in ("inner", "left_semi", "left_anti"):
        return _grid_join(a, b, keys, how, bool(hot_l), bool(hot_r))
    if not hot_r:
        result = _grid_join(a, b, keys, "left", True, False)
    else:
        result = _outer_with_hot_right(a, b, keys, bool(hot_l))
    if how == "full":
        unmatched = skew_join(right, left, keys, "left_anti", hot_rows, probe_right, None, unique_right)
        result = result.unionByName(unmatched, allowMissingColumns=True)
    return result


def _outer_with_hot_right(a: DataFrame, b: DataFrame, keys: list[str], left_hot: bool) -> DataFrame:
    """Left outer join of marked sides. A key hot on the right always has
    partners, so there an inner join says the same and both sides may be cut."""
    cold_a, cold_b = a.where(F.col(RIGHT_WAYS) == 1), b.where(F.col(RIGHT_WAYS) == 1)
    cold = _grid_join(cold_a, cold_b, keys, "left", left_hot, False)
    hot_a, hot_b = a.where(F.col(RIGHT_WAYS) > 1), b.where(F.col(RIGHT_WAYS) > 1)
    hot = _grid_join(hot_a, hot_b, keys, "inner", left_hot, True)
    # NULL keys match nothing: the inner part drops them, so they are kept here.
    null_key = reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys])
    lost = hot_a.where(null_key).drop(LEFT_WAYS, RIGHT_WAYS)
    return cold.unionByName(hot).unionByName(lost, allowMissingColumns=True)
