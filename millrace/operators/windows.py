"""Window functions whose partitions may be larger than one task.

With ordinary partitions every function here is Spark's own window over
``keys``. When a key is hot (see ``millrace.skew.hot_keys``) its rows are cut
into consecutive pieces along the window order; the window runs inside each
piece, and a summary with one row per piece supplies what came before.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from millrace.operators.joins import null_safe_join
from millrace.scratch import materialize
from millrace.skew import HotKey, checked_broadcast, hot_keys, lookup

Order = list[tuple[str, str]]  # (column, "asc" | "desc")
Expr = Callable[[WindowSpec], Column]

PIECE, CUTS, BLOCK, HOME, ROWNUM = "_piece", "_cuts", "_block", "_home", "_rownum"
SAMPLE_PER_PIECE = 32


def order_cols(order: Order) -> list[Column]:
    return [F.col(c).asc() if d == "asc" else F.col(c).desc() for c, d in order]


def plain_window(keys: list[str], order: Order) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order_cols(order))


def over_partition(
    df: DataFrame, keys: list[str], aggs: dict[str, Column], hot: list[HotKey] | None = None
) -> DataFrame:
    """Aggregates over whole partitions, beside every row.

    Partial aggregation shrinks the groups before the shuffle, and the result
    is joined back, so no task ever holds a partition. The totals are written
    once, measured there, and broadcast if they are small: then the rows
    themselves are not shuffled at all.

    A caller that knows the hot keys passes them. If there are none, this is
    Spark's window, which shares its shuffle with other windows over ``keys``.
    """
    if hot is not None and not hot:
        w = Window.partitionBy(*keys)
        return df.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])
    totals = materialize(df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()]), "totals")
    return lookup(df, checked_broadcast(totals), keys)


# ---------------------------------------------------------------- cutting hot keys


def _hot_table(df: DataFrame, keys: list[str], hot: list[HotKey]) -> DataFrame:
    schema = T.StructType(
        [T.StructField(k, df.schema[k].dataType) for k in keys]
        + [T.StructField("_rows", T.LongType()), T.StructField("_pieces", T.IntegerType())]
    )
    return df.sparkSession.createDataFrame([(*h.key, h.rows, h.pieces) for h in hot], schema)


def _at_or_before(cut: Column, order: Order) -> Column:
    """Does the cut point sort at or before the current row?"""
    result = F.lit(True)
    for name, direction in reversed(order):
        c, r = cut[name], F.col(name)
        if direction == "asc":  # NULLs first
            earlier = (c.isNull() & r.isNotNull()) | (c < r)
        else:  # NULLs last
            earlier = (c.isNotNull() & r.isNull()) | (c > r)
        result = F.coalesce(earlier, F.lit(False)) | (c.eqNullSafe(r) & result)
    return result


def _cut(df: DataFrame, keys: list[str], order: Order, hot: list[HotKey]) -> DataFrame:
    """Add ``_piece``: 0 for ordinary keys, the number of cut points passed for
    hot ones. Rows equal in every order column share a piece.

    Cut points come from a sample of a few dozen rows per piece and are fixed
    before the data is read again, so every reader sees the same pieces.
    """
    table = _hot_table(df, keys, hot)
    names = [c for c, _ in order]
    drawn = (
        lookup(df.select(*dict.fromkeys([*keys, *names])), F.broadcast(table), keys, "inner")
        .where(F.rand(17) < SAMPLE_PER_PIECE * F.col("_pieces") / F.col("_rows"))
    )
    w = plain_window(keys, order)
    step = F.floor(F.count(F.lit(1)).over(Window.partitionBy(*keys)) / F.col("_pieces"))
    chosen = (
        drawn.withColumn("_n", F.row_number().over(w))
        .withColumn("_step", F.greatest(step, F.lit(1)))
        .where(F.col("_n") % F.col("_step") == 0)
        .select(*keys, F.struct(*[F.col(n) for n in names]).alias("_cut"))
        .collect()
    )
    cuts: dict[tuple, list] = {h.key: [] for h in hot}
    for row in chosen:
        cuts.setdefault(tuple(row[k] for k in keys), []).append(row["_cut"])
    cut_type = T.StructType([T.StructField(n, df.schema[n].dataType) for n in names])
    schema = T.StructType(
        [T.StructField(k, df.schema[k].dataType) for k in keys]
        + [T.StructField(CUTS, T.ArrayType(T.ArrayType(cut_type)))]
    )
    # One row per hot key, a bounded number of cut points each, in two levels.
    bounds = df.sparkSession.createDataFrame([(*k, _two_levels(v)) for k, v in cuts.items()], schema)
    return lookup(df, F.broadcast(bounds), keys).withColumn(PIECE, _passed(lambda c: _at_or_before(c, order)))


def _two_levels(cuts: list) -> list[list]:
    """Runs of about the square root of the number of cut points."""
    size = max(1, math.isqrt(len(cuts)))
    return [cuts[i : i + size] for i in range(0, len(cuts), size)]


def _passed(test: Callable[[Column], Column]) -> Column:
    """How many cut points pass ``test``; those that do come first. Whole runs by
    their first point, then the last run begun: 20,000 points take some 280 tests."""
    begun = F.size(F.filter(F.col(CUTS), lambda run: test(run[0])))
    inside = F.size(F.filter(F.get(F.col(CUTS), begun - 1), test))
    some = (begun - 1) * F.size(F.get(F.col(CUTS), F.lit(0))) + inside
    return F.when(F.col(CUTS).isNull() | (begun == 0), F.lit(0)).otherwise(some)


# ---------------------------------------------------------------- running functions


def _column(arg: str | Column) -> Column:
    return F.col(arg) if isinstance(arg, str) else arg


def _plain(fn: tuple, w: WindowSpec, whole: WindowSpec) -> Column:
    name, *args = fn
    if name in ("sum", "avg", "min", "max"):
        return getattr(F, name)(_column(args[0])).over(w)
    if name == "count":
        return F.count(_column(args[0]) if args else F.lit(1)).over(w)
    if name == "ntile":
        return F.ntile(args[0]).over(w)
    if name == "first_value":
        return F.first(_column(args[0])).over(w)
    if name == "last_of_all":
        return F.last(_column(args[0])).over(whole)
    if name in ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist"):
        return getattr(F, name)().over(w)
    raise ValueError(f"unknown window function {name!r}")


def _end_of(value: Column, order: Order, last: bool) -> Column:
    """Value of the first or last row by the order, as an aggregate. The order
    must have one direction."""
    position = F.struct(*[F.col(c) for c, _ in order])
    ascending = {d for _, d in order} == {"asc"}
    boxed = F.struct(value.alias("v"))  # keeps NULL values
    return F.max_by(boxed, position) if last == ascending else F.min_by(boxed, position)


def backwards(order: Order) -> Order:
    return [(c, "desc" if d == "asc" else "asc") for c, d in order]


def _ends(cut: DataFrame, keys: list[str], order: Order, wanted: dict[str, tuple[Column, bool]]) -> DataFrame:
    """Per piece of a hot key the first or last values, for orders of mixed
    direction: Spark keeps one row per piece in each task before the shuffle."""
    rows = cut.where(F.col(CUTS).isNotNull())
    out = None
    for last in sorted({last for _, last in wanted.values()}):
        w = Window.partitionBy(*keys, PIECE).orderBy(*order_cols(backwards(order) if last else order))
        end = rows.withColumn(ROWNUM, F.row_number().over(w)).where(F.col(ROWNUM) == 1)
        named = [F.struct(v.alias("v")).alias(n) for n, (v, is_last) in wanted.items() if is_last == last]
        end = end.select(*keys, PIECE, *named)
        out = end if out is None else lookup(out, end, [*keys, PIECE])
    return out


def running(
    df: DataFrame,
    keys: list[str],
    order: Order,
    functions: dict[str, tuple],
    hot_rows: int | None = None,
    hot: list[HotKey] | None = None,
) -> DataFrame:
    """Ordered window functions with the default frame (start of the partition
    to the current row and its peers).

    ``functions`` maps an output name to a tuple: ``("sum"|"avg"|"min"|"max", col)``,
    ``("count",)`` or ``("count", col)``, ``("row_number",)``, ``("rank",)``,
    ``("dense_rank",)``, ``("percent_rank",)``, ``("cume_dist",)``, ``("ntile", n)``,
    ``("first_value", col)``, ``("last_of_all", col)`` (last row of the partition).
    ``hot`` gives the hot keys where they are known already. Types and errors are
    the same with and without them; decimal averages agree up to their last digit.
    """
    hot = hot_keys(df, keys, hot_rows) if hot is None else hot
    if not hot:
        w = plain_window(keys, order)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return df.select("*", *[_plain(fn, w, whole).alias(n) for n, fn in functions.items()])

    w = plain_window(keys, order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    types = df.select(*[_plain(fn, w, whole).alias(n) for n, fn in functions.items()]).schema  # as without hot keys
    one_way = len({d for _, d in order}) == 1
    ends: dict[str, tuple[Column, bool]] = {}
    cut = _cut(df, keys, order, hot)
    position = F.struct(*[F.col(c) for c, _ in order])
    aggs: dict[str, Column] = {"_cnt": F.count(F.lit(1))}
    for out, (name, *args) in functions.items():
        if name in ("sum", "avg"):
            aggs[f"_sum_{out}"] = F.sum(_column(args[0]))
        if name in ("count", "avg") and args:
            aggs[f"_cnt_{out}"] = F.count(_column(args[0]))
        if name in ("min", "max"):
            aggs[f"_ext_{out}"] = getattr(F, name)(_column(args[0]))
        if name == "dense_rank":
            aggs["_ranks"] = F.count_distinct(position)
        if name in ("first_value", "last_of_all"):
            if one_way:
                aggs[f"_end_{out}"] = _end_of(_column(args[0]), order, name == "last_of_all")
            else:
                ends[f"_end_{out}"] = (_column(args[0]), name == "last_of_all")
    # One row per piece of a hot key: bounded like the list of hot keys.
    pieces = (
        cut.where(F.col(CUTS).isNotNull()).groupBy(*keys, PIECE).agg(*[a.alias(n) for n, a in aggs.items()])
    )
    if ends:
        pieces = lookup(pieces, _ends(cut, keys, order, ends), [*keys, PIECE])
    before = Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    carried = [F.sum("_cnt").over(whole).alias("_total")]
    for n in [*aggs, *ends]:
        if n.startswith("_end_"):
            fn = functions[n[5:]][0]
            carried.append((F.last(n) if fn == "last_of_all" else F.first(n)).over(whole).alias(n))
        elif n.startswith("_ext_"):
            carried.append(getattr(F, functions[n[5:]][0])(n).over(before).alias(n))
        else:
            carried.append(F.sum(n).over(before).alias(n))
    offsets = pieces.select(*keys, PIECE, *carried)
    joined = lookup(cut.drop(CUTS), F.broadcast(offsets), [*keys, PIECE])

    w = Window.partitionBy(*keys, PIECE).orderBy(*order_cols(order))
    inside = Window.partitionBy(*keys, PIECE)
    to_end = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def plus(local: Column, carry: str) -> Column:
        return F.coalesce(local + F.col(carry), local, F.col(carry))

    total = F.coalesce(F.col("_total"), F.count(F.lit(1)).over(inside))
    skipped = F.coalesce(F.col("_cnt"), F.lit(0))
    rank = F.rank().over(w) + skipped
    number = F.row_number().over(w) + skipped

    def combine(out: str, name: str, args: list) -> Column:
        if name == "sum":
            return plus(F.sum(_column(args[0])).over(w), f"_sum_{out}")
        if name == "avg":
            return plus(F.sum(_column(args[0])).over(w), f"_sum_{out}") / plus(
                F.count(_column(args[0])).over(w), f"_cnt_{out}"
            )
        if name == "count":
            return plus(F.count(_column(args[0])).over(w), f"_cnt_{out}") if args else (
                F.count(F.lit(1)).over(w) + skipped
            )
        if name in ("min", "max"):
            pick = F.least if name == "min" else F.greatest
            return pick(getattr(F, name)(_column(args[0])).over(w), F.col(f"_ext_{out}"))
        if name == "row_number":
            return number
        if name == "rank":
            return rank
        if name == "dense_rank":
            return F.dense_rank().over(w) + F.coalesce(F.col("_ranks"), F.lit(0))
        if name == "percent_rank":
            return F.when(total > 1, (rank - 1) / (total - 1)).otherwise(F.lit(0.0))
        if name == "cume_dist":
            return (F.count(F.lit(1)).over(w) + skipped) / total
        if name == "ntile":
            n, zero_based = args[0], number - 1
            size, extra = F.floor(total / n), total % n
            wide = extra * (size + 1)
            return F.when(zero_based < wide, F.floor(zero_based / (size + 1))).otherwise(
                extra + F.floor((zero_based - wide) / F.greatest(size, F.lit(1)))
            ).cast("int") + 1
        if name == "first_value":
            local = F.struct(F.first(_column(args[0])).over(w).alias("v"))
            return F.coalesce(F.col(f"_end_{out}"), local)["v"]
        if name == "last_of_all":
            local = F.struct(F.last(_column(args[0])).over(to_end).alias("v"))
            return F.coalesce(F.col(f"_end_{out}"), local)["v"]
        raise ValueError(f"unknown window function {name!r}")

    return joined.select(
        *df.columns, *[combine(out, name, args).cast(types[out].dataType).alias(out) for out, (name, *args) in functions.items()]
    )


def following(
    df: DataFrame, keys: list[str], order: Order, functions: dict[str, tuple], hot_rows: int | None = None
) -> DataFrame:
    """Frames from the current row to the end of the partition: what ``running``
    gives in the reverse order. The order must be total, so that rows and their
    peers are the same (``over_ties`` needs no such order); ``first_value`` there
    is the last value of the partition."""
    return running(df, keys, backwards(order), functions, hot_rows)


# ---------------------------------------------------------------- ties

TIED = {"rank", "dense_rank", "percent_rank", "cume_dist", "count", "sum", "avg", "min", "max"}


def over_ties(
    df: DataFrame, keys: list[str], order: Order, functions: dict[str, tuple], hot_rows: int | None = None,
    onward: bool = False,
) -> DataFrame:
    """Ranks and running aggregates (the default frame, which takes in the
    current row's peers) where many rows may be equal in the order.

    Equal rows are first reduced to one row per key and order value with their
    number and sums; the window runs over those and is joined back, the rows of a
    popular value split over tasks. So no task holds all rows of a value or a key.
    ``functions`` are those of ``running`` but for row numbers, tiles and single
    values, which ties leave open. With ``onward`` frames reach from the current
    row and its peers to the end of the partition, and ranks count from there.
    """
    if not {name for name, *_ in functions.values()} <= TIED:
        raise ValueError(f"only {sorted(TIED)} are settled among ties")
    names = list(dict.fromkeys([*keys, *[c for c, _ in order]]))
    order = backwards(order) if onward else order
    w = plain_window(keys, order)
    types = df.select(*[_plain(fn, w, w).alias(n) for n, fn in functions.items()]).schema
    parts: dict[str, Column] = {"_tie_n": F.count(F.lit(1))}
    carried: dict[str, tuple] = {"_tie_upto": ("sum", "_tie_n"), "_tie_rank": ("row_number",)}
    for out, (name, *args) in functions.items():
        if name in ("sum", "avg"):
            parts[f"_tie_s_{out}"] = F.sum(_column(args[0]))
        if name in ("avg", "count") and args:
            parts[f"_tie_c_{out}"] = F.count(_column(args[0]))
        if name in ("min", "max"):
            parts[f"_tie_s_{out}"] = getattr(F, name)(_column(args[0]))
            carried[f"_tie_r_s_{out}"] = (name, f"_tie_s_{out}")
    for part in parts:
        if part != "_tie_n":
            carried.setdefault(f"_tie_r_{part[5:]}", ("sum", part))
    peers = materialize(df.groupBy(*names).agg(*[c.alias(n) for n, c in parts.items()]), "peers")
    ranked = running(peers, keys, order, carried, hot_rows)
    if {name for name, *_ in functions.values()} & {"percent_rank", "cume_dist"}:
        ranked = over_partition(ranked, keys, {"_tie_all": F.sum("_tie_n")}, hot=None) if keys else (
            ranked.crossJoin(F.broadcast(peers.agg(F.sum("_tie_n").alias("_tie_all"))))  # one row
        )
    rank = F.col("_tie_upto") - F.col("_tie_n") + 1

    def result(out: str, name: str, args: list) -> Column:
        if name == "rank":
            return rank
        if name == "dense_rank":
            return F.col("_tie_rank")
        if name == "percent_rank":
            return F.when(F.col("_tie_all") > 1, (rank - 1) / (F.col("_tie_all") - 1)).otherwise(F.lit(0.0))
        if name == "cume_dist":
            return F.col("_tie_upto") / F.col("_tie_all")
        if name == "count":
            return F.col(f"_tie_r_c_{out}") if args else F.col("_tie_upto")
        if name == "avg":
            return F.col(f"_tie_r_s_{out}") / F.col(f"_tie_r_c_{out}")
        return F.col(f"_tie_r_s_{out}")

    results = ranked.select(
        *[F.col(c).alias(f"_tie_k_{c}") for c in names],
        *[result(out, name, args).cast(types[out].dataType).alias(out) for out, (name, *args) in functions.items()],
    )
    joined = null_safe_join(df, results, {c: f"_tie_k_{c}" for c in names}, "inner", hot_rows, unique_right=True)
    return joined.select(*df.columns, *functions)


# ---------------------------------------------------------------- bounded frames


def near_rows(
    df: DataFrame,
    keys: list[str],
    order: Order,
    preceding: int,
    following: int,
    exprs: dict[str, Expr],
    hot_rows: int | None = None,
    hot: list[HotKey] | None = None,
) -> DataFrame:
    """Functions that look at most ``preceding`` rows back and ``following``
    rows ahead: lag, lead and ROWS frames with numeric bounds.

    Each expression gets an ordered window and adds its frame if it has one.
    The rows of hot keys are numbered by ``running`` and cut into blocks of equal
    row count; the rows next to a border are copied into the neighbouring block.
    The order must be total.
    """
    hot = hot_keys(df, keys, hot_rows) if hot is None else hot
    plain = plain_window(keys, order)
    if not hot:
        return df.select("*", *[e(plain).alias(n) for n, e in exprs.items()])
    marked = lookup(df, F.broadcast(_hot_table(df, keys, hot)), keys)
    ordinary = marked.where(F.col("_pieces").isNull()).select(*df.columns)
    large = marked.where(F.col("_pieces").isNotNull()).select(*df.columns)
    numbered = running(large, keys, order, {ROWNUM: ("row_number",)}, hot_rows, hot)
    size = max(max(h.rows // max(h.pieces - 1, 1) for h in hot), preceding, following, 1)
    zero_based = F.col(ROWNUM) - 1
    own = F.floor(zero_based / size)
    offset = zero_based % size
    blocks = F.array_compact(
        F.array(
            own,
            F.when(offset >= size - preceding, own + 1),
            F.when((offset < following) & (own > 0), own - 1),
        )
    )
    copies = numbered.withColumn(HOME, own).withColumn(BLOCK, F.explode(blocks))
    w = Window.partitionBy(*keys, BLOCK).orderBy(ROWNUM)
    blocked = (
        copies.select("*", *[e(w).alias(n) for n, e in exprs.items()])
        .where(F.col(HOME) == F.col(BLOCK))
        .select(*df.columns, *exprs)
    )
    return blocked.union(ordinary.select("*", *[e(plain).alias(n) for n, e in exprs.items()]))


def near_values(
    df: DataFrame,
    keys: list[str],
    value: str,
    preceding: int,
    following: int,
    exprs: dict[str, Expr],
    hot_rows: int | None = None,
) -> DataFrame:
    """RANGE frames: rows whose numeric ``value`` lies between ``preceding``
    below and ``following`` above the current one.

    Hot keys are cut at sampled quantiles of the value, so blocks hold about as
    many rows however the values lie; a row is copied into every block with a
    row that looks at it.
    """
    hot = hot_keys(df, keys, hot_rows)
    if not hot:
        w = Window.partitionBy(*keys).orderBy(value).rangeBetween(-preceding, following)
        return df.select("*", *[e(w).alias(n) for n, e in exprs.items()])
    marked = _cut(df, keys, [(value, "asc")], hot)

    def block_of(x: Column) -> Column:
        return F.when(F.col(CUTS).isNull() | x.isNull(), F.col(PIECE)).otherwise(_passed(lambda c: c[value] <= x))

    first, last = block_of(F.col(value) - following), block_of(F.col(value) + preceding)
    copies = marked.withColumn(HOME, F.col(PIECE)).withColumn(BLOCK, F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*keys, BLOCK).orderBy(value).rangeBetween(-preceding, following)
    return (
        copies.select("*", *[e(w).alias(n) for n, e in exprs.items()])
        .where(F.col(HOME) == F.col(BLOCK))
        .select(*df.columns, *exprs)
    )


# ---------------------------------------------------------------- partition functions

@dataclass(frozen=True)
class Partitioning:
    """What the functions of a chain share: counted once, for all of them."""

    keys: list[str]
    order: Order
    hot: list[HotKey]


PartitionFunction = Callable[[DataFrame, Partitioning], DataFrame]


def partition_functions(
    df: DataFrame, keys: list[str], order: Order, *functions: PartitionFunction, hot_rows: int | None = None
) -> DataFrame:
    """Chain table functions that share one partitioning: ``f2(f1(rows))``.

    Each function maps a DataFrame to a DataFrame and expresses its work with
    the helpers above, so the chain stays inside Spark's plan, shuffles once if
    no key is hot, and never hands a partition to one Python call.
    """
    spec = Partitioning(keys, order, hot_keys(df, keys, hot_rows))
    return reduce(lambda d, f: f(d, spec), functions, df)
