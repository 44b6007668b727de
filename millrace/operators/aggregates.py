"""Aggregations that shrink the data before they shuffle it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.windows import running
from millrace.scratch import materialize
from millrace.skew import checked_broadcast, hot_keys, lookup, row_salt

Measures = dict[str, tuple]  # output name -> ("sum"|"count"|"min"|"max"|"avg", column)


def _partial(measures: Measures) -> list[Column]:
    out = []
    for name, (kind, *arg) in measures.items():
        col = F.col(arg[0]) if arg else F.lit(1)
        if kind == "avg":
            out += [F.sum(col).alias(f"_s_{name}"), F.count(col).alias(f"_c_{name}")]
        elif kind in ("sum", "count", "min", "max"):
            out.append(getattr(F, kind)(col).alias(f"_p_{name}"))
        else:
            raise ValueError(f"{kind} cannot be merged from parts")
    return out


def _merge(measures: Measures) -> list[Column]:
    out = []
    for name, (kind, *_) in measures.items():
        if kind == "avg":
            out.append((F.sum(f"_s_{name}") / F.sum(f"_c_{name}")).alias(name))
        else:
            merged = {"min": F.min, "max": F.max}.get(kind, F.sum)(f"_p_{name}")
            # A count over no rows at all is 0, though there is no part to add.
            out.append((F.coalesce(merged, F.lit(0)) if kind == "count" else merged).alias(name))
    return out


def grouping_sets(
    df: DataFrame, dims: list[str], sets: list[list[str]], measures: Measures, grouping_id: str | None = None
) -> DataFrame:
    """GROUPING SETS in two steps: aggregate once at the finest grain, then
    expand that small result, instead of copying every input row per set.

    ``grouping_id`` names an SQL-standard id column: bit set = column rolled up.
    A measure ``("count_distinct", column)`` cannot be merged from parts: its
    distinct values are grouped on their own and joined by the grouping.
    """
    distinct = {n: m for n, m in measures.items() if m[0] == "count_distinct"}
    if distinct:
        gid = grouping_id or "_gid"
        plain = {n: m for n, m in measures.items() if n not in distinct} or {"_rows": ("count",)}
        out = grouping_sets(df, dims, sets, plain, gid)
        for name, (_, column) in distinct.items():
            values = df.select(*dims, F.col(column).alias("_value")).distinct()
            counted = values.groupingSets([[F.col(c) for c in s] for s in sets], *dims).agg(
                F.count_distinct("_value").alias(name), F.grouping_id().cast("bigint").alias(gid)
            )
            out = lookup(out, counted, [*dims, gid])
        return out.select(*dims, *measures, *([grouping_id] if grouping_id else []))
    finest = df.groupBy(*dims).agg(*_partial(measures))
    extra = [F.grouping_id().cast("bigint").alias(grouping_id)] if grouping_id else []
    return finest.groupingSets([[F.col(c) for c in s] for s in sets], *dims).agg(*_merge(measures), *extra)


def rollup(df: DataFrame, dims: list[str], measures: Measures, grouping_id: str | None = None) -> DataFrame:
    return grouping_sets(df, dims, [dims[:i] for i in range(len(dims), -1, -1)], measures, grouping_id)


def cube(df: DataFrame, dims: list[str], measures: Measures, grouping_id: str | None = None) -> DataFrame:
    subsets = [[d for i, d in enumerate(dims) if mask >> i & 1] for mask in range(2 ** len(dims))]
    return grouping_sets(df, dims, subsets, measures, grouping_id)


def two_level(df: DataFrame, keys: list[str], measures: Measures, ways: int = 32) -> DataFrame:
    """Skewed GROUP BY: aggregate by key and salt, then by key."""
    salted = df.withColumn("_salt", row_salt(df, F.lit(ways)))
    return salted.groupBy(*keys, "_salt").agg(*_partial(measures)).groupBy(*keys).agg(*_merge(measures))


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, points: dict[str, float], hot_rows: int | None = None
) -> DataFrame:
    """Exact percentiles with linear interpolation between neighbours.

    Equal values are counted first, and positions come from a running count that
    cuts large groups, so no task holds a group's values.
    """
    # One scan: values and their counts; NULLs keep their groups and count nothing.
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    counts = materialize(counted.withColumn("_n", F.when(F.col(value).isNotNull(), F.col("_n")).otherwise(F.lit(0))), "value_counts")
    hot = hot_keys(counts, keys, hot_rows)
    if not hot:
        whole = Window.partitionBy(*keys)
        upto = F.sum("_n").over(whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
        placed = counts.select("*", upto.alias("_upto"), F.sum("_n").over(whole).alias("_all"))
    else:
        placed = running(counts, keys, [(value, "asc")], {"_upto": ("sum", "_n")}, hot=hot)
        totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
        placed = lookup(placed, checked_broadcast(totals) if keys else F.broadcast(totals), keys)  # without keys: one row
    aggs = []
    for name, p in points.items():
        spot = F.lit(float(p)) * (F.col("_all") - 1)

        def at(rank: Column) -> Column:
            inside = (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
            return F.max(F.when(inside, F.col(value)))

        low, high = at(F.floor(spot)), at(F.ceil(spot))
        part = F.max(spot - F.floor(spot))
        aggs.append((low + (high - low) * part).alias(name))
    return placed.groupBy(*keys).agg(*aggs)


def column_stats(df: DataFrame, exact: bool = False) -> DataFrame:
    """compute_stats for every column, one row each, from one aggregate.

    Distinct counts are estimated with a sketch. ``exact=True`` counts them, with
    a copy of each row per column and a shuffle of all distinct values.
    """
    distinct = F.count_distinct if exact else F.approx_count_distinct
    parts, rows = [F.count(F.lit(1)).alias("_rows")], []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        text, flag = isinstance(f.dataType, T.StringType), isinstance(f.dataType, T.BooleanType)
        parts += [
            F.count(c).alias(f"_k{i}"),
            distinct(c).alias(f"_d{i}"),
            F.min(c).cast("string").alias(f"_lo{i}"),
            F.max(c).cast("string").alias(f"_hi{i}"),
            (F.max(F.length(c)) if text else F.lit(None)).cast("bigint").alias(f"_ml{i}"),
            (F.avg(F.length(c)) if text else F.lit(None)).cast("double").alias(f"_al{i}"),
            (F.count_if(c) if flag else F.lit(None)).cast("bigint").alias(f"_t{i}"),
            (F.count_if(~c) if flag else F.lit(None)).cast("bigint").alias(f"_f{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                (F.col("_rows") - F.col(f"_k{i}")).alias("n_null"),
                F.col(f"_d{i}").alias("n_distinct"),
                F.col(f"_lo{i}").alias("min_value"),
                F.col(f"_hi{i}").alias("max_value"),
                F.col(f"_ml{i}").alias("max_length"),
                F.col(f"_al{i}").alias("avg_length"),
                F.col(f"_t{i}").alias("n_true"),
                F.col(f"_f{i}").alias("n_false"),
            )
        )
    return df.agg(*parts).select(F.inline(F.array(*rows)))


def multi_group_by(df: DataFrame, groupings: dict[str, list[str]], measures: Measures) -> DataFrame:
    """Several GROUP BYs over one scan, tagged: ``grouping`` names the one a row
    belongs to, its key columns hold the key in their own types (the others are
    NULL), ``key`` is the key as one text: values joined by ``|``, NULL as ``\\N``,
    with bars and backslashes inside values escaped by a backslash."""
    dims = list(dict.fromkeys(c for cols in groupings.values() for c in cols))
    sets = [list(c) for c in dict.fromkeys(tuple(sorted(set(c), key=dims.index)) for c in groupings.values())]
    grouped = grouping_sets(df, dims, sets, measures, "_gid")
    tags = []
    for name, cols in groupings.items():
        gid = sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in cols)
        cells = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"([|\\])", r"\\$1"), F.lit("\\N")) for c in cols]
        tags.append(F.when(F.col("_gid") == gid, F.struct(F.lit(name).alias("grouping"), F.concat_ws("|", *cells).alias("key"))))
    # Several names may stand for the same columns.
    return grouped.select(F.explode(F.array_compact(F.array(*tags))).alias("_tag"), *dims, *measures).select("_tag.*", *dims, *measures)
