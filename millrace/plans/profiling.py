"""Zone maps, data skipping and column profiles."""

from pyspark.sql import functions as F

from millrace.operators import profiles
from millrace.operators import zone_maps as Z
from millrace.operators.sketches import distinct_estimates
from millrace.plans.registry import Registry, table
from millrace.scratch import materialize

R = Registry()
query = R.query


def _line_block():
    return F.floor(F.col("l_orderkey") / 100)


def _line_zones(df):
    return Z.zone_map(df, _line_block(), ["l_orderkey", "l_quantity", "q"])


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_quantity", "l_returnflag", F.expr("nullif(l_quantity, 50)").alias("q")
    )


ZONES = """SELECT CAST(l_orderkey // 100 AS BIGINT) AS block, count(*) AS n_rows,
    min(l_orderkey) AS min_l_orderkey, max(l_orderkey) AS max_l_orderkey, count(*) - count(l_orderkey) AS nulls_l_orderkey,
    min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity, count(*) - count(l_quantity) AS nulls_l_quantity,
    min(q) AS min_q, max(q) AS max_q, count(*) - count(q) AS nulls_q
    FROM (SELECT *, nullif(l_quantity, 50) AS q FROM lineitem) t GROUP BY 1"""


@query("zone_map", ZONES)
def zone_map(spark, sf):
    return _line_zones(_lines(spark, sf))


@query("zone_map_append", ZONES)
def zone_map_append(spark, sf):
    l = _lines(spark, sf)
    return Z.merge_zone_maps(_line_zones(l.where("l_returnflag = 'R'")), _line_zones(l.where("l_returnflag <> 'R'")))


@query("zone_map_distinct", """
    SELECT block, count(*) AS n_rows, true AS keys_within, true AS parts_within FROM (SELECT l_orderkey // 1000 AS block FROM lineitem) t GROUP BY block
    UNION ALL SELECT NULL, count(*), true, true FROM lineitem""")
def zone_map_distinct(spark, sf):
    """Distinct values of blocks and of the table, from sketches merged on append,
    within 5 % of the exact numbers."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    block, columns = F.expr("l_orderkey div 1000"), ["l_orderkey", "l_partkey"]
    old, new = (Z.zone_map(l.where(f"l_returnflag {op} 'R'"), block, columns, columns) for op in ("=", "<>"))
    zones = materialize(Z.merge_zone_maps(old, new), "zones")  # the old rows are not read again
    told = distinct_estimates(zones, columns, ["block"]).unionByName(distinct_estimates(zones, columns), allowMissingColumns=True)
    exact = l.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_distinct(c).alias(f"x_{c}") for c in columns])
    whole = l.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_distinct(c).alias(f"x_{c}") for c in columns])
    both = exact.unionByName(whole, allowMissingColumns=True).join(told.withColumnRenamed("block", "b"), F.col("block").eqNullSafe(F.col("b")))
    near = lambda c: F.abs(F.col(c) - F.col(f"x_{c}")) <= 0.05 * F.col(f"x_{c}")
    return both.select("block", "n_rows", near("l_orderkey").alias("keys_within"), near("l_partkey").alias("parts_within"))


def _predicate():
    near = Z.Between("l_orderkey", 1010, 2345) | Z.literal_first(9700, "<", "l_orderkey")
    return near & Z.Compare("l_quantity", ">=", 45.0) & Z.Other("l_returnflag <> 'N'")


WHERE = "(l_orderkey BETWEEN 1010 AND 2345 OR l_orderkey > 9700) AND l_quantity >= 45 AND l_returnflag <> 'N'"


@query("zone_map_prune", f"SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem WHERE {WHERE}")
def zone_map_prune(spark, sf):
    l = _lines(spark, sf)
    zones = materialize(_line_zones(l), "zones")  # statistics are kept beside a table
    return Z.prune(l, _line_block(), zones, _predicate()).select("l_orderkey", "l_quantity", "l_returnflag")


@query("zone_map_report", f"""
    SELECT count(CASE WHEN keep THEN 1 END) AS kept, count(*) AS total,
           coalesce(sum(CASE WHEN keep THEN n_rows END), 0)::BIGINT AS rows_kept, sum(n_rows)::BIGINT AS rows_total
    FROM (SELECT n_rows, ((min_l_orderkey <= 2345 AND max_l_orderkey >= 1010) OR max_l_orderkey > 9700)
                 AND max_l_quantity >= 45 AS keep FROM ({ZONES}) z) t""")
def zone_map_report(spark, sf):
    return Z.skipping_report(_line_zones(_lines(spark, sf)), _predicate())


def _order_blocks(spark, sf, *columns):
    o = table(spark, sf, "orders")
    return o.select(F.floor(F.col("o_orderkey") / 1000).alias("block"), "o_orderkey", *columns)


BY_KEY = [("o_orderkey", "asc")]


@query("column_order_profile", """
    SELECT 'o_orderkey' AS c, block, count(*) AS n_rows,
           CASE WHEN min(d) >= 0 THEN 'ascending' WHEN max(d) <= 0 THEN 'descending' ELSE 'unordered' END AS state,
           CASE WHEN min(d) >= 0 OR max(d) <= 0 THEN max(abs(d)) END AS max_step
    FROM (SELECT o_orderkey // 1000 AS block, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_orderkey // 1000 ORDER BY o_orderkey) AS d
          FROM orders) t GROUP BY block
    UNION ALL
    SELECT 'o_custkey', block, count(*),
           CASE WHEN min(d) >= 0 THEN 'ascending' WHEN max(d) <= 0 THEN 'descending' ELSE 'unordered' END,
           CASE WHEN min(d) >= 0 OR max(d) <= 0 THEN max(abs(d)) END
    FROM (SELECT o_orderkey // 1000 AS block, o_custkey - lag(o_custkey) OVER (PARTITION BY o_orderkey // 1000 ORDER BY o_orderkey) AS d
          FROM orders) t GROUP BY block""")
def column_order_profile(spark, sf):
    parts = [
        profiles.order_profile(_order_blocks(spark, sf, *more), ["block"], BY_KEY, c).select(F.lit(c).alias("c"), "*")
        for c, more in (("o_orderkey", []), ("o_custkey", ["o_custkey"]))
    ]
    return parts[0].union(parts[1])


RUNS = [("o_custkey", "o_custkey"), ("o_orderstatus", "o_orderstatus")]


@query("column_runs", " UNION ALL ".join(f"""
    SELECT '{c}' AS column_name, block, count(*) AS n_values, count(CASE WHEN p IS NULL OR p <> v THEN 1 END) AS n_runs,
           count(DISTINCT v) AS n_distinct
    FROM (SELECT o_orderkey // 1000 AS block, {c} AS v, lag({c}) OVER (PARTITION BY o_orderkey // 1000 ORDER BY o_orderkey) AS p
          FROM orders) t GROUP BY block""" for c, _ in RUNS))
def column_runs(spark, sf):
    o = _order_blocks(spark, sf, "o_custkey", "o_orderstatus")
    return profiles.column_runs(o, ["block"], BY_KEY, [c for c, _ in RUNS])
