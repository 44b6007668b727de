"""Window and partition-function queries."""

from pyspark.sql import functions as F

from millrace.functions.dates import epoch_micros
from millrace.operators import windows as W
from millrace.plans.registry import Registry, table
from millrace.skew import hot_keys

R = Registry()
query = R.query

BY_TIME = [("ts", "asc"), ("event_id", "asc")]
BY_DATE = [("o_orderdate", "asc"), ("o_orderkey", "asc")]


def _events(spark, sf, *more):
    return table(spark, sf, "events").select("event_id", "user_id", "ts", "value", *more)


def _orders(spark, sf, *more):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", *more)


@query("win_agg_partition", """
    SELECT event_id, user_id, count(*) OVER w AS n, max(value) OVER w AS top, round(sum(value) OVER w, 2) AS total
    FROM events WINDOW w AS (PARTITION BY user_id)""")
def win_agg_partition(spark, sf):
    out = W.over_partition(_events(spark, sf), ["user_id"], {
        "n": F.count(F.lit(1)), "top": F.max("value"), "total": F.round(F.sum("value"), 2)})
    return out.select("event_id", "user_id", "n", "top", "total")


@query("win_running_sum", """
    SELECT event_id, user_id, round(sum(value) OVER w, 2) AS running, count(*) OVER w AS n,
           min(value) OVER w AS low, round(avg(value) OVER w, 10) AS mean
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def win_running_sum(spark, sf):
    out = W.running(_events(spark, sf), ["user_id"], BY_TIME, {
        "running": ("sum", "value"), "n": ("count",), "low": ("min", "value"), "mean": ("avg", "value")})
    return out.select("event_id", "user_id", F.round("running", 2).alias("running"), "n", "low",
                      F.round("mean", 10).alias("mean"))


@query("win_rows_frame", """
    SELECT o_orderkey, round(sum(o_totalprice) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS upto,
           round(sum(o_totalprice) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 2) AS onward,
           round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS whole
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def win_rows_frame(spark, sf):
    o = _orders(spark, sf)
    hot = hot_keys(o, ["o_custkey"])
    out = W.running(o, ["o_custkey"], BY_DATE, {"upto": ("sum", "o_totalprice")}, hot=hot)
    out = W.running(out, ["o_custkey"], W.backwards(BY_DATE), {"onward": ("sum", "o_totalprice")}, hot=hot)
    out = W.over_partition(out, ["o_custkey"], {"whole": F.sum("o_totalprice")}, hot)
    return out.select("o_orderkey", F.round("upto", 2).alias("upto"), F.round("onward", 2).alias("onward"),
                      F.round("whole", 2).alias("whole"))


@query("win_sliding_rows", """
    SELECT event_id, round(sum(value) OVER w, 2) AS near_sum, max(value) OVER w AS near_max, count(*) OVER w AS n
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)""")
def win_sliding_rows(spark, sf):
    near = lambda w: w.rowsBetween(-2, 1)
    out = W.near_rows(_events(spark, sf), ["user_id"], BY_TIME, 2, 1, {
        "near_sum": lambda w: F.round(F.sum("value").over(near(w)), 2),
        "near_max": lambda w: F.max("value").over(near(w)),
        "n": lambda w: F.count(F.lit(1)).over(near(w)),
    })
    return out.select("event_id", "near_sum", "near_max", "n")


@query("win_range_frame", """
    SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS near_total, count(*) OVER w AS n
    FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND CURRENT ROW)""")
def win_range_frame(spark, sf):
    out = W.near_values(_orders(spark, sf, "o_orderstatus"), ["o_orderstatus"], "o_orderkey", 100, 0, {
        "near_total": lambda w: F.round(F.sum("o_totalprice").over(w), 2),
        "n": lambda w: F.count(F.lit(1)).over(w),
    })
    return out.select("o_orderkey", "near_total", "n")


@query("win_lead_lag", """
    SELECT event_id, lag(value) OVER w AS prev1, lag(value, 3, -1.0) OVER w AS prev3, lead(event_id, 2) OVER w AS next2
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def win_lead_lag(spark, sf):
    out = W.near_rows(_events(spark, sf), ["user_id"], BY_TIME, 3, 2, {
        "prev1": lambda w: F.lag("value").over(w),
        "prev3": lambda w: F.lag("value", 3, -1.0).over(w),
        "next2": lambda w: F.lead("event_id", 2).over(w),
    })
    return out.select("event_id", "prev1", "prev3", "next2")


@query("win_first_last", """
    SELECT o_orderkey, first_value(o_totalprice) OVER w AS first_price,
           last_value(o_totalprice) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_price
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def win_first_last(spark, sf):
    out = W.running(_orders(spark, sf), ["o_custkey"], BY_DATE, {
        "first_price": ("first_value", "o_totalprice"), "last_price": ("last_of_all", "o_totalprice")})
    return out.select("o_orderkey", "first_price", "last_price")


@query("win_ranking", """
    SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn,
           rank() OVER w AS rk, dense_rank() OVER w AS dr, round(percent_rank() OVER w, 9) AS pr,
           round(cume_dist() OVER w, 9) AS cd
    FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate)""")
def win_ranking(spark, sf):
    o = _orders(spark, sf, "o_orderpriority")
    out = W.running(o, ["o_orderpriority"], [("o_orderdate", "asc")], {
        "rk": ("rank",), "dr": ("dense_rank",), "pr": ("percent_rank",), "cd": ("cume_dist",)})
    out = W.running(out, ["o_custkey"], BY_DATE, {"rn": ("row_number",)}, hot=hot_keys(o, ["o_custkey"]))
    return out.select("o_orderkey", F.col("rn").cast("bigint").alias("rn"), F.col("rk").cast("bigint").alias("rk"),
                      F.col("dr").cast("bigint").alias("dr"), F.round("pr", 9).alias("pr"), F.round("cd", 9).alias("cd"))


@query("win_ntile", """
    SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS quarter FROM orders""")
def win_ntile(spark, sf):
    out = W.running(_orders(spark, sf), ["o_custkey"], BY_DATE, {"quarter": ("ntile", 4)})
    return out.select("o_orderkey", F.col("quarter").cast("bigint").alias("quarter"))


@query("win_named", """
    SELECT c_nationkey, c_mktsegment, n, CAST(sum(n) OVER w AS BIGINT) AS nation_n, max(n) OVER w AS most
    FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment) t
    WINDOW w AS (PARTITION BY c_nationkey)""")
def win_named(spark, sf):
    # The named window runs over grouped rows: a handful per nation at any scale.
    return spark.sql("""
        SELECT c_nationkey, c_mktsegment, n, sum(n) OVER w AS nation_n, max(n) OVER w AS most
        FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM {customer} GROUP BY c_nationkey, c_mktsegment) t
        WINDOW w AS (PARTITION BY c_nationkey)""", customer=table(spark, sf, "customer"))


@query("win_over_agg", """
    SELECT o_orderstatus, y, n, CAST(sum(n) OVER (PARTITION BY o_orderstatus ORDER BY y) AS BIGINT) AS n_upto,
           rank() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, y) AS place
    FROM (SELECT o_orderstatus, CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY 1, 2) t""")
def win_over_agg(spark, sf):
    yearly = table(spark, sf, "orders").groupBy(
        "o_orderstatus", F.year("o_orderdate").cast("bigint").alias("y")
    ).agg(F.count(F.lit(1)).alias("n"))
    by_year = W.plain_window(["o_orderstatus"], [("y", "asc")])
    by_size = W.plain_window(["o_orderstatus"], [("n", "desc"), ("y", "asc")])
    return yearly.select("*", F.sum("n").over(by_year).alias("n_upto"),
                         F.rank().over(by_size).cast("bigint").alias("place"))


@query("win_multi_spec", """
    SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n_user, max(value) OVER (PARTITION BY event_type) AS top_type,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events""")
def win_multi_spec(spark, sf):
    e = _events(spark, sf, "event_type")
    hot = hot_keys(e, ["user_id"])
    out = W.over_partition(e, ["event_type"], {"top_type": F.max("value")})
    out = W.running(out, ["user_id"], BY_TIME, {"rn": ("row_number",)}, hot=hot)
    out = W.over_partition(out, ["user_id"], {"n_user": F.count(F.lit(1))}, hot)
    return out.select("event_id", "n_user", "top_type", F.col("rn").cast("bigint").alias("rn"))


# ---------------------------------------------------------------- partition functions


def gap_to_previous(df, p):
    """Microseconds since the previous event of the partition."""
    gap = {"gap": lambda w: F.col("us") - F.lag("us").over(w)}
    return W.near_rows(df, p.keys, p.order, 1, 0, gap, hot=p.hot)


def above_mean_gap(df, p):
    """Rows whose gap exceeds the partition's mean gap."""
    return W.over_partition(df, p.keys, {"mean_gap": F.avg("gap")}, p.hot).where("gap > mean_gap").drop("mean_gap")


CHAIN_SQL = """
    SELECT event_id, user_id, gap{extra} FROM
      (SELECT *, avg(gap) OVER (PARTITION BY user_id) AS mean_gap FROM
         (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap
          FROM events) a) b
    WHERE gap > mean_gap"""


@query("ptf_chain", CHAIN_SQL.format(extra=""))
def ptf_chain(spark, sf):
    e = _events(spark, sf).withColumn("us", epoch_micros(F.col("ts")))
    chained = W.partition_functions(e, ["user_id"], BY_TIME, gap_to_previous, above_mean_gap)
    return chained.select("event_id", "user_id", "gap")


@query("ptf_map_side", CHAIN_SQL.format(extra=", CAST(props->>'k' AS BIGINT) AS k"))
def ptf_map_side(spark, sf):
    e = _events(spark, sf, "props").withColumn("us", epoch_micros(F.col("ts")))
    raw = e.select("event_id", "user_id", "ts", "us", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    chained = W.partition_functions(raw, ["user_id"], BY_TIME, gap_to_previous, above_mean_gap)
    return chained.select("event_id", "user_id", "gap", "k")
