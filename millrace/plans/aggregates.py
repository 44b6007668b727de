"""Aggregation queries."""

from pyspark.sql import functions as F

from millrace.operators import aggregates as A
from millrace.operators import sketches as S
from millrace.operators import text_aggregates as X
from millrace.plans.registry import Registry, table
from millrace.scratch import materialize
from millrace.sources.scans import spread_rows, spread_small

R = Registry()
query = R.query
TASK_ROWS = 100_000  # rows of a task that holds the distinct values of each column


@query("agg_basic", """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
           round(sum(l_extendedprice), 2) AS sum_base_price,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
           round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
           round(avg(l_quantity), 6) AS avg_qty, min(l_extendedprice) AS min_price,
           max(l_extendedprice) AS max_price, count(*) AS count_order, count(l_shipdate) AS count_dates
    FROM lineitem WHERE l_shipdate <= DATE '2000-09-02' GROUP BY l_returnflag, l_linestatus
    ORDER BY l_returnflag, l_linestatus""")
def agg_basic(spark, sf):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        table(spark, sf, "lineitem")
        .where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
            F.round(F.sum(price), 2).alias("sum_disc_price"),
            F.round(F.sum(price * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
            F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
            F.min("l_extendedprice").alias("min_price"),
            F.max("l_extendedprice").alias("max_price"),
            F.count(F.lit(1)).alias("count_order"),
            F.count("l_shipdate").alias("count_dates"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


@query("agg_group_by", """
    SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_totalprice) AS top
    FROM orders GROUP BY o_custkey""")
def agg_group_by(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.max("o_totalprice").alias("top"),
    )


@query("agg_global", """
    SELECT count(*) AS n, count(DISTINCT l_returnflag) AS flags, round(sum(l_quantity), 2) AS qty,
           min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem""")
def agg_global(spark, sf):
    return table(spark, sf, "lineitem").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("l_returnflag").alias("flags"),
        F.round(F.sum("l_quantity"), 2).alias("qty"), F.min("l_linenumber").alias("lo"),
        F.max("l_linenumber").alias("hi"),
    )


@query("agg_global_empty", """
    SELECT count(*) AS n, sum(l_quantity) AS qty, min(l_quantity) AS lo FROM lineitem WHERE l_quantity < 0""")
def agg_global_empty(spark, sf):
    return table(spark, sf, "lineitem").where("l_quantity < 0").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"), F.min("l_quantity").alias("lo")
    )


@query("agg_count_distinct", """
    SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority""")
def agg_count_distinct(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"))


@query("agg_multi_distinct", """
    SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers,
           sum(DISTINCT l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY l_returnflag""")
def agg_multi_distinct(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"),
        F.sum_distinct("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n"),
    )


@query("agg_select_distinct", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def agg_select_distinct(spark, sf):
    return table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


DIMS = ["l_returnflag", "l_linestatus"]
MEASURES = {"n": ("count",), "qty": ("sum", "l_quantity"), "top": ("max", "l_quantity"), "mean": ("avg", "l_quantity")}
GROUPED = """
    SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, max(l_quantity) AS top,
           avg(l_quantity) AS mean FROM lineitem GROUP BY """


@query("agg_grouping_sets", GROUPED + "GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")
def agg_grouping_sets(spark, sf):
    return A.grouping_sets(table(spark, sf, "lineitem"), DIMS, [DIMS, ["l_linestatus"], []], MEASURES)


@query("agg_cube", GROUPED + "CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark, sf):
    return A.cube(table(spark, sf, "lineitem"), DIMS, MEASURES)


@query("agg_rollup", GROUPED + "ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(spark, sf):
    return A.rollup(table(spark, sf, "lineitem"), DIMS, MEASURES)


@query("agg_grouping_id", """
    SELECT x, o_orderpriority, count(*) AS n, CAST(grouping_id(x, o_orderpriority) AS BIGINT) AS gid
    FROM (SELECT nullif(o_orderstatus, 'P') AS x, o_orderpriority FROM orders) t
    GROUP BY CUBE (x, o_orderpriority)""")
def agg_grouping_id(spark, sf):
    o = table(spark, sf, "orders").withColumn("x", F.expr("nullif(o_orderstatus, 'P')"))
    return A.cube(o, ["x", "o_orderpriority"], {"n": ("count",)}, "gid")


@query("agg_having", """
    SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND min(o_totalprice) < 50000""")
def agg_having(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("lo")
    ).where("n > 12 AND lo < 50000").select("o_custkey", "n")


@query("agg_group_by_expr", """
    SELECT CAST(year(o_orderdate) AS BIGINT) AS y, substr(o_orderpriority, 1, 1) AS p, 1 AS one,
           o_orderstatus || '/' || o_orderpriority AS pair, count(*) AS n
    FROM orders GROUP BY 1, 2, 3, 4""")
def agg_group_by_expr(spark, sf):
    pair = F.array("o_orderstatus", "o_orderpriority")
    return table(spark, sf, "orders").groupBy(
        F.year("o_orderdate").cast("bigint").alias("y"), F.substring("o_orderpriority", 1, 1).alias("p"),
        F.lit(1).alias("one"), pair.alias("pair"),
    ).agg(F.count(F.lit(1)).alias("n")).withColumn("pair", F.array_join("pair", "/"))


@query("agg_null_group", """
    SELECT nullif(o_orderpriority, '5-LOW') AS g, count(*) AS n, count(nullif(o_orderstatus, 'F')) AS n_known,
           round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1""")
def agg_null_group(spark, sf):
    return table(spark, sf, "orders").groupBy(F.expr("nullif(o_orderpriority, '5-LOW')").alias("g")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.expr("nullif(o_orderstatus, 'F')")).alias("n_known"),
        F.round(F.avg("o_totalprice"), 4).alias("mean"),
    )


@query("agg_variance", """
    SELECT o_orderstatus, round(var_pop(o_totalprice), 1) AS variance, round(var_pop(o_totalprice), 1) AS var_pop,
           round(var_samp(o_totalprice), 1) AS var_samp, round(stddev_pop(o_totalprice), 4) AS std,
           round(stddev_samp(o_totalprice), 4) AS stddev_samp
    FROM orders GROUP BY o_orderstatus""")
def agg_variance(spark, sf):
    from millrace.functions.numbers import std, variance

    x = F.col("o_totalprice")
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.round(variance(x), 1).alias("variance"), F.round(F.var_pop(x), 1).alias("var_pop"),
        F.round(F.var_samp(x), 1).alias("var_samp"), F.round(std(x), 4).alias("std"),
        F.round(F.stddev_samp(x), 4).alias("stddev_samp"),
    )


@query("agg_corr_covar", """
    SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS c,
           round(covar_pop(l_quantity, l_extendedprice), 3) AS cp,
           round(covar_samp(l_quantity, l_extendedprice), 3) AS cs FROM lineitem GROUP BY l_returnflag""")
def agg_corr_covar(spark, sf):
    a, b = "l_quantity", "l_extendedprice"
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.corr(a, b), 6).alias("c"), F.round(F.covar_pop(a, b), 3).alias("cp"),
        F.round(F.covar_samp(a, b), 3).alias("cs"),
    )


@query("agg_percentile", """
    SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.25), 4) AS p25,
           round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.999), 4) AS p999
    FROM orders GROUP BY o_orderstatus""")
def agg_percentile(spark, sf):
    points = {"p25": 0.25, "p50": 0.5, "p999": 0.999}
    exact = A.exact_percentiles(table(spark, sf, "orders"), ["o_orderstatus"], "o_totalprice", points)
    return exact.select("o_orderstatus", *[F.round(p, 4).alias(p) for p in points])


WITHIN_SQL = """
    SELECT l_returnflag, point, true AS within FROM (SELECT DISTINCT l_returnflag FROM lineitem) t, (SELECT unnest({points}) AS point) p"""


@query("agg_percentile_approx", WITHIN_SQL.format(points="['p50', 'p90']"))
def agg_percentile_approx(spark, sf):
    """Spark's approximate percentiles, checked: ranks within a thousandth."""
    l = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    points = {"p50": 0.5, "p90": 0.9}
    told = l.groupBy("l_returnflag").agg(*[F.percentile_approx("l_extendedprice", p, 10000).alias(n) for n, p in points.items()])
    errors = S.rank_errors(l, ["l_returnflag"], "l_extendedprice", told, points)
    return errors.select("l_returnflag", "point", (F.col("error") <= 1e-3).alias("within"))


@query("agg_percentile_sketch", WITHIN_SQL.format(points="['p01', 'p50', 'p90', 'p999']"))
def agg_percentile_sketch(spark, sf):
    """Quantiles from sketches of blocks, merged per group; ranks within 1 %."""
    l = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", F.expr("l_orderkey div 5000").alias("block"))
    points = {"p01": 0.01, "p50": 0.5, "p90": 0.9, "p999": 0.999}
    blocks = materialize(S.quantile_sketches(l, ["l_returnflag", "block"], "l_extendedprice"), "quantile-sketches")
    told = S.sketched_quantiles(S.merge_quantile_sketches(blocks, ["l_returnflag"]), points)
    errors = S.rank_errors(l, ["l_returnflag"], "l_extendedprice", told, points)
    return errors.select("l_returnflag", "point", (F.col("error") <= 0.01).alias("within"))


@query("agg_histogram", """
    SELECT o_orderstatus, CAST(least(10, count(DISTINCT o_totalprice)) AS BIGINT) AS bins, count(*) AS n, true AS ordered, true AS mean_within
    FROM orders GROUP BY o_orderstatus""")
def agg_histogram(spark, sf):
    """Histograms of ten bins: all rows are in them, centers rise, and their mean is the values'."""
    o = table(spark, sf, "orders")
    bins = o.groupBy("o_orderstatus").agg(F.histogram_numeric("o_totalprice", F.lit(10)).alias("h"), F.avg("o_totalprice").alias("mean"))
    total = F.aggregate("h", F.lit(0.0), lambda a, b: a + b["y"])
    weighted = F.aggregate("h", F.lit(0.0), lambda a, b: a + b["x"] * b["y"])
    return bins.select(
        "o_orderstatus", F.size("h").cast("bigint").alias("bins"), F.round(total).cast("bigint").alias("n"),
        (F.transform("h", lambda b: b["x"]) == F.array_sort(F.transform("h", lambda b: b["x"]))).alias("ordered"),
        (F.abs(weighted / total - F.col("mean")) < 1e-6 * F.col("mean")).alias("mean_within"),
    )


@query("agg_collect_set", """
    SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities
    FROM orders GROUP BY o_custkey""")
def agg_collect_set(spark, sf):
    # Five priorities: the set stays small however many orders a customer has.
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("priorities")
    )


SENTENCES_SQL = """
    SELECT list_filter(regexp_split_to_array(s, '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w
    FROM (SELECT unnest(regexp_split_to_array(lower(text), '[.!?\\n]+')) AS s FROM documents) t"""


def _sentences(spark, sf):
    """The words of all sentences, and of those of a sample of the documents."""
    d = table(spark, sf, "documents").select("text")
    return X.sentence_words(spread_small(d), "text"), X.sentence_words(X.sampled(d, "text"), "text")


@query("agg_ngrams", f"""
    SELECT ngram, count(*) AS frequency FROM
      (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS ngram
       FROM ({SENTENCES_SQL}) s WHERE len(w) >= 2) g
    GROUP BY ngram ORDER BY frequency DESC, ngram LIMIT 20""")
def agg_ngrams(spark, sf):
    words, some = _sentences(spark, sf)
    return X.top_ngrams(words, 2, 20, some)


@query("agg_ngrams_bounded", f"""
    SELECT ngram, count(*) AS frequency FROM
      (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS ngram
       FROM ({SENTENCES_SQL}) s WHERE len(w) >= 2) g
    GROUP BY ngram ORDER BY frequency DESC, ngram LIMIT 20""")
def agg_ngrams_bounded(spark, sf):
    # Summaries of fixed size find the candidates, a pass over all counts them.
    words, some = _sentences(spark, sf)
    return S.frequent_exactly(X.ngrams(words, 2), 20, some=X.ngrams(some, 2)).withColumnRenamed("item", "ngram")


@query("agg_context_ngrams", f"""
    SELECT ngram, count(*) AS frequency FROM
      (SELECT unnest(list_transform(list_filter(range(1, len(w)), lambda i: w[i] = 'the'), lambda i: w[i + 1])) AS ngram
       FROM ({SENTENCES_SQL}) s WHERE len(w) >= 2) g
    GROUP BY ngram ORDER BY frequency DESC, ngram LIMIT 20""")
def agg_context_ngrams(spark, sf):
    words, some = _sentences(spark, sf)
    return X.top_context_ngrams(words, ["the", None], 20, some)


def _stats_sql(column, text):
    length = (f"CAST(max(length({column})) AS BIGINT)", f"avg(length({column}))") if text else ("NULL", "NULL")
    return f"""SELECT '{column}' AS column_name, count(*) - count({column}) AS n_null,
        count(DISTINCT {column}) AS n_distinct, CAST(min({column}) AS VARCHAR) AS min_value,
        CAST(max({column}) AS VARCHAR) AS max_value, CAST({length[0]} AS BIGINT) AS max_length,
        CAST({length[1]} AS DOUBLE) AS avg_length FROM c"""


@query("agg_compute_stats", """
    WITH c AS (SELECT c_custkey, c_nationkey, nullif(c_mktsegment, 'BUILDING') AS seg, c_name FROM customer) """
    + " UNION ALL ".join(_stats_sql(c, t) for c, t in
                         [("c_custkey", False), ("c_nationkey", False), ("seg", True), ("c_name", True)]))
def agg_compute_stats(spark, sf):
    c = table(spark, sf, "customer").selectExpr(
        "c_custkey", "c_nationkey", "nullif(c_mktsegment, 'BUILDING') AS seg", "c_name"
    )
    return A.column_stats(spread_rows(c, TASK_ROWS), exact=True).drop("n_true", "n_false")


@query("agg_salted_two_level", """
    SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, max(value) AS top, round(avg(value), 6) AS mean
    FROM events GROUP BY event_type""")
def agg_salted_two_level(spark, sf):
    grouped = A.two_level(table(spark, sf, "events"), ["event_type"], {
        "n": ("count",), "total": ("sum", "value"), "top": ("max", "value"), "mean": ("avg", "value")}, ways=8)
    return grouped.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 6)})


@query("agg_multi_group_by", """
    SELECT 'status' AS "grouping", o_orderstatus AS "key", count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_orderstatus
    UNION ALL SELECT 'priority', o_orderpriority, count(*), max(o_totalprice) FROM orders GROUP BY o_orderpriority
    UNION ALL SELECT 'both', o_orderstatus || '|' || o_orderpriority, count(*), max(o_totalprice)
    FROM orders GROUP BY o_orderstatus, o_orderpriority""")
def agg_multi_group_by(spark, sf):
    return A.multi_group_by(
        table(spark, sf, "orders"),
        {"status": ["o_orderstatus"], "priority": ["o_orderpriority"], "both": ["o_orderstatus", "o_orderpriority"]},
        {"n": ("count",), "top": ("max", "o_totalprice")},
    ).select("grouping", "key", "n", "top")
