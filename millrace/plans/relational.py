"""Projection, filter, ordering and set-operation queries."""

from pyspark.sql import functions as F

from millrace.operators import ordering, projection
from millrace.operators.joins import cross_with_one_row
from millrace.plans.registry import Registry, table
from millrace.scratch import new_name

R = Registry()
query = R.query


@query("project_expr", """
    SELECT l_orderkey, l_linenumber, l_returnflag,
           l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge,
           l_quantity * 2 AS double_qty
    FROM lineitem""")
def project_expr(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_returnflag",
        "l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge",
        "l_quantity * 2 AS double_qty",
    )


@query("filter_and_or", """
    SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders
    WHERE (o_orderstatus = 'F' AND o_totalprice > 300000)
       OR (o_orderpriority = '1-URGENT' AND NOT o_orderstatus = 'O')""")
def filter_and_or(spark, sf):
    o = table(spark, sf, "orders")
    return o.where(
        ((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 300000))
        | ((F.col("o_orderpriority") == "1-URGENT") & ~(F.col("o_orderstatus") == "O"))
    ).select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")


@query("filter_three_valued", """
    SELECT o_orderstatus,
           count(CASE WHEN x > '3' THEN 1 END) AS n_true,
           count(CASE WHEN NOT (x > '3') THEN 1 END) AS n_false,
           count(CASE WHEN x > '3' OR x IS NULL THEN 1 END) AS n_true_or_null,
           count(CASE WHEN x <> '2-HIGH' AND o_totalprice >= 100000 THEN 1 END) AS n_and
    FROM (SELECT o_orderstatus, o_totalprice, nullif(o_orderpriority, '1-URGENT') AS x FROM orders) t
    GROUP BY o_orderstatus""")
def filter_three_valued(spark, sf):
    x = F.col("x")
    o = table(spark, sf, "orders").withColumn("x", F.expr("nullif(o_orderpriority, '1-URGENT')"))
    return o.groupBy("o_orderstatus").agg(
        F.count_if(x > "3").alias("n_true"),
        F.count_if(~(x > "3")).alias("n_false"),
        F.count_if((x > "3") | x.isNull()).alias("n_true_or_null"),
        F.count_if((x != "2-HIGH") & (F.col("o_totalprice") >= 100000)).alias("n_and"),
    )


@query("filter_between_in", """
    SELECT p_partkey, p_brand, p_size FROM part
    WHERE p_size BETWEEN 10 AND 20 AND p_type IN ('ECONOMY', 'PROMO')
      AND p_retailprice NOT BETWEEN 1000 AND 1100 AND p_brand NOT IN ('Brand#2', 'Brand#4')""")
def filter_between_in(spark, sf):
    p = table(spark, sf, "part")
    return p.where(
        p.p_size.between(10, 20) & p.p_type.isin("ECONOMY", "PROMO")
        & ~p.p_retailprice.between(1000, 1100) & ~p.p_brand.isin("Brand#2", "Brand#4")
    ).select("p_partkey", "p_brand", "p_size")


@query("filter_nulls", """
    SELECT count(CASE WHEN x IS NULL THEN 1 END) AS n_null,
           count(CASE WHEN x IS NOT NULL THEN 1 END) AS n_known,
           count(CASE WHEN x = x THEN 1 END) AS n_equal
    FROM (SELECT nullif(o_orderstatus, 'P') AS x FROM orders) t""")
def filter_nulls(spark, sf):
    x = F.expr("nullif(o_orderstatus, 'P')")
    return table(spark, sf, "orders").select(x.alias("x")).agg(
        F.count_if(F.col("x").isNull()).alias("n_null"),
        F.count_if(F.col("x").isNotNull()).alias("n_known"),
        F.count_if(F.col("x") == F.col("x")).alias("n_equal"),
    )


@query("filter_like_rlike", """
    SELECT lang, count(CASE WHEN text LIKE '%http%' THEN 1 END) AS n_like,
           count(CASE WHEN regexp_matches(text, '(^| )(the|and) [a-z]+ng') THEN 1 END) AS n_rlike,
           count(CASE WHEN regexp_matches(source, '^src[0-4]$') THEN 1 END) AS n_source,
           count(CASE WHEN text NOT LIKE '%\\_%' ESCAPE '\\' THEN 1 END) AS n_no_underscore
    FROM documents GROUP BY lang""")
def filter_like_rlike(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy("lang").agg(
        F.count_if(d.text.like("%http%")).alias("n_like"),
        F.count_if(d.text.rlike("(^| )(the|and) [a-z]+ng")).alias("n_rlike"),
        F.count_if(F.regexp(d.source, F.lit("^src[0-4]$"))).alias("n_source"),
        F.count_if(~d.text.like("%\\_%")).alias("n_no_underscore"),
    )


@query("project_regex_columns", """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders""")
def project_regex_columns(spark, sf):
    return projection.select_matching(table(spark, sf, "orders"), "(o_orderdate)?+.+")


@query("project_alias_case", """
    SELECT c_custkey AS id, c_name AS customer_name, upper(c_mktsegment) AS seg, c_acctbal + 1 AS bal_plus
    FROM customer""")
def project_alias_case(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        F.col("C_CustKey").alias("id"), F.col("c_name").alias("customer_name"),
        F.upper("C_MKTSEGMENT").alias("seg"), (F.col("C_acctbal") + 1).alias("bal_plus"),
    )


@query("subquery_from", """
    SELECT b.o_orderpriority AS priority, b.n AS n_orders, round(b.s, 2) AS total
    FROM (SELECT a.o_orderpriority, count(*) AS n, sum(a.o_totalprice) AS s
          FROM (SELECT o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus <> 'P') a
          GROUP BY a.o_orderpriority) b
    WHERE b.n > 10""")
def subquery_from(spark, sf):
    return spark.sql("""
        SELECT b.o_orderpriority AS priority, b.n AS n_orders, round(b.s, 2) AS total
        FROM (SELECT a.o_orderpriority, count(*) AS n, sum(a.o_totalprice) AS s
              FROM (SELECT o_orderpriority, o_totalprice FROM {orders} WHERE o_orderstatus <> 'P') a
              GROUP BY a.o_orderpriority) b
        WHERE b.n > 10""", orders=table(spark, sf, "orders"))


@query("view_over_query", """
    SELECT l_returnflag, count(*) AS n, round(sum(revenue), 2) AS revenue
    FROM (SELECT l_returnflag, l_extendedprice * (1 - l_discount) AS revenue
          FROM lineitem WHERE l_quantity >= 10) v
    WHERE revenue > 1000 GROUP BY l_returnflag""")
def view_over_query(spark, sf):
    inner, outer = new_name("v_revenue"), new_name("v_large")
    table(spark, sf, "lineitem").where("l_quantity >= 10").selectExpr(
        "l_returnflag", "l_extendedprice * (1 - l_discount) AS revenue"
    ).createOrReplaceTempView(inner)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {outer} AS SELECT * FROM {inner} WHERE revenue > 1000")
    result = spark.sql(
        f"SELECT l_returnflag, count(*) AS n, round(sum(revenue), 2) AS revenue FROM {outer} GROUP BY l_returnflag"
    )
    spark.catalog.dropTempView(outer)
    spark.catalog.dropTempView(inner)
    return result


@query("param_query", """
    SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 9 AND p_type = 'PROMO'""")
def param_query(spark, sf):
    return spark.sql(
        "SELECT p_partkey, p_size FROM {part} WHERE p_size BETWEEN :lo AND :hi AND p_type = :kind",
        args={"lo": 5, "hi": 9, "kind": "PROMO"}, part=table(spark, sf, "part"),
    )


@query("sample_bucket", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 4 = 1")
def sample_bucket(spark, sf):
    return projection.sample_bucket(
        table(spark, sf, "orders").select("o_orderkey", "o_custkey"), 2, 4, "o_orderkey"
    )


@query("sample_fraction")
def sample_fraction(spark, sf):
    return table(spark, sf, "orders").sample(withReplacement=False, fraction=0.2, seed=42).select("o_orderkey")


@query("sample_fraction_check", "SELECT true AS about_a_fifth, true AS known_once, true AS same_again")
def sample_fraction_check(spark, sf):
    """A row sample: about the share asked for, rows of the table, none twice, and the same with the same seed."""
    o = table(spark, sf, "orders").select("o_orderkey")
    one, two = (o.sample(withReplacement=False, fraction=0.2, seed=42) for _ in range(2))
    known = one.join(o.withColumn("all", F.lit(1)), "o_orderkey")
    counts = one.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("d"))
    for name, df in (("k", known), ("all", o), ("both", one.intersectAll(two))):
        counts = cross_with_one_row(counts, df.agg(F.count(F.lit(1)).alias(name)))
    near = F.abs(F.col("n") - F.col("all") * 0.2) <= F.greatest(F.lit(20.0), F.col("all") * 0.03)
    return counts.select(near.alias("about_a_fifth"), ((F.col("n") == F.col("d")) & (F.col("n") == F.col("k"))).alias("known_once"),
                         (F.col("both") == F.col("n")).alias("same_again"))


# ---------------------------------------------------------------- ordering


@query("sort_total", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def sort_total(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return ordering.total_sort(o, [("o_orderstatus", "asc"), ("o_totalprice", "desc")], "o_orderkey")


@query("topk", """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def topk(spark, sf):
    return ordering.top_k(
        table(spark, sf, "orders").select("o_orderkey", "o_totalprice"),
        [("o_totalprice", "desc"), ("o_orderkey", "asc")], 25,
    )


@query("sort_multi_key", """
    SELECT o_orderkey, x, o_orderpriority FROM
      (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS x, o_orderpriority FROM orders) t
    ORDER BY x ASC NULLS FIRST, o_orderpriority DESC, o_orderkey LIMIT 100""")
def sort_multi_key(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "nullif(o_orderstatus, 'P') AS x", "o_orderpriority")
    return ordering.top_k(o, [("x", "asc"), ("o_orderpriority", "desc"), ("o_orderkey", "asc")], 100)


@query("sort_within_partitions", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def sort_within_partitions(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return c.sortWithinPartitions("c_mktsegment", F.desc("c_acctbal"), "c_custkey")


@query("distribute_by", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
def distribute_by(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ordering.distribute_by(o, ["o_custkey"])


@query("cluster_by", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders")
def cluster_by(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return ordering.cluster_by(o, ["o_custkey"])


@query("sort_by_limit", """
    SELECT o_orderpriority, o_orderkey, o_totalprice FROM
      (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS rn
       FROM orders) t
    WHERE rn <= 3""")
def sort_by_limit(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return ordering.first_in_groups(o, ["o_orderpriority"], [("o_totalprice", "asc"), ("o_orderkey", "asc")], 3)


@query("limit_n", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 10")
def limit_n(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type").orderBy("event_id").limit(10)


@query("limit_zero", "SELECT event_id, event_type FROM events LIMIT 0")
def limit_zero(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type").limit(0)


@query("limit_subquery_count", """
    SELECT count(*) AS n FROM (SELECT l_orderkey FROM lineitem WHERE l_quantity > 5 LIMIT 500) t""")
def limit_subquery_count(spark, sf):
    return table(spark, sf, "lineitem").where("l_quantity > 5").select("l_orderkey").limit(500).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("result_max_rows", """
    SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 1000""")
def result_max_rows(spark, sf):
    from millrace.session import Warehouse

    rows = table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey", "c_name").orderBy("c_custkey")
    return Warehouse(spark).capped(rows)


# ---------------------------------------------------------------- set operations


@query("union_all", """
    SELECT o_orderkey AS k, 'urgent' AS tag FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT o_orderkey, 'big' FROM orders WHERE o_totalprice > 400000
    UNION ALL SELECT o_orderkey, 'open' FROM orders WHERE o_orderstatus = 'O'""")
def union_all(spark, sf):
    o = table(spark, sf, "orders")
    branch = lambda cond, tag: o.where(cond).select(F.col("o_orderkey").alias("k"), F.lit(tag).alias("tag"))
    return (
        branch("o_orderpriority = '1-URGENT'", "urgent")
        .union(branch("o_totalprice > 400000", "big"))
        .union(branch("o_orderstatus = 'O'", "open"))
    )


@query("union_widening", """
    SELECT CAST(p_size AS DOUBLE) AS v, p_brand AS name FROM part
    UNION ALL SELECT s_acctbal, s_name FROM supplier
    UNION ALL SELECT CAST(o_custkey AS DOUBLE), o_orderstatus FROM orders""")
def union_widening(spark, sf):
    return (
        table(spark, sf, "part").select(F.col("p_size").alias("v"), F.col("p_brand").alias("name"))
        .union(table(spark, sf, "supplier").select("s_acctbal", "s_name"))
        .union(table(spark, sf, "orders").select("o_custkey", "o_orderstatus"))
    )


@query("union_distinct", """
    SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer) t""")
def union_distinct(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    return o.union(table(spark, sf, "customer").select("c_custkey")).distinct()


@query("union_of_aggs", """
    SELECT 'orders' AS src, o_orderstatus AS grp, count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders GROUP BY o_orderstatus
    UNION ALL SELECT 'lines', l_returnflag, count(*), round(sum(l_extendedprice), 2)
    FROM lineitem GROUP BY l_returnflag
    UNION ALL SELECT 'joined', o_orderpriority, count(*), round(sum(l_extendedprice), 2)
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority""")
def union_of_aggs(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    joined = o.join(l, o.o_orderkey == l.l_orderkey)

    def part(df, src, grp, value):
        return df.groupBy(grp).agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 2).alias("total")
        ).select(F.lit(src).alias("src"), F.col(grp).alias("grp"), "n", "total")

    return (
        part(o, "orders", "o_orderstatus", "o_totalprice")
        .union(part(l, "lines", "l_returnflag", "l_extendedprice"))
        .union(part(joined, "joined", "o_orderpriority", "l_extendedprice"))
    )
