"""Join queries. NULL and unmatched keys are made from the data itself."""

from pyspark.sql import functions as F

from millrace.catalog.tables import temporary_database
from millrace.operators import joins
from millrace.operators.inequality import inequality_counts, inequality_sums
from millrace.plans.registry import Registry, table
from millrace.scratch import materialize
from millrace.skew import skew_join

R = Registry()
query = R.query
BUCKET_ROWS = 2_000_000  # lines that meet in a task


def _orders(spark, sf, *cols):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), *cols)


def _lines(spark, sf, *cols):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), *cols)


def _dim(spark, sf, name, key, *cols, to="k"):
    return table(spark, sf, name).select(F.col(key).alias(to), *cols)


@query("join_inner", """
    SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS total
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority""")
def join_inner(spark, sf):
    joined = skew_join(_lines(spark, sf, "l_extendedprice"), _orders(spark, sf, "o_orderpriority"), ["k"])
    return joined.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total")
    )


@query("join_three_way", """
    SELECT c_mktsegment, o_orderstatus, count(*) AS n, round(sum(l_quantity), 2) AS qty
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
    GROUP BY c_mktsegment, o_orderstatus""")
def join_three_way(spark, sf):
    # Lines are summed per order first: only one row per order meets the other joins.
    per_order = _lines(spark, sf, "l_quantity").groupBy("k").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("q")
    )
    orders = _orders(spark, sf, F.col("o_custkey").alias("c"), "o_orderstatus")
    o = skew_join(orders, per_order, ["k"], unique_right=True)
    all_three = skew_join(o, _dim(spark, sf, "customer", "c_custkey", "c_mktsegment", to="c"), ["c"], probe_left=orders)
    return all_three.groupBy("c_mktsegment", "o_orderstatus").agg(
        F.sum("lines").alias("n"), F.round(F.sum("q"), 2).alias("qty")
    )


@query("join_left_outer", """
    SELECT o_orderstatus, count(*) AS n, count(l_orderkey) AS n_matched, round(sum(l_quantity), 2) AS qty
    FROM orders LEFT JOIN (SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45) l
      ON o_orderkey = l_orderkey GROUP BY o_orderstatus""")
def join_left_outer(spark, sf):
    l = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("k"), "l_quantity")
    return skew_join(_orders(spark, sf, "o_orderstatus"), l, ["k"], "left").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.count("l_quantity").alias("n_matched"),
        F.round(F.sum("l_quantity"), 2).alias("qty"),
    )


@query("join_right_outer", """
    SELECT l_returnflag, count(*) AS n, count(o_orderkey) AS n_matched, round(sum(o_totalprice), 2) AS total
    FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F') o
    RIGHT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_returnflag""")
def join_right_outer(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    return skew_join(o, _lines(spark, sf, "l_returnflag"), ["k"], "right").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count("o_totalprice").alias("n_matched"),
        F.round(F.sum("o_totalprice"), 2).alias("total"),
    )


@query("join_full_outer", """
    WITH u AS (SELECT o_custkey, count(*) AS n_urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey),
         b AS (SELECT o_custkey, count(*) AS n_big FROM orders WHERE o_totalprice > 400000 GROUP BY o_custkey)
    SELECT coalesce(u.o_custkey, b.o_custkey) AS k, n_urgent, n_big
    FROM u FULL JOIN b ON u.o_custkey = b.o_custkey""")
def join_full_outer(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    count = lambda cond, name: o.where(cond).groupBy("k").agg(F.count(F.lit(1)).alias(name))
    return skew_join(
        count("o_orderpriority = '1-URGENT'", "n_urgent"), count("o_totalprice > 400000", "n_big"), ["k"], "full",
        unique_left=True, unique_right=True,
    )


@query("join_left_semi", """
    SELECT o_orderkey, o_orderstatus FROM orders
    WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity = 50)""")
def join_left_semi(spark, sf):
    l = table(spark, sf, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("k"))
    return skew_join(_orders(spark, sf, "o_orderstatus"), l, ["k"], "left_semi").withColumnRenamed("k", "o_orderkey")


@query("join_left_anti", """
    SELECT o_orderkey, o_orderstatus FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
    WHERE l_orderkey IS NULL""")
def join_left_anti(spark, sf):
    joined = skew_join(_orders(spark, sf, "o_orderstatus"), _lines(spark, sf), ["k"], "left_anti")
    return joined.withColumnRenamed("k", "o_orderkey")


@query("join_mixed_outer_chain", """
    SELECT c_nationkey, count(*) AS n, count(o_orderkey) AS n_orders, count(l_orderkey) AS n_lines
    FROM (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F') o
    LEFT JOIN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) l ON o_orderkey = l_orderkey
    RIGHT JOIN (SELECT c_custkey, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING') c
      ON o_custkey = c_custkey
    GROUP BY c_nationkey""")
def join_mixed_outer_chain(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.lit(1).alias("has_order")
    )
    l = table(spark, sf, "lineitem").where("l_quantity > 45").select(
        F.col("l_orderkey").alias("k"), F.lit(1).alias("has_line")
    )
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("c"), "c_nationkey"
    )
    chain = skew_join(skew_join(o, l, ["k"], "left"), c, ["c"], "right", probe_left=o)
    return chain.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.count("has_order").alias("n_orders"), F.count("has_line").alias("n_lines")
    )


@query("join_outer_on_filter", """
    SELECT o_orderstatus, count(*) AS n, count(l_orderkey) AS n_matched
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 40 AND o_totalprice > 100000
    GROUP BY o_orderstatus""")
def join_outer_on_filter(spark, sf):
    o = _orders(spark, sf, "o_orderstatus", "o_totalprice")
    l = _lines(spark, sf, F.col("l_orderkey"), "l_quantity")
    joined = joins.outer_join_with_filters(
        o, l, ["k"], "left", F.col("o_totalprice") > 100000, F.col("l_quantity") > 40
    )
    return joined.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.count("l_orderkey").alias("n_matched")
    )


@query("join_null_keys", """
    WITH o AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS k, o_totalprice FROM orders),
         c AS (SELECT CASE WHEN c_mktsegment <> 'BUILDING' THEN c_custkey END AS k, c_acctbal FROM customer)
    SELECT 'inner' AS kind, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM o JOIN c ON o.k = c.k
    UNION ALL SELECT 'left', count(*), round(sum(c_acctbal), 2) FROM o LEFT JOIN c ON o.k = c.k
    UNION ALL SELECT 'right', count(*), round(sum(c_acctbal), 2) FROM o RIGHT JOIN c ON o.k = c.k""")
def join_null_keys(spark, sf):
    o = table(spark, sf, "orders").selectExpr("CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS k", "o_totalprice")
    c = table(spark, sf, "customer").selectExpr(
        "CASE WHEN c_mktsegment <> 'BUILDING' THEN c_custkey END AS k", "c_acctbal"
    )
    parts = [
        skew_join(o, c, ["k"], how).agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("bal")
        ).select(F.lit(how).alias("kind"), "n", "bal")
        for how in ("inner", "left", "right")
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query("join_null_safe", """
    WITH a AS (SELECT nullif(o_orderpriority, '1-URGENT') AS p, o_orderstatus AS s, count(*) AS n
               FROM orders GROUP BY 1, 2),
         b AS (SELECT nullif(o_orderpriority, '1-URGENT') AS q, round(sum(o_totalprice), 2) AS total
               FROM orders GROUP BY 1)
    SELECT p, s, n, total FROM a JOIN b ON a.p IS NOT DISTINCT FROM b.q""")
def join_null_safe(spark, sf):
    o = table(spark, sf, "orders").withColumn("p", F.expr("nullif(o_orderpriority, '1-URGENT')"))
    a = o.groupBy("p", F.col("o_orderstatus").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    b = o.groupBy(F.col("p").alias("q")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return joins.null_safe_join(a, b, {"p": "q"}).select("p", "s", "n", "total")


@query("join_broadcast", """
    SELECT p_brand, count(*) AS n, round(sum(l_extendedprice), 2) AS total
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""")
def join_broadcast(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"), "l_extendedprice")
    return joins.map_join(l, _dim(spark, sf, "part", "p_partkey", "p_brand"), ["k"]).groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total")
    )


@query("join_broadcast_star", """
    SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")
def join_broadcast_star(spark, sf):
    places = table(spark, sf, "nation").join(
        F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey")
    )  # 25 nations, 5 regions: fixed
    s = table(spark, sf, "supplier").join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("k"), "n_name", "r_name"
    )
    l = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("k"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev")
    )
    return joins.map_join(l, s, ["k"]).groupBy("r_name", "n_name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("rev"), 2).alias("revenue")
    )


@query("join_cross", """
    SELECT o_orderstatus, count(*) AS n_above
    FROM orders CROSS JOIN (SELECT avg(o_totalprice) AS mean FROM orders) m
    WHERE o_totalprice > mean GROUP BY o_orderstatus""")
def join_cross(spark, sf):
    o = table(spark, sf, "orders")
    mean = o.agg(F.avg("o_totalprice").alias("mean"))
    return joins.cross_with_one_row(o, mean).where("o_totalprice > mean").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_above")
    )


@query("join_theta", """
    WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
         bands AS (SELECT i AS band, lo + (hi - lo) * i / 8 AS a, lo + (hi - lo) * (i + 1) / 8 AS b
                   FROM s, (SELECT unnest(range(8)) AS i) r)
    SELECT band, count(*) AS n, max(o_totalprice) AS top
    FROM orders JOIN bands ON o_totalprice >= a AND (o_totalprice < b OR band = 7) GROUP BY band""")
def join_theta(spark, sf):
    o = table(spark, sf, "orders").select("o_totalprice")
    ends = o.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    bands = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")).selectExpr(
        "CAST(i AS BIGINT) AS band", "lo + (hi - lo) * i / 8 AS a", "lo + (hi - lo) * (i + 1) / 8 AS b"
    )
    below = (F.col("o_totalprice") < F.col("b")) | (F.col("band") == 7)  # the last band holds its upper end
    inside = (F.col("o_totalprice") >= F.col("a")) & below
    return joins.theta_join(o, bands, inside).groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top")
    )


@query("join_inequality", """
    SELECT o_orderpriority, l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty
    FROM orders JOIN lineitem ON o_orderdate > l_shipdate AND 20 * o_totalprice < l_extendedprice
    GROUP BY o_orderpriority, l_returnflag""")
def join_inequality(spark, sf):
    # Orders placed after a line was shipped and worth a twentieth of it: neither side is small.
    o = table(spark, sf, "orders").selectExpr("o_orderpriority", "o_orderdate", "20 * o_totalprice AS twenty")
    l = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_shipdate", "l_extendedprice")
    # The pairs grow with the square of the input, their sums need none of them.
    out = inequality_sums(
        o, l, ("o_orderdate", ">", "l_shipdate"), ("twenty", "<", "l_extendedprice"), ["o_orderpriority"], ["l_returnflag"], {"qty": "l_quantity"}
    )
    return out.withColumn("qty", F.round("qty", 2))


@query("join_inequality_counts", """
    SELECT p.o_orderkey, count(q.o_orderkey) AS better
    FROM orders p LEFT JOIN orders q ON q.o_orderdate >= p.o_orderdate AND q.o_totalprice > p.o_totalprice
    GROUP BY p.o_orderkey""")
def join_inequality_counts(spark, sf):
    # How many later orders are worth more: far more pairs than rows, counted without making one.
    p = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    q = p.select(F.col("o_orderdate").alias("d"), F.col("o_totalprice").alias("v"))
    done = inequality_counts(p, q, ("o_orderdate", "<=", "d"), ("o_totalprice", "<", "v"), "better")
    return done.select("o_orderkey", "better")


@query("join_self", """
    SELECT a.role AS role, b.role AS next_role, count(*) AS n, CAST(sum(length(b.text)) AS BIGINT) AS chars
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
    GROUP BY a.role, b.role""")
def join_self(spark, sf):
    c = table(spark, sf, "conversations")
    a = c.select("conv_id", (F.col("turn") + 1).alias("turn"), "role")
    b = c.select("conv_id", "turn", F.col("role").alias("next_role"), F.length("text").cast("bigint").alias("len"))
    return skew_join(a, b, ["conv_id", "turn"]).groupBy("role", "next_role").agg(
        F.count(F.lit(1)).alias("n"), F.sum("len").alias("chars")
    )


@query("join_salted_skew", """
    WITH t AS (SELECT event_type, count(*) AS n_type, max(value) AS top FROM events GROUP BY event_type)
    SELECT e.user_id, count(*) AS n, round(sum(e.value / t.top), 6) AS share
    FROM events e JOIN t ON e.event_type = t.event_type GROUP BY e.user_id""")
def join_salted_skew(spark, sf):
    e = table(spark, sf, "events").select("event_type", "user_id", "value")
    t = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_type"), F.max("value").alias("top"))
    # The low limit makes every event type hot, so the salted path is what runs here.
    return skew_join(e, t, ["event_type"], hot_rows=100, unique_right=True).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value") / F.col("top")), 6).alias("share")
    )


@query("join_bucketed", """
    SELECT o_orderstatus, l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderstatus, l_returnflag""")
def join_bucketed(spark, sf):
    o, l = _orders(spark, sf, "o_orderstatus"), _lines(spark, sf, "l_returnflag", "l_extendedprice")
    with temporary_database(spark) as db:

        def save(label, df, buckets):
            n, cols = buckets
            df.write.bucketBy(n, *cols).sortBy(*cols).saveAsTable(f"{db}.{label}")
            return spark.table(f"{db}.{label}")

        buckets = max(4, l.count() // 2_000_000)  # about two million lines each
        joined = joins.bucketed_join(l, o, ["k"], buckets, save)
        return materialize(
            joined.groupBy("o_orderstatus", "l_returnflag").agg(
                F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total")
            )
        )


@query("join_bucketed_uneven", """
    SELECT o_orderstatus, l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderstatus, l_returnflag""")
def join_bucketed_uneven(spark, sf):
    # Three times as many buckets, filled by two appends, as on the other side.
    o, l = _orders(spark, sf, "o_orderstatus"), _lines(spark, sf, "l_returnflag", "l_extendedprice")
    buckets = max(4, l.count() // BUCKET_ROWS)
    with temporary_database(spark) as db, joins.uneven_buckets(spark):
        joins.append_bucketed(o, f"{db}.o", buckets, ["k"])
        for part in ("l_returnflag = 'R'", "l_returnflag <> 'R'"):
            joins.append_bucketed(l.where(part), f"{db}.l", 3 * buckets, ["k"])
        joined = spark.table(f"{db}.l").join(spark.table(f"{db}.o").hint("merge"), "k")
        return materialize(joined.groupBy("o_orderstatus", "l_returnflag").agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total")
        ))


@query("join_array_payload", """
    SELECT d.doc_id, l.quality, len(string_split(d.text, ' ')) AS n_words, string_split(d.text, ' ')[1] AS first_word
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def join_array_payload(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("words"))
    l = table(spark, sf, "labels").select("doc_id", "quality")
    return skew_join(l, d, ["doc_id"]).select(
        "doc_id", "quality", F.size("words").cast("bigint").alias("n_words"), F.get("words", F.lit(0)).alias("first_word")
    )


@query("join_bloom_prefilter", """
    SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem
    WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 5) GROUP BY l_returnflag""")
def join_bloom_prefilter(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag", "l_quantity")
    p = table(spark, sf, "part").where("p_size < 5").select(F.col("p_partkey").alias("k"))
    return joins.semi_join(l, p, "k").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")
    )
