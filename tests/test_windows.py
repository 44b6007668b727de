"""Cut partitions must say exactly what Spark's own windows say."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import windows as W

NAMES = {
    "s": ("sum", "v"), "a": ("avg", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "c": ("count",),
    "cv": ("count", "v"), "rn": ("row_number",), "rk": ("rank",), "dr": ("dense_rank",),
    "pr": ("percent_rank",), "cd": ("cume_dist",), "nt": ("ntile", 7),
    "fv": ("first_value", "v"), "lv": ("last_of_all", "v"),
}


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows sit under one key, with ties, NULL keys and NULL values."""
    return (
        spark.range(0, 6000)
        .select(
            F.when(F.col("id") % 2 == 0, F.lit(7))
            .when(F.col("id") % 11 == 0, F.lit(None))
            .otherwise(F.col("id") % 40)
            .cast("bigint").alias("k"),
            F.when(F.col("id") % 97 == 0, F.lit(None)).otherwise(F.pmod(F.xxhash64("id"), F.lit(900)))
            .cast("bigint").alias("t"),
            F.col("id").alias("u"),
            F.when(F.col("id") % 13 == 0, F.lit(None)).otherwise(F.col("id") % 101).cast("bigint").alias("v"),
        )
        .repartition(6)
    )


def rows(df):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()], key=key)


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_running_with_total_order(skewed, direction):
    order = [("t", direction), ("u", direction)]
    assert rows(W.running(skewed, ["k"], order, NAMES, hot_rows=200)) == rows(
        W.running(skewed, ["k"], order, NAMES)
    )


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_running_with_peers(skewed, direction):
    names = {n: f for n, f in NAMES.items() if f[0] not in ("row_number", "ntile", "first_value", "last_of_all")}
    order = [("t", direction)]
    assert rows(W.running(skewed, ["k"], order, names, hot_rows=200)) == rows(
        W.running(skewed, ["k"], order, names)
    )


def test_mixed_directions(skewed):
    names = {"rn": ("row_number",), "s": ("sum", "v")}
    order = [("t", "desc"), ("u", "asc")]
    assert rows(W.running(skewed, ["k"], order, names, hot_rows=100)) == rows(W.running(skewed, ["k"], order, names))


@pytest.mark.parametrize("order", [[("t", "asc"), ("u", "asc")], [("t", "desc"), ("u", "asc")]])
def test_hot_and_cold_agree_in_types_too(skewed, order):
    df = skewed.withColumn("d", F.col("v").cast("decimal(10,2)"))
    names = {**NAMES, "ds": ("sum", "d"), "da": ("avg", "d"), "dl": ("last_of_all", "d")}
    cold, hot = W.running(df, ["k"], order, names), W.running(df, ["k"], order, names, hot_rows=150)
    simple = lambda x: [(f.name, f.dataType) for f in x.schema.fields]
    assert simple(cold) == simple(hot)
    # A decimal average is divided from merged sums: its last digit may be rounded another way.
    near = lambda x: rows(x.withColumn("da", F.round("da", 3)))
    assert near(cold) == near(hot)


@pytest.mark.parametrize("hot", [None, 200])
def test_following(skewed, hot):
    order = [("t", "asc"), ("u", "asc")]
    onward = Window.partitionBy("k").orderBy(*W.order_cols(order)).rowsBetween(0, Window.unboundedFollowing)
    want = skewed.select("*", F.sum("v").over(onward).alias("s"), F.max("v").over(onward).alias("m"),
                         F.count("v").over(onward).alias("c"), F.last("v").over(onward).alias("l"))
    got = W.following(skewed, ["k"], order, {"s": ("sum", "v"), "m": ("max", "v"), "c": ("count", "v"), "l": ("first_value", "v")}, hot)
    assert rows(got) == rows(want)


def test_near_rows(skewed):
    exprs = {
        "lag1": lambda w: F.lag("v", 1).over(w),
        "lag3": lambda w: F.lag("v", 3, -1).over(w),
        "lead2": lambda w: F.lead("v", 2).over(w),
        "sl": lambda w: F.sum("v").over(w.rowsBetween(-3, 2)),
    }
    order = [("t", "asc"), ("u", "asc")]
    assert rows(W.near_rows(skewed, ["k"], order, 3, 2, exprs, hot_rows=50)) == rows(
        W.near_rows(skewed, ["k"], order, 3, 2, exprs)
    )


def test_near_values(skewed):
    exprs = {"n": lambda w: F.count(F.lit(1)).over(w), "s": lambda w: F.sum("v").over(w)}
    df = skewed.where("t is not null")
    for p, f in [(10, 0), (0, 5), (25, 25)]:
        assert rows(W.near_values(df, ["k"], "t", p, f, exprs, hot_rows=100)) == rows(
            W.near_values(df, ["k"], "t", p, f, exprs)
        )


def test_over_partition(skewed):
    w = Window.partitionBy("k")
    expect = skewed.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("s", F.sum("v").over(w))
    assert rows(W.over_partition(skewed, ["k"], {"n": F.count(F.lit(1)), "s": F.sum("v")})) == rows(expect)


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(1, "A"), (2, "B"), (3, "A")], "id int, name string")


def test_windows_over_users(users):
    by = [("id", "asc")]
    assert rows(W.over_partition(users, ["name"], {"n": F.count("id")})) == [(1, "A", 2), (2, "B", 1), (3, "A", 2)]
    assert rows(W.running(users, ["name"], by, {"s": ("sum", "id")})) == [(1, "A", 1), (2, "B", 2), (3, "A", 4)]
    ahead = W.near_rows(users, ["name"], by, 1, 1, {
        "nxt": lambda w: F.lead("id").over(w), "prv": lambda w: F.lag("id").over(w)})
    assert rows(ahead) == [(1, "A", 3, None), (2, "B", None, None), (3, "A", None, 1)]


def test_no_keys_at_all(skewed):
    names = {"rn": ("row_number",), "s": ("sum", "v"), "nt": ("ntile", 5)}
    order = [("u", "asc")]
    assert rows(W.running(skewed, [], order, names, hot_rows=500)) == rows(W.running(skewed, [], order, names))
    exprs = {"p": lambda w: F.lag("v").over(w)}
    assert rows(W.near_rows(skewed, [], order, 1, 0, exprs, hot_rows=500)) == rows(
        W.near_rows(skewed, [], order, 1, 0, exprs))


@pytest.mark.parametrize("hot", [None, 300])
def test_chained_partition_functions(skewed, hot):
    step = lambda d, p: W.near_rows(
        d, p.keys, p.order, 1, 0, {"step": lambda w: F.col("u") - F.lag("u").over(w)}, hot=p.hot)
    large = lambda d, p: W.over_partition(d, p.keys, {"m": F.avg("step")}, p.hot).where("step > m")
    got = W.partition_functions(skewed, ["k"], [("u", "asc")], step, large, hot_rows=hot)
    w = Window.partitionBy("k")
    expect = skewed.withColumn("step", F.col("u") - F.lag("u").over(w.orderBy("u"))).withColumn(
        "m", F.avg("step").over(w)).where("step > m")
    assert rows(got) == rows(expect)


def test_windows_over_one_key_share_a_shuffle(skewed):
    df = W.running(skewed, ["k"], [("u", "asc")], {"s": ("sum", "v")}, hot=[])
    plan = W.over_partition(df, ["k"], {"n": F.count(F.lit(1))}, [])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(k") == 1


# --- ties ----------------------------------------------------------------------


TIE_SQL = """SELECT id, rank() OVER w AS rk, dense_rank() OVER w AS dr, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd,
    count(*) OVER w AS n, count(v) OVER w AS nv, sum(v) OVER w AS total, avg(v) OVER w AS mean, min(v) OVER w AS low, max(v) OVER w AS top
    FROM tied WINDOW w AS (PARTITION BY k ORDER BY {order})"""
TIE_FUNCTIONS = {
    "rk": ("rank",), "dr": ("dense_rank",), "pr": ("percent_rank",), "cd": ("cume_dist",), "n": ("count",), "nv": ("count", "v"),
    "total": ("sum", "v"), "mean": ("avg", "v"), "low": ("min", "v"), "top": ("max", "v"),
}


def _tied(spark):
    rows = spark.range(400).selectExpr(
        "id", "nullif(CAST(id % 3 AS INT), 2) AS k", "nullif(DATE'2024-01-01' + CAST(id % 4 AS INT), DATE'2024-01-01') AS d",
        "CASE WHEN id % 5 = 0 THEN double('NaN') ELSE CAST(id % 5 AS DOUBLE) END AS x", "nullif(id % 11, 3) AS v")
    rows.createOrReplaceTempView("tied")
    return rows


@pytest.mark.parametrize("hot_rows", [None, 3])
@pytest.mark.parametrize("order", [[("d", "asc")], [("x", "desc"), ("d", "asc")]])
def test_over_ties(spark, hot_rows, order):
    rows = _tied(spark)
    out = W.over_ties(rows, ["k"], order, TIE_FUNCTIONS, hot_rows)
    want = spark.sql(TIE_SQL.format(order=", ".join(" ".join(o) for o in order)))
    assert out.select("id", *TIE_FUNCTIONS).dtypes == want.dtypes
    rounded = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select("id", *TIE_FUNCTIONS).collect())
    assert rounded(out) == rounded(want)


def test_over_ties_onward_and_without_keys(spark):
    rows = _tied(spark)
    out = W.over_ties(rows, [], [("d", "asc")], {"n": ("count",), "total": ("sum", "v"), "cd": ("cume_dist",)}, 3, onward=True)
    want = spark.sql("SELECT id, count(*) OVER w AS n, sum(v) OVER w AS total, cume_dist() OVER (ORDER BY d DESC) AS cd FROM tied WINDOW w AS (ORDER BY d RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
    assert sorted(map(tuple, out.select("id", "n", "total", "cd").collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError, match="ties"):
        W.over_ties(rows, [], [("d", "asc")], {"n": ("row_number",)})


def test_a_popular_value_is_no_single_task(spark, monkeypatch):
    """Nine tenths of the rows share key and value; the join back deals them out."""
    rows = spark.range(20_000).selectExpr("id", "1 AS k", "CASE WHEN id % 10 = 0 THEN id ELSE 0 END AS d")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = W.over_ties(rows, ["k"], [("d", "asc")], {"rk": ("rank",)}, hot_rows=500)
        largest = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert largest < 8_000  # of 20,000 rows over 8 partitions; 18,000 share the value


def test_cut_points_in_two_levels(spark):
    for n in (0, 1, 2, 3, 10, 50):
        cuts = W._two_levels([{"v": i} for i in range(0, 2 * n, 2)])
        df = spark.createDataFrame([(cuts, x) for x in range(-1, 2 * n + 1)], "_cuts array<array<struct<v:int>>>, x int")
        got = df.select("x", W._passed(lambda c: c["v"] <= F.col("x")).alias("p")).collect()
        assert all(r["p"] == max(0, min(n, r["x"] // 2 + 1)) for r in got)
