import os
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import casts, collections, dates, numbers, text
from millrace.operators import aggregates as A
from millrace.operators import joins, ordering, projection, scripts
from millrace.operators import text_aggregates as X
from millrace.operators.user_functions import aggregate_with
from tests.samples import ARRAYS, KV_ROWS, USERS, rows


@pytest.fixture(scope="module")
def kv(spark):
    return spark.createDataFrame(KV_ROWS, "key int, val string").repartition(7)


# ---------------------------------------------------------------- ordering


@pytest.mark.parametrize("k", range(6))
def test_top_k_over_many_partitions(spark, k):
    data = [(4, 14), (1, 11), (7, 17), (0, 10)]
    df = spark.createDataFrame(data, "key tinyint, value tinyint").repartition(50)
    assert [tuple(r) for r in ordering.top_k(df, [("key", "asc")], k).collect()] == sorted(data)[:k]


def test_total_sort_and_null_order(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 1), (4, 5)], "id int, v int")
    ids = lambda d: [r["id"] for r in ordering.total_sort(df, [("v", d)], "id").collect()]
    assert ids("asc") == [1, 3, 2, 4] and ids("desc") == [2, 4, 3, 1]


def test_cluster_by_keeps_keys_together_and_sorted(kv):
    parts = ordering.cluster_by(kv, ["key"], 6).withColumn("p", F.spark_partition_id())
    assert parts.groupBy("key").agg(F.count_distinct("p").alias("n")).where("n > 1").count() == 0
    seen = parts.rdd.mapPartitions(lambda it: [[r["key"] for r in it]]).collect()
    assert all(p == sorted(p) for p in seen) and Counter(k for p in seen for k in p) == Counter(k for k, _ in KV_ROWS)


def test_hot_key_is_spread(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("k"), "id").repartition(4)
    whole = ordering.distribute_by(df, ["k"], 8, hot_rows=200).withColumn("p", F.spark_partition_id())
    assert whole.where("k = 1").select("p").distinct().count() == 1  # unless told otherwise
    out = ordering.distribute_by(df, ["k"], 8, spread=True, hot_rows=200).withColumn("p", F.spark_partition_id())
    assert out.where("k = 1").select("p").distinct().count() > 4
    assert out.columns[:-1] == df.columns and rows(out.drop("p")) == rows(df)


def test_sort_by_limit_and_first_in_groups(kv):
    out = ordering.sort_by_limit(kv.withColumn("p", F.spark_partition_id()), [("key", "asc")], 2)
    by_part = {}
    for p, k, _ in kv.select(F.spark_partition_id(), "key", "val").collect():
        by_part.setdefault(p, []).append(k)
    expect = sorted((p, k) for p, ks in by_part.items() for k in sorted(ks)[:2])
    assert sorted((r["p"], r["key"]) for r in out.collect()) == expect
    plan = ordering.first_in_groups(kv, ["val"], [("key", "asc")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # once before the shuffle, once after


# ---------------------------------------------------------------- projection


def test_column_patterns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "ds int, hr int, value int")
    assert projection.select_matching(df, "(ds)?+.+").columns == ["hr", "value"]
    assert projection.select_unmatched(df, "ds|hr").columns == ["value"]


def test_sample_buckets_partition_the_table(kv):
    for col in ("key", "val"):
        parts = [projection.sample_bucket(kv, x, 4, col) for x in range(1, 5)]
        assert sum(p.count() for p in parts) == 500
    assert {r["key"] % 4 for r in projection.sample_bucket(kv, 2, 4, "key").collect()} == {1}
    with pytest.raises(ValueError):
        projection.sample_bucket(kv, 5, 4, "key")


def java_hash(text):
    h = 0
    for b in text.encode():
        h = (h * 31 + (b - 256 if b > 127 else b)) % (1 << 32)
    return h


def test_bucket_numbers(spark):
    words = ["", "a", "val_238", "élan", "x" * 50]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    got = {r["s"]: r["b"] for r in df.withColumn("b", projection.bucket_of(df, "s", 7)).collect()}
    assert got == {w: (java_hash(w) & 0x7FFFFFFF) % 7 for w in words}
    nums = spark.createDataFrame([(-1, -1), (5, 1 << 40), (None, None)], "i int, l bigint")
    out = nums.select(projection.bucket_of(nums, "i", 3).alias("i"), projection.bucket_of(nums, "l", 3).alias("l"))
    assert [tuple(r) for r in out.collect()] == [(0x7FFFFFFF % 3, 0), (2, (1 << 8) % 3), (0, 0)]


# ---------------------------------------------------------------- aggregates


@pytest.fixture(scope="module")
def facts(spark):
    return spark.range(900).select(
        F.when(F.col("id") % 4 == 0, None).otherwise(F.concat(F.lit("g"), F.col("id") % 3)).alias("g"),
        (F.col("id") % 5).cast("string").alias("h"),
        F.when(F.col("id") % 11 == 0, None).otherwise(F.pmod(F.xxhash64("id"), F.lit(50))).cast("double").alias("v"),
    )


def test_grouping_sets_equal_plain_spark(facts):
    measures = {"n": ("count",), "k": ("count", "v"), "s": ("sum", "v"), "lo": ("min", "v"), "m": ("avg", "v")}
    plain = [F.count(F.lit(1)).alias("n"), F.count("v").alias("k"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.avg("v").alias("m")]
    gid = F.grouping_id().cast("bigint").alias("gid")
    assert rows(A.cube(facts, ["g", "h"], measures, "gid")) == rows(facts.cube("g", "h").agg(*plain, gid))
    assert rows(A.rollup(facts, ["g", "h"], measures, "gid")) == rows(facts.rollup("g", "h").agg(*plain, gid))
    assert rows(A.two_level(facts, ["g"], measures, 5)) == rows(facts.groupBy("g").agg(*plain))
    with pytest.raises(ValueError):
        A.cube(facts, ["g"], {"x": ("median", "v")})


@pytest.mark.parametrize("hot", [None, 10])
@pytest.mark.parametrize("keys", [[], ["g"]])
def test_exact_percentiles(facts, keys, hot):
    points = {"p0": 0.0, "p33": 0.33, "p50": 0.5, "p100": 1.0}
    with_empty = facts.union(facts.limit(3).select(F.lit("empty"), "h", F.lit(None).cast("double")))
    groups = {}
    for r in with_empty.collect():
        groups.setdefault(tuple(r[k] for k in keys), []).append(r["v"])
    got = {tuple(r[k] for k in keys): r for r in A.exact_percentiles(with_empty, keys, "v", points, hot).collect()}
    assert set(got) == set(groups)
    for key, values in groups.items():
        known = [v for v in values if v is not None]
        for name, p in points.items():
            expect = float(np.percentile(known, p * 100)) if known else None
            assert got[key][name] == (pytest.approx(expect) if known else None)


def test_column_stats(spark):
    df = spark.createDataFrame([(1, "ab", True), (None, "c", False), (3, None, True), (3, "ab", None)], "i int, s string, f boolean")
    for exact in (True, False):
        out = {r["column_name"]: r for r in A.column_stats(df, exact).collect()}
        i, s, f = out["i"], out["s"], out["f"]
        assert (i["n_null"], i["n_distinct"], i["min_value"], i["max_value"], i["max_length"]) == (1, 2, "1", "3", None)
        assert (s["n_null"], s["n_distinct"], s["max_length"], s["avg_length"]) == (1, 2, 2, pytest.approx(5 / 3))
        assert (f["n_true"], f["n_false"], f["n_null"]) == (2, 1, 1)


def test_multi_group_by(facts):
    out = A.multi_group_by(facts, {"a": ["g"], "b": ["g", "h"], "all": []}, {"n": ("count",)})
    got = Counter()
    for r in out.collect():
        got[(r["grouping"], r["key"])] += r["n"]
    name = lambda x: "\\N" if x is None else x
    expect = Counter()
    for r in facts.collect():
        expect[("a", name(r["g"]))] += 1
        expect[("b", f"{name(r['g'])}|{r['h']}")] += 1
        expect[("all", "")] += 1
    assert got == expect


def test_ngrams(spark):
    docs = ["The cat sat. The cat ran!", "a cat sat\nthe dog", "One", ""]
    words = X.sentence_words(spark.createDataFrame([(d,) for d in docs], "t string"), "t")
    top = [tuple(r) for r in X.top_ngrams(words, 2, 3).collect()]
    assert top == [("cat sat", 2), ("the cat", 2), ("a cat", 1)]
    assert [tuple(r) for r in X.top_context_ngrams(words, ["the", None], 5).collect()] == [("cat", 2), ("dog", 1)]
    assert [tuple(r) for r in X.top_context_ngrams(words, [None, "cat", None], 5).collect()] == [
        ("a sat", 1), ("the ran", 1), ("the sat", 1)]
    assert X.top_ngrams(words, 9, 3).count() == 0
    with pytest.raises(ValueError):
        X.top_context_ngrams(words, ["the"], 5)


class Spread:
    """Count and variance by pairwise merging."""

    state = "n bigint, mean double, m2 double"
    result = "n bigint, var double"

    def start(self, pdf):
        x = pdf.iloc[:, 0].dropna()
        if x.empty:
            return 0, 0.0, 0.0
        return len(x), float(x.mean()), float(((x - x.mean()) ** 2).sum())

    def merge(self, a, b):
        n = a[0] + b[0]
        if n == 0:
            return 0, 0.0, 0.0
        d = b[1] - a[1]
        return n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n

    def finish(self, s):
        return s[0], s[2] / s[0] if s[0] else None


def test_mergeable_aggregate(facts):
    got = {r["g"]: r for r in aggregate_with(facts.repartition(6), ["g"], ["v"], Spread()).collect()}
    groups = {}
    for r in facts.collect():
        groups.setdefault(r["g"], []).append(r["v"])
    assert set(got) == set(groups)
    for g, values in groups.items():
        known = [v for v in values if v is not None]
        assert got[g]["n"] == len(known) and got[g]["var"] == pytest.approx(statistics.pvariance(known))


# ---------------------------------------------------------------- joins


def test_array_payload_and_null_safe(spark):
    users = spark.createDataFrame(USERS, "id int, name string")
    arrays = spark.createDataFrame(ARRAYS, "id int, vals array<int>")
    assert rows(joins.map_join(users, arrays, ["id"]).where("id = 1")) == [(1, "A", [0, 1, 2])]
    a = spark.createDataFrame([(1,), (None,)], "x int")
    b = spark.createDataFrame([(1,), (None,), (None,)], "y int")
    assert joins.null_safe_join(a, b, {"x": "y"}).count() == 3
    assert a.join(b, a.x == b.y).count() == 1


def test_theta_join_is_bounded(spark, kv):
    bands = spark.createDataFrame([(0, 100), (100, 500)], "lo int, hi int")
    out = joins.theta_join(kv, bands, (F.col("key") >= F.col("lo")) & (F.col("key") < F.col("hi")))
    assert out.count() == 500
    with pytest.raises(ValueError):
        joins.theta_join(kv, kv.select(F.col("key").alias("o")), F.col("key") < F.col("o"), max_rows=100)


@pytest.mark.parametrize("hot", [None, 20])
def test_interval_join_has_no_row_cap(spark, kv, hot):
    spans = spark.createDataFrame([(float(i), i - 3.0, i + 4.5) for i in range(-10, 520)], "mid double, lo double, hi double")
    got = joins.interval_join(kv, "key", spans, "lo", "hi", 8.0, hot_rows=hot)
    want = kv.join(F.broadcast(spans), (F.col("key") >= F.col("lo")) & (F.col("key") < F.col("hi")))
    assert got.columns == want.columns and rows(got) == rows(want)


def test_semi_join(spark):
    members = spark.range(0, 4000, 2).select(F.col("id").alias("k"))
    probe = spark.range(40000).select(F.col("id").alias("k")).union(spark.createDataFrame([(None,)], "k bigint"))
    assert rows(joins.semi_join(probe, members.union(members), "k")) == [(k,) for k in range(0, 4000, 2)]


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
def test_null_safe_join_splits_null(spark, how):
    a = spark.range(300).select(F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("x"), F.col("id").alias("a"))
    b = spark.range(40).select(F.when(F.col("id") % 5 > 0, F.col("id") % 11).alias("y"), F.col("id").alias("b"))
    want = a.join(b, a.x.eqNullSafe(b.y), how)
    for hot in (None, 10):
        got = joins.null_safe_join(a, b, {"x": "y"}, how, hot)
        assert got.columns == want.columns and rows(got) == rows(want)


@pytest.mark.parametrize("how", ["left", "right", "full", "left_semi", "left_anti"])
def test_bucketed_outer_joins_with_hot_keys(spark, how):
    left = spark.range(600).select(F.when(F.col("id") < 300, 5).when(F.col("id") > 590, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    right = spark.range(0, 900, 3).select(F.when(F.col("id") < 100, 5).otherwise(F.col("id")).alias("k"), F.col("id").alias("b"))

    def save(label, df, buckets):
        name = f"bucketed_outer_{label}"
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        df.write.bucketBy(buckets[0], *buckets[1]).sortBy(*buckets[1]).saveAsTable(name)
        return spark.table(name)

    got = joins.bucketed_join(left, right, ["k"], 4, save, how, hot_rows=30)
    want = left.join(right, "k", how)
    assert got.schema.simpleString() == want.schema.simpleString() and rows(got) == rows(want)


@pytest.mark.parametrize("hot", [None, 50])
def test_bucketed_join(spark, hot):
    left = spark.range(1000).select(F.when(F.col("id") < 400, 5).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    right = spark.range(0, 1000, 3).select(F.col("id").alias("k"), F.col("id").alias("b")).union(
        spark.createDataFrame([(5, -1), (5, -2)], "k bigint, b bigint"))
    tables = []

    def save(label, df, buckets):
        name = f"bucketed_{label}_{hot or 0}"
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        df.write.bucketBy(buckets[0], *buckets[1]).sortBy(*buckets[1]).saveAsTable(name)
        tables.append(name)
        return spark.table(name)

    out = joins.bucketed_join(left, right, ["k"], 4, save, hot_rows=hot)
    assert rows(out) == rows(left.join(right, "k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joins.bucketed_join(left, right, ["k"], 4, save, hot_rows=hot)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert all(len(spark.table(t).inputFiles()) <= 4 for t in tables)  # a file per bucket, not per task
    for t in set(tables):
        spark.sql(f"DROP TABLE {t}")


# ---------------------------------------------------------------- scripts


def test_transform_round_trip_and_nulls(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (None, "it's \\ $x")], "k int, v string")
    assert set(rows(scripts.transform(df, "cat", "k int, v string"))) == set(rows(df))
    assert rows(scripts.transform(df.where("k = 1"), "tr a-z A-Z", "k int, v string")) == [(1, "A B")]


def test_transform_env_and_files(spark):
    df = spark.range(5).coalesce(1)
    program = "import sys, os\nfor line in sys.stdin:\n    print(os.environ['WHO'] + line.strip())\n"
    out = scripts.transform(df, 'python3 "$SCRIPT_DIR/tag.py"', "v string", env={"WHO": "it's $me "}, files={"tag.py": program})
    assert rows(out) == [(f"it's $me {i}",) for i in range(5)]


def test_transform_failures_and_partial_reading(spark):
    many = spark.range(200_000).coalesce(1)
    out = scripts.transform(many, "head -n 3", "v bigint", allow_partial=True)
    assert rows(out) == [(0,), (1,), (2,)]
    with pytest.raises(Exception):
        scripts.transform(spark.range(3), "exit 3", "v bigint").collect()


# ---------------------------------------------------------------- functions


def test_hive_meanings(spark):
    row = spark.range(1).select(
        numbers.divide(F.lit(1), F.lit(0)).alias("div0"), numbers.divide(F.lit(7), F.lit(2)).alias("div"),
        numbers.int_divide(F.lit(-7), F.lit(2)).alias("idiv"), numbers.int_divide(F.lit(7), F.lit(0)).alias("idiv0"),
        numbers.remainder(F.lit(-7), F.lit(3)).alias("rem"), numbers.positive_mod(F.lit(-7), F.lit(3)).alias("pmod"),
        numbers.log_or_null(F.lit(0.0)).alias("ln0"), casts.soft_cast(F.lit("x"), "int").alias("bad"),
        collections.size(F.lit(None).cast("array<int>")).alias("size_null"), collections.item(F.array(F.lit(4)), 1).alias("out"),
        collections.item(F.array(F.lit(4)), 0).alias("in_"), collections.entry(F.create_map(F.lit("a"), F.lit(1)), F.lit("b")).alias("nokey"),
        text.field(F.lit("b"), F.lit("a"), F.lit("b")).alias("f"), text.field(F.lit(None).cast("string"), F.lit("a")).alias("f0"),
        text.url_part(F.lit("not a url"), "HOST").alias("nohost"), text.url_part(F.lit("http://h/p?a=1&b=2#r"), "QUERY:b").alias("q"),
        dates.epoch_micros(F.lit("1969-12-31 23:59:59.5").cast("timestamp_ntz")).alias("us"),
        dates.epoch_seconds(F.lit("2024-02-29 01:02:03.9").cast("timestamp_ntz")).alias("s"),
    ).first().asDict()
    assert row == {
        "div0": None, "div": 3.5, "idiv": -3, "idiv0": None, "rem": -1, "pmod": 2, "ln0": None, "bad": None,
        "size_null": -1, "out": None, "in_": 4, "nokey": None, "f": 2, "f0": 0, "nohost": None, "q": "2",
        "us": -500000, "s": 1709168523,
    }
    with pytest.raises(ValueError):
        text.url_part(F.lit("x"), "FRAGMENT")
