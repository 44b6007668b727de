import pytest
from pyspark.sql import functions as F

from millrace import skew


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=lambda r: tuple((x is not None, x) for x in r))


@pytest.fixture(scope="module")
def sides(spark):
    """Key 1 is hot on the left, key 2 on the right, 3 on both, NULL on both."""
    key = lambda a, b, c: (
        F.when(F.col("id") < a, 1).when(F.col("id") < b, 2).when(F.col("id") < c, 3)
        .when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 300 + 10).cast("bigint")
    )
    left = spark.range(900).select(key(300, 303, 380).alias("k"), F.col("id").alias("a")).repartition(4)
    right = spark.range(800).select(key(2, 250, 300).alias("k"), (F.col("id") * 2).alias("b")).repartition(5)
    return left, right


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
def test_skew_join_equals_plain_join(sides, how):
    left, right = sides
    got = skew.skew_join(left, right, ["k"], how, hot_rows=30)
    plain = left.join(right, ["k"], how)
    assert got.columns == plain.columns
    assert rows(got) == rows(plain)


def test_hot_keys_are_bounded(sides):
    left, _ = sides
    found = {h.key[0] for h in skew.hot_keys(left, ["k"], 60)}
    assert found == {1, 3, None}
    assert skew.hot_keys(left, ["k"]) == []


def test_counting_on_a_sample(spark, monkeypatch):
    monkeypatch.setattr(skew, "COUNTED_ROWS", 2000)
    df = spark.range(40000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    (hot,) = skew.hot_keys(df, ["k"], 1000)
    assert hot.key == (7,) and 8000 < hot.rows < 20000 and hot.pieces > 5


def test_probes_and_unique_sides(sides):
    left, right = sides
    grouped = right.groupBy("k").agg(F.max("b").alias("b"))
    for how in ("inner", "left", "right", "full"):
        got = skew.skew_join(left, grouped, ["k"], how, 30, probe_left=left.select("k"), unique_right=True)
        assert rows(got) == rows(left.join(grouped, ["k"], how))


@pytest.mark.parametrize("how", ["left", "right", "full"])
@pytest.mark.parametrize("hot", [None, 30])
def test_on_filters(sides, how, hot):
    from millrace.operators.joins import outer_join_with_filters

    left = sides[0].withColumn("lk", F.col("k"))
    right = sides[1].withColumn("rk", F.col("k"))
    got = outer_join_with_filters(left, right, ["k"], how, F.col("a") > 200, F.col("b") < 900, hot)
    l, r = left.drop("k"), right.drop("k")
    plain = l.join(r, (l.lk == r.rk) & (l.a > 200) & (r.b < 900), how)
    assert rows(got) == rows(plain)


def test_broadcast_check(spark):
    df = spark.range(1000).select(F.repeat(F.lit("x"), 100).alias("s"))
    assert skew.fits_broadcast(df)
    assert not skew.fits_broadcast(df, max_rows=999)
    assert not skew.fits_broadcast(df, max_bytes=100_000)
    assert "broadcast" not in skew.checked_broadcast(df, max_rows=10)._jdf.queryExecution().analyzed().toString()


def test_an_input_is_looked_at_once(spark, monkeypatch):
    """Joins of a query share the detection; another table, key or limit is asked anew."""
    looked = []
    detect = skew._detect
    monkeypatch.setattr(skew, "_detect", lambda df, keys, floor: looked.append((tuple(keys), floor)) or detect(df, keys, floor))
    monkeypatch.setattr(skew, "_detected", {})
    rows = spark.range(3000).selectExpr("IF(id % 3 = 0, 7, id) AS k", "id % 2 AS j", "id AS v")
    first = skew.hot_keys(rows, ["k"], 100)
    assert [h.key for h in first] == [(7,)] and skew.hot_keys(rows, ["k"], 100) == first
    assert skew.hot_keys(rows, ["j"], 100) and skew.hot_keys(rows, ["k"], 200) and skew.hot_keys(rows.where("v > 5"), ["k"], 100)
    assert looked == [(("k",), 100), (("j",), 100), (("k",), 200), (("k",), 100)]
