"""Intervals that hold a value, joined and counted."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import joins


@pytest.mark.parametrize("hot_rows", [None, 20])
def test_counts_as_the_join(spark, monkeypatch, hot_rows):
    v = spark.range(400).selectExpr("id", "CASE WHEN id % 50 = 0 THEN NULL WHEN id % 51 = 0 THEN CAST('NaN' AS DOUBLE) WHEN id < 80 THEN 3D ELSE id * 7 % 90 / 4 END AS v")
    i = spark.range(150).selectExpr("id * 5 % 61 / 4 AS lo", "nullif(id * 5 % 61 / 4 + id % 9 - 2, 1) AS hi")
    pairs = v.join(i, F.expr("v >= lo AND v < hi"))
    want = {r["id"]: r["n"] for r in v.join(pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id", "left").fillna(0, ["n"]).collect()}
    joined = joins.interval_join(v, "v", i, "lo", "hi", 3.0, hot_rows=hot_rows)
    assert sorted(map(str, joined.select("id", "lo", "hi").collect())) == sorted(map(str, pairs.select("id", "lo", "hi").collect()))
    monkeypatch.setattr(joins, "interval_join", None)
    got = joins.interval_counts(v, "v", i, "lo", "hi", "n", hot_rows)
    assert got.columns == ["id", "v", "n"] and got.count() == 400
    assert {r["id"]: r["n"] for r in got.collect()} == want
    with pytest.raises(ValueError, match="types"):
        joins.interval_counts(v.withColumn("v", F.col("v").cast("float")), "v", i, "lo", "hi")


def test_all_values_equal(spark):
    """Before: 4,000,000 pairs for the rows of one value."""
    v, i = spark.range(2000).selectExpr("id", "1D AS v"), spark.range(2000).selectExpr("0D AS lo", "2D AS hi")
    got = joins.interval_counts(v, "v", i, "lo", "hi")
    assert got.agg(F.min("n"), F.max("n"), F.count("n")).first() == (2000, 2000, 2000)
