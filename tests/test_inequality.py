"""Joins on two inequalities, beside Spark's own comparison of all pairs."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import inequality as Q
from millrace.operators.inequality import inequality_counts, inequality_join, matches

COMPARE = {"<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal}


@given(
    st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=25), st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=25),
    st.sampled_from(sorted(COMPARE)), st.sampled_from(sorted(COMPARE)),
)
@settings(max_examples=150, deadline=None)
def test_pairs_inside_a_block(left, right, first, second):
    lx, ly = np.array([r[0] for r in left], np.int64), np.array([r[1] for r in left], np.int64)
    rx, ry = np.array([r[0] for r in right], np.int64), np.array([r[1] for r in right], np.int64)
    i, j = matches(lx, rx, ly, ry, (first, second))
    want = COMPARE[first](lx[:, None], rx[None]) & COMPARE[second](ly[:, None], ry[None])
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(want))))


def sides(spark, seed, hot):
    rng = random.Random(seed)
    row = lambda i: (i, None if rng.random() < 0.05 else 7 if hot else rng.randrange(50), float("nan") if rng.random() < 0.05 else rng.randrange(40) / 4)
    return spark.createDataFrame([row(i) for i in range(300)], "a long, b int, c double"), spark.createDataFrame([row(i) for i in range(350)], "d long, e bigint, f float")


@pytest.mark.parametrize("ops, hot, nested", [(("<", ">"), False, 2000), ((">=", "<="), True, 2000), ((">", ">="), False, 6)])
def test_join_and_counts(spark, monkeypatch, ops, hot, nested):
    monkeypatch.setattr(Q, "NESTED", nested)
    left, right = sides(spark, 3, hot)
    first, second = ("b", ops[0], "e"), ("c", ops[1], "f")
    plain = left.join(right, F.expr(f"b {ops[0]} e AND c {ops[1]} CAST(f AS DOUBLE)"), "left")
    want = sorted(tuple(r) for r in plain.where("d IS NOT NULL").select("a", "d").collect())
    got = inequality_join(left, right, first, second, block=40)
    assert got.columns == ["a", "b", "c", "d", "e", "f"]
    assert sorted(tuple(r) for r in got.select("a", "d").collect()) == want
    if nested > 6:
        counts = inequality_counts(left, right, first, second, block=40)
        assert {r["a"]: r["n"] for r in counts.collect()} == {r["a"]: r["n"] for r in plain.groupBy("a").agg(F.count("d").alias("n")).collect()}


def test_no_block_is_large_where_all_rows_share_a_value(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("x"), F.lit(2.5).alias("y"), "id")
    kinds = [("x", Q._kind(rows.schema["x"].dataType, rows.schema["x"].dataType)), ("y", rows.schema["y"].dataType)]
    blocks = Q._blocks(rows, kinds, 500, "test")
    assert blocks.groupBy(Q.CELL).count().agg(F.max("count")).first()[0] <= 500
    assert blocks.count() == 20_000


def test_boxes_that_cannot_match_do_not_meet(spark):
    rows = spark.range(40_000).select("id", (F.col("id") % 200).alias("x"), (F.col("id") % 197).alias("y"))
    kinds = [("x", rows.schema["x"].dataType), ("y", rows.schema["y"].dataType)]
    boxes = Q._boxes(Q._blocks(rows, kinds, 500, "test"))
    n = boxes.count()
    met = Q._pairs(boxes, boxes, ("<", ">")).count()
    assert n >= 80 and met < 0.45 * n * n  # about a quarter of all pairs can match


def test_dates_decimals_and_texts(spark):
    left = spark.sql("SELECT id AS a, date_add(DATE'2024-01-01', CAST(id AS INT)) AS b, CAST(id AS DECIMAL(6,2)) AS c, concat('k', id) AS s FROM range(30)")
    right = spark.sql("SELECT id AS d, date_add(DATE'2024-01-05', CAST(id * 2 AS INT)) AS e, CAST(id * 3 AS DECIMAL(8,3)) AS f, concat('k', id % 7) AS t FROM range(20)")
    for first, second in ((("b", "<", "e"), ("c", ">=", "f")), (("s", ">", "t"), ("b", "<=", "e"))):
        want = left.join(right, F.expr(f"{' '.join(first)} AND {' '.join(second)}")).count()
        assert inequality_join(left, right, first, second).count() == want > 0


def test_refusals_and_empty_sides(spark):
    left, right = spark.range(3).toDF("a"), spark.range(3).selectExpr("id AS b", "CAST(id AS STRING) AS s")
    with pytest.raises(ValueError, match="operators"):
        inequality_join(left, right, ("a", "=", "b"), ("a", "<", "b"))
    with pytest.raises(ValueError, match="order"):
        inequality_join(left, right, ("a", "<", "s"), ("a", "<", "b"))
    with pytest.raises(ValueError, match="names"):
        inequality_join(left, left, ("a", "<", "a"), ("a", "<", "a"))
    assert inequality_join(left.where("false"), right, ("a", "<", "b"), ("a", "<", "b")).count() == 0
    assert [r["n"] for r in inequality_counts(left, right.where("false"), ("a", "<", "b"), ("a", "<", "b")).collect()] == [0, 0, 0]
