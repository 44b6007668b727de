"""Counts and sums over the pairs of two inequalities, made without the pairs."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import inequality as Q
from millrace.operators.inequality import inequality_counts, inequality_sums, later_and_above


@given(st.lists(st.tuples(st.integers(0, 5), st.booleans(), st.integers(1, 9)), min_size=1, max_size=40))
@settings(max_examples=150, deadline=None)
def test_later_and_above(rows):
    value, asks = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows])
    (got,) = later_and_above(value, asks, [np.array([r[2] for r in rows], np.int64)])
    for i, (v, q, _) in enumerate(rows):
        assert got[i] == (sum(w for x, a, w in rows[i + 1 :] if x > v and not a) if q else 0)


def no_pairs(*_):
    raise AssertionError("pairs were made")


def sides(spark, n):
    left = spark.range(n).selectExpr("id AS a", "nullif(id % 17, 5) AS b", "IF(id % 31 = 0, CAST('NaN' AS DOUBLE), id % 23 / 4) AS c", "nullif(id % 3, 2) AS g")
    right = spark.range(n + 50).selectExpr("CAST(id * 7 % 19 AS INT) AS e", "CAST(id * 11 % 29 / 4 AS FLOAT) AS f", "nullif(id % 4, 1) AS h", "IF(id % 4 = 3, NULL, id % 10) AS w", "id % 8 / 2 AS v")
    return left, right


@pytest.mark.parametrize("ops", [("<", ">"), (">=", "<="), (">", ">="), ("<=", "<")])
def test_sums_and_counts(spark, monkeypatch, ops):
    monkeypatch.setattr(Q, "matches", no_pairs)
    left, right = sides(spark, 300)
    first, second = ("b", ops[0], "e"), ("c", ops[1], "f")
    plain = left.join(right, F.expr(f"b {ops[0]} e AND c {ops[1]} CAST(f AS DOUBLE)"))
    want = plain.groupBy("g", "h").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum("v").alias("v"))
    got = inequality_sums(left, right, first, second, ["g"], ["h"], {"w": "w", "v": "v"}, block=40)
    assert got.columns == ["g", "h", "n", "w", "v"]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    counts = inequality_counts(left, right, first, second, block=40)
    want = left.join(plain.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a", "left").fillna(0, ["n"])
    assert {r["a"]: r["n"] for r in counts.collect()} == {r["a"]: r["n"] for r in want.collect()}


def test_all_rows_equal_are_still_cut_into_strips(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(Q, "matches", no_pairs)
    monkeypatch.setattr(Q, "materialize", lambda df, label, plain=Q.materialize: sizes.append((label, plain(df, label))) or sizes[-1][1])
    rows = spark.range(20_000).selectExpr("id", "1 AS x", "2.5D AS y")
    counts = inequality_counts(rows, rows.selectExpr("x AS u", "y AS v"), ("x", "<=", "u"), ("y", ">=", "v"), block=2_000)
    assert counts.agg(F.min("n"), F.max("n"), F.count("n")).first() == (20_000, 20_000, 20_000)
    placed = dict(sizes)["inequality-second"]
    assert max(placed.groupBy(s).count().agg(F.max("count")).first()[0] for s in ("_ineq_s1", "_ineq_s2")) < 6_000


def test_many_groups_and_empty_sides(spark, monkeypatch):
    left, right = sides(spark, 60)
    conditions = (("b", "<", "e"), ("c", "<", "f"))
    assert inequality_sums(left, right.where("false"), *conditions, ["g"], ["h"], {"w": "w"}).count() == 0
    assert inequality_sums(left.where("false"), right, *conditions, ["g"], [], {"w": "w"}).count() == 0
    few = inequality_sums(left, right, *conditions, ["g"], ["h"], {"w": "w"})
    few = sorted(map(str, few.collect()))
    monkeypatch.setattr(Q, "GROUPS", 2)
    many = inequality_sums(left, right, *conditions, ["g"], ["h"], {"w": "w"})
    assert sorted(map(str, many.collect())) == few
