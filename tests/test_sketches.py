"""Sketches: errors within their bounds, merged or not."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators import sketches as S
from millrace.operators import zone_maps as Z


def test_distinct_counts_merge_without_a_second_scan(spark):
    rows = spark.range(30_000).selectExpr("id", "id % 5000 AS a", "nullif(id % 3, 0) AS b", "DATE'2024-01-01' + CAST(id % 90 AS INT) AS d", "id div 3000 AS k")
    columns = ["a", "b", "d"]
    parts = [Z.zone_map(rows.where(f"id % 2 = {i}"), F.col("k"), columns, columns) for i in (0, 1)]
    zones = Z.merge_zone_maps(*parts)
    assert zones.count() == 10
    got = S.distinct_estimates(zones, columns).first()
    assert abs(got["a"] - 5000) < 250 and got["b"] == 2 and abs(got["d"] - 90) <= 2
    each = S.distinct_estimates(zones, ["a"], ["block"]).collect()
    assert len(each) == 10 and all(abs(r["a"] - 3000) < 150 for r in each)
    none = Z.zone_map(rows.where("false"), F.col("k"), columns, columns)
    assert S.distinct_estimates(none, columns).first()["a"] == 0


def test_quantiles_of_merged_sketches(spark):
    rows = spark.range(40_000).selectExpr("id % 2 AS g", "CASE WHEN id % 97 = 0 THEN NULL WHEN id % 89 = 0 THEN double('NaN') ELSE power(id % 1000, 2) END AS v", "id % 40 AS block")
    points = {"low": 0.01, "mid": 0.5, "top": 0.99}
    merged = S.merge_quantile_sketches(S.quantile_sketches(rows, ["g", "block"], "v"), ["g"])
    errors = S.rank_errors(rows, ["g"], "v", S.sketched_quantiles(merged, points), points).collect()
    assert len(errors) == 6 and all(r["error"] <= 0.01 for r in errors)


def test_rank_error_is_seen(spark):
    rows = spark.range(100).selectExpr("1 AS g", "CAST(id AS DOUBLE) AS v")
    wrong = spark.createDataFrame([(1, 80.0)], "g int, mid double")
    assert S.rank_errors(rows, ["g"], "v", wrong, {"mid": 0.5}).first()["error"] == pytest.approx(0.3)


def words(n=20_000, seed=2):
    rng = random.Random(seed)
    return [f"w{min(int(rng.paretovariate(0.7)), 9000)}" if rng.random() < 0.9 else None for _ in range(n)]


@pytest.mark.parametrize("counters", [5, 60, 4096])
def test_heavy_hitters_bounds(spark, counters):
    data = words()
    items = spark.createDataFrame([(w,) for w in data], "item string").repartition(4)
    true = Counter(w for w in data if w is not None)
    got = {r["item"]: (r["lower"], r["upper"]) for r in S.heavy_hitters(items, counters).collect()}
    assert all(low <= true[w] <= high for w, (low, high) in got.items())
    lost = max((high - low for low, high in got.values()), default=0)
    assert lost <= sum(true.values()) / counters and all(w in got for w, n in true.items() if n > lost)


@pytest.mark.parametrize("counters", [3, 50, 4096])
def test_frequent_exactly(spark, counters):
    data = words()
    items = spark.createDataFrame([(w,) for w in data], "item string").repartition(3)
    want = sorted(Counter(w for w in data if w is not None).items(), key=lambda x: (-x[1], x[0]))[:12]
    assert [tuple(r) for r in S.frequent_exactly(items, 12, counters).collect()] == want
    assert S.frequent_exactly(items.where("false"), 12).count() == 0


def test_a_summary_is_bounded_however_many_items_there_are():
    run = S._summaries(100)
    batches = [pa.RecordBatch.from_arrays([pa.array([f"x{i}-{j}" for j in range(2000)] + ["hot"] * 400)], ["item"]) for i in range(20)]
    out = pa.Table.from_batches(run(iter(batches)))
    assert out.num_rows <= 101 and "hot" in out["item"].to_pylist()
