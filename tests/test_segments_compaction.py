"""User aggregates over segments, compaction in place, uneven buckets, typed keys."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.catalog.tables import temporary_database
from millrace.operators import aggregates as A
from millrace.operators import joins
from millrace.operators.user_functions import aggregate_segments, segment_starts
from millrace.sources.sinks import best_fit, compact_partition


class Sums:
    state = "n bigint, total double"
    result = "n bigint, mean double"

    def __init__(self, calls=None):
        self.calls = calls

    def fold(self, rows, starts):
        if self.calls is not None:
            self.calls.add(1)
        x = np.nan_to_num(rows.column(0).cast(pa.float64()).to_numpy(zero_copy_only=False))
        return np.diff(starts, append=len(x)), np.add.reduceat(x, starts)

    def merge(self, states, starts):
        if self.calls is not None:
            self.calls.add(1)
        return [np.add.reduceat(c.to_numpy(), starts) for c in states.columns]

    def finish(self, states):
        n, total = (c.to_numpy() for c in states.columns)
        return n, total / n


def test_segment_starts():
    keys = pa.table({"a": pa.array([None, None, 1.0, float("nan"), float("nan"), 2.0]), "b": ["x", "x", "x", "x", "y", "y"]})
    assert segment_starts(keys).tolist() == [0, 2, 3, 4, 5]
    assert segment_starts(keys[:0]).tolist() == [] and segment_starts(keys[:1]).tolist() == [0]


def test_aggregate_segments(spark):
    rows = spark.range(5000).selectExpr("nullif(id % 7, 3) AS a", "CASE WHEN id % 5 = 0 THEN double('NaN') ELSE id % 5 END AS b", "CAST(id AS INT) AS v").repartition(4)
    got = sorted(map(str, aggregate_segments(rows, ["a", "b"], ["v"], Sums()).collect()))
    want = sorted(map(str, rows.groupBy("a", "b").agg(F.count("v").alias("n"), F.avg("v").alias("mean")).collect()))
    assert got == want and len(want) == 35
    assert aggregate_segments(rows.where("false"), ["a"], ["v"], Sums()).count() == 0


def test_calls_follow_batches_not_keys(spark):
    calls = spark.sparkContext.accumulator(0)
    rows = spark.range(0, 60_000, 1, 4).selectExpr("id AS k", "CAST(id AS DOUBLE) AS v")
    done = aggregate_segments(rows, ["k"], ["v"], Sums(calls))
    assert done.agg(F.sum("n")).first()[0] == 60_000
    assert calls.value < 60  # 60,000 keys


def test_hot_key_crosses_batches(spark):
    rows = spark.range(0, 120_000, 1, 6).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k", "1.0D AS v")
    got = {r["k"]: r["n"] for r in aggregate_segments(rows, ["k"], ["v"], Sums()).where("n > 1").collect()}
    assert got == {7: 40_001}


def test_best_fit():
    sizes = {f"f{i}": s for i, s in enumerate((70, 60, 50, 40, 30, 20, 120))}
    bins = best_fit(sizes, 100)
    loads = {b: sum(sizes[f] for f in bins if bins[f] == b) for b in bins.values()}
    assert sorted(loads.values()) == [70, 100, 100, 120] or max(v for v in loads.values() if v != 120) <= 100
    assert set(bins) == set(sizes) and len(loads) == 4 and set(loads) == set(range(4))
    assert best_fit({}, 10) == {}


def test_compaction_while_a_reader_reads(spark):
    with temporary_database(spark) as db:
        rows = spark.range(4000).selectExpr("id", "concat('v', id) AS v", "CASE WHEN id % 2 = 0 THEN 'a b/+%' END AS p")
        rows.repartition(9).write.partitionBy("p").saveAsTable(f"{db}.t")
        began = spark.table(f"{db}.t").where("p = 'a b/+%'")
        began.queryExecution if hasattr(began, "queryExecution") else began.explain()  # planned on the old files
        done = compact_partition(spark, f"{db}.t", {"p": "a b/+%"}, 1 << 20)
        assert (done.before, done.after) == (9, 1) and len(done.old_files) == 9
        assert began.count() == 2000  # the swap has happened, the old files are there
        assert spark.table(f"{db}.t").count() == 4000
        assert spark.table(f"{db}.t").where("p = 'a b/+%'").select(F.input_file_name()).distinct().count() == 1
        done.remove_old()
        assert spark.table(f"{db}.t").where("p = 'a b/+%'").agg(F.sum("id")).first()[0] == sum(range(0, 4000, 2))
        again = compact_partition(spark, f"{db}.t", {"p": "a b/+%"}, 1 << 20)
        assert again.before == again.after == 1 and not again.old_files  # nothing to gain


def test_compaction_without_partitions_and_after_a_failure(spark, monkeypatch):
    with temporary_database(spark) as db:
        spark.range(1000).repartition(6).write.saveAsTable(f"{db}.t")
        whole = spark.catalog.refreshTable
        monkeypatch.setattr(spark, "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            compact_partition(spark, f"{db}.t")
        monkeypatch.undo()
        assert spark.table(f"{db}.t").count() == 1000 and whole
        done = compact_partition(spark, f"{db}.t")
        assert done.after == 1
        done.remove_old()
        assert spark.table(f"{db}.t").count() == 1000 and not any(os.path.exists(f.removeprefix("file:")) for f in done.old_files)


def test_uneven_buckets_join_without_an_exchange(spark, capfd):
    with temporary_database(spark) as db:
        a = spark.range(2000).selectExpr("id % 300 AS k", "id AS x")
        b = spark.range(300).selectExpr("id AS k", "id * 2 AS y")
        for part in (0, 1):  # the second append keeps the buckets
            joins.append_bucketed(a.where(f"x % 2 = {part}"), f"{db}.a", 8, ["k"])
        joins.append_bucketed(b, f"{db}.b", 2, ["k"])
        with joins.uneven_buckets(spark):
            joined = spark.table(f"{db}.a").join(spark.table(f"{db}.b").hint("merge"), "k")
            capfd.readouterr()
            joined.explain()
            plan = capfd.readouterr().out
            assert "Exchange" not in plan and "SortMergeJoin" in plan
            assert joined.agg(F.sum("y"), F.count("x")).first()[:] == (a.join(b, "k").agg(F.sum("y")).first()[0], 2000)
        assert spark.conf.get("spark.sql.bucketing.coalesceBucketsInJoin.enabled") == "false"


def test_keys_that_look_alike_stay_apart(spark):
    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a", "b|c"), ("\\", None), ("\\N", None)], "x string, y string")
    out = A.multi_group_by(rows, {"both": ["x", "y"], "one": ["x"], "same": ["y", "x"]}, {"n": ("count",)})
    both = {(r["x"], r["y"]): (r["key"], r["n"]) for r in out.where("grouping = 'both'").collect()}
    assert both == {("a|b", "c"): ("a\\|b|c", 1), ("a", "b|c"): ("a|b\\|c", 2), ("\\", None): ("\\\\|\\N", 1), ("\\N", None): ("\\\\N|\\N", 1)}
    assert out.where("grouping = 'same'").count() == 4 and {r["n"] for r in out.where("grouping = 'one' AND x = 'a'").collect()} == {2}


def test_cross_with_one_row_refuses_more(spark):
    rows = spark.range(3)
    assert joins.cross_with_one_row(rows, spark.range(1).toDF("m")).count() == 3
    assert joins.cross_with_one_row(rows, spark.range(0).toDF("m")).count() == 0
    with pytest.raises(Exception, match="more than one row"):
        joins.cross_with_one_row(rows, spark.range(2).toDF("m")).collect()
