"""Scans that are dealt to tasks by rows before work that needs memory per row."""

import pytest
from pyspark.sql import functions as F

from millrace.plans import aggregates, user_code
from millrace.sources.scans import spread_rows


def test_one_split_becomes_tasks_of_so_many_rows(spark):
    df = spread_rows(spark.range(0, 1000, 1, 1), 100)
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 10 and sum(sizes) == 1000 and max(sizes) <= 110
    assert spread_rows(spark.range(0, 90, 1, 1), 100).rdd.getNumPartitions() == 1
    assert spread_rows(spark.range(0), 100).count() == 0


@pytest.mark.parametrize("module, key", [(aggregates, "agg_compute_stats"), (user_code, "udtf_polymorphic")])
def test_queries_deal_their_rows(spark, monkeypatch, module, key):
    monkeypatch.setattr(module, "TASK_ROWS", 300)
    plan = module.R.queries[key](spark, "/root/testdata/sf0.01")._jdf.queryExecution().toString()
    assert "RoundRobinPartitioning(5)" in plan
