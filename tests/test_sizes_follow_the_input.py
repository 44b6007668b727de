"""Queries whose files and buckets become more, not larger, as the input grows."""

from pyspark.sql import functions as F

from millrace.plans import joins, storage


def test_files_stay_small_beside_the_target(spark, tmp_path):
    """Before: twelve files of over half a megabyte, of which no two fit together."""
    orders = spark.range(1_600_000, numPartitions=4).select(
        F.col("id").alias("o_orderkey"), F.rand(1).alias("o_totalprice"), F.element_at(F.array(*map(F.lit, "FOP")), (F.col("id") % 3 + 1).cast("int")).alias("o_orderstatus"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    done = storage.R.queries["compact_partition"](spark, str(tmp_path)).collect()
    assert sorted((r["o_orderstatus"], r["n"], r["fewer"]) for r in done) == [("F", 533_334, True), ("O", 533_333, True), ("P", 533_333, True)]


def test_buckets_follow_the_lines(spark, monkeypatch):
    made = []

    def append(df, name, buckets, keys, plain=joins.joins.append_bucketed):
        made.append(buckets)
        plain(df, name, buckets, keys)

    monkeypatch.setattr(joins, "BUCKET_ROWS", 10_000)
    monkeypatch.setattr(joins.joins, "append_bucketed", append)
    rows = joins.R.queries["join_bucketed_uneven"](spark, "/root/testdata/sf0.01")
    assert made == [6, 18, 18] and rows.agg(F.sum("n")).first()[0] == 60_000
