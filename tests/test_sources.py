import os
import pathlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.catalog.tables import TableCatalog, temporary_database
from millrace.sources import scans, sinks, text_formats
from millrace.streaming import incremental
from tests.samples import KV_ROWS, NESTED_LINES, NESTED_SCHEMA, rows, text_lines


@pytest.fixture(scope="module")
def kv(spark):
    return spark.createDataFrame(KV_ROWS, "key int, val string")


def data_files(path):
    return [f for _, _, names in os.walk(path) for f in names if f.startswith("part-")]


def test_scan_pushes_filter_and_columns(spark, kv, tmp_path):
    path = str(tmp_path / "t")
    kv.write.parquet(path)
    plan = scans.scan(spark, path, ["val"], "key > 490")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(key,490)" in plan and "ReadSchema: struct<key:int,val:string>" in plan


def test_missing_partition_skips_only_itself(spark, kv, tmp_path):
    a, gone = str(tmp_path / "a"), str(tmp_path / "gone")
    kv.write.parquet(a)
    schema = T.StructType.fromDDL("key int, val string, p int")
    got = scans.scan_partitions(spark, {gone: {"p": 1}, a: {"p": 2}}, schema)
    assert rows(got.groupBy("p").count()) == [(2, 500)]
    assert scans.scan_or_empty(spark, gone, "x int").count() == 0


def test_schema_evolution(spark):
    old = spark.createDataFrame([("7", "x"), ("seven", "y")], "key string, val string")
    new = spark.createDataFrame([(1.5, 9)], "extra double, KEY int")
    got = scans.merge_partitions([old, new], "key bigint, val string, more date")
    assert rows(got) == [(7, "x", None), (9, None, None), (None, "y", None)] or set(rows(got)) == {
        (7, "x", None), (9, None, None), (None, "y", None)}


def test_nested_text(spark):
    df = text_formats.parse_delimited(text_lines(spark, NESTED_LINES), NESTED_SCHEMA)
    first, second, third, fourth = [r.asDict(True) for r in df.orderBy("a").collect()]
    assert first["c"] == [{"c001": "C001", "c002": "C002"}, {"c011": None, "c012": "C012"}]
    assert second["d"] == {"d01": ["d011", "d012"], "d02": None}
    assert third["b"] == [] and third["d"] == {"d01": [None, "d012"]}
    assert fourth == {"a": "a3", "b": None, "c": None, "d": None}
    again = text_formats.parse_delimited(text_formats.render_delimited(df), NESTED_SCHEMA)
    assert [r.asDict(True) for r in again.orderBy("a").collect()] == [first, second, third, fourth]


def test_own_delimiters_and_types(spark):
    lines = text_lines(spark, ["1|a,b|k=1;m=2|3.5", "x||k=z|", "2|NIL|NIL"])
    got = text_formats.parse_delimited(lines, "i int, a array<string>, m map<string,int>, d double", ("|", ",", "=", "?"), "NIL")
    assert [r["a"] for r in got.collect()] == [["a", "b"], [], None]
    flat = text_formats.parse_delimited(text_lines(spark, ["1:2:u^v"]), "a int, b int, s struct<x: string, y: string>", (":", "^"))
    assert flat.first()["s"] == ("u", "v")


def test_regex_rows(spark):
    got = text_formats.parse_regex(text_lines(spark, ["k1=v1", "no", "k2=v2 "]), r"(\w+)=(\w+)", ["k", "v"])
    assert set(rows(got)) == {("k1", "v1"), (None, None)}


def test_split_write_reads_source_once(spark, kv, tmp_path):
    parts = sinks.split_write(kv, {"low": "key < 100", "four": "key = 4", "none": "key < 0"}, str(tmp_path / "m"))
    assert rows(parts["low"]) == rows(kv.where("key < 100"))
    assert rows(parts["four"]) == rows(kv.where("key = 4"))
    assert parts["none"].count() == 0 and parts["none"].columns == kv.columns


def test_compaction(spark, kv, tmp_path):
    small, large = str(tmp_path / "s"), str(tmp_path / "l")
    kv.repartition(20).write.parquet(small)
    assert sinks.compact_files(spark, small, large) == 1
    assert len(data_files(small)) == 20 and len(data_files(large)) == 1
    assert rows(spark.read.parquet(large)) == rows(kv)


def test_compaction_keeps_partitions(spark, kv, tmp_path):
    small, large = str(tmp_path / "s"), str(tmp_path / "l")
    parts = kv.withColumn("p", F.format_string("0%d a", F.col("key") % 3))
    parts.repartition(9).write.partitionBy("p").parquet(small)
    sinks.compact_files(spark, small, large)
    assert len(data_files(large)) == 3 < len(data_files(small))
    folders = lambda d: sorted(x.name for x in pathlib.Path(d).iterdir() if x.is_dir())
    assert folders(large) == folders(small) and rows(spark.read.parquet(large)) == rows(parts)


def test_unseen_files_of_a_partitioned_directory(spark, kv, tmp_path):
    path = str(tmp_path / "in")
    parts = kv.withColumn("p", F.concat(F.lit("a "), F.col("key") % 2))
    parts.where("key < 100").write.partitionBy("p").parquet(path)
    seen = spark.createDataFrame(incremental.file_listing(spark, path).collect(), "file string")
    parts.where("key >= 100").write.mode("append").partitionBy("p").parquet(path)
    assert rows(incremental.read_unseen(spark, path, parts.schema, seen)) == rows(parts.where("key >= 100"))


def test_export_import(spark, kv, tmp_path):
    path = str(tmp_path / "x")
    source = kv.withColumn("p", F.col("key") % 3)
    sinks.export_table(source, path, ["p"])
    assert rows(sinks.import_table(spark, path)) == rows(source)
    assert sinks.import_table(spark, path, p=1).count() == source.where("p = 1").count()
    assert sinks.import_table(spark, path).schema["p"].dataType == T.IntegerType()


def test_overwrite_from_itself(spark, kv):
    with temporary_database(spark) as db:
        c, t = TableCatalog(spark), f"{db}.t"
        c.create(t, kv.withColumn("p", F.col("key") % 2), partition_by=["p"])
        c.insert_partition(t, spark.table(t).where("p = 1 and key < 100").drop("p"), True, p=1)
        assert spark.table(t).where("p = 1").count() == sum(k < 100 and k % 2 for k, _ in KV_ROWS)
        assert spark.table(t).where("p = 0").count() == sum(k % 2 == 0 for k, _ in KV_ROWS)
        c.insert_dynamic(t, spark.table(t).where("p = 0 and key < 50"), overwrite=True)
        assert spark.table(t).where("p = 0").count() == sum(k < 50 and k % 2 == 0 for k, _ in KV_ROWS)
        assert spark.table(t).where("p = 1").count() > 0
        c.overwrite(t, spark.table(t).where("key < 20"))
        assert spark.table(t).where("key >= 20").count() == 0
    assert not spark.catalog.databaseExists(db)


def test_odd_static_partition_values(spark):
    with temporary_database(spark) as db:
        c, t = TableCatalog(spark), f"{db}.t"
        df = spark.createDataFrame([(1, "x")], "k int, p string")
        c.create(t, df, partition_by=["p"])
        for v in ("it's", 'say "hi"', "back\\slash"):
            c.insert_partition(t, df.select("k"), p=v)
        assert {r["p"] for r in spark.table(t).collect()} == {"x", "it's", 'say "hi"', "back\\slash"}


def test_incremental_stream_and_batch(spark, kv, tmp_path):
    src, dst, chk = (str(tmp_path / d) for d in ("in", "out", "chk"))
    kv.limit(200).repartition(3).write.parquet(src)
    run = lambda: incremental.load_new_files(spark, src, kv.schema, dst, chk, max_files=1)
    assert run() == 200 and run() == 0
    seen = spark.createDataFrame(incremental.file_listing(spark, src).collect())
    assert seen.count() == 3
    kv.where("key < 50").write.mode("append").parquet(src)
    n = kv.where("key < 50").count()
    fresh = incremental.read_unseen(spark, src, kv.schema, seen)
    assert rows(fresh) == rows(kv.where("key < 50"))
    assert incremental.read_unseen(spark, src, kv.schema, incremental.file_listing(spark, src)).count() == 0
    assert run() == n and spark.read.schema(kv.schema).parquet(dst).count() == 200 + n


def test_spread_small(spark, kv, tmp_path):
    path = str(tmp_path / "one")
    kv.coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    assert scans.spread_small(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert scans.spread_small(df, split_bytes=1) is df
    assert scans.spread_small(kv) is kv
