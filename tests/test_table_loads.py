"""Loading files into a catalog table, batch by batch, each exactly once."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from millrace.catalog.tables import temporary_database
from millrace.streaming.incremental import TableLoads, load_into_table


@pytest.fixture
def loads(spark, tmp_path):
    with temporary_database(spark) as db:
        schema = spark.range(1).selectExpr("id", "CAST(id AS STRING) AS p", "CAST(id AS INT) AS q").schema
        yield TableLoads(spark, f"{db}.t", schema, str(tmp_path / "table"), ["p", "q"])


def rows(spark, a, z):
    return spark.range(a, z).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN \"it's\" ELSE 'b/c=d' END AS p", "CAST(id % 2 AS INT) AS q")


def test_a_batch_is_added_once(spark, loads):
    assert loads.append(rows(spark, 0, 10), 0) and not loads.append(rows(spark, 0, 10), 0)
    assert loads.append(rows(spark, 10, 30), 7)
    t = spark.table(loads.name)
    assert t.count() == 30 and loads.ledger() == [0, 7]
    assert t.where("p = 'b/c=d' AND q = 1").count() == 5 and t.where("p IS NULL").count() == 10


def test_what_was_written_but_not_committed_does_not_show(spark, loads):
    spark.sql(f"CACHE TABLE {loads.name}")
    loads.append(rows(spark, 0, 6), 0)
    loads.write(rows(spark, 6, 8), 1)  # cut off here
    assert spark.table(loads.name).count() == 6 and loads.ledger() == [0]
    loads.append(rows(spark, 6, 12), 1)  # the same batch again, in full
    assert sorted(r["id"] for r in spark.table(loads.name).collect()) == list(range(12))


def test_an_empty_batch_is_in_the_ledger(spark, loads):
    loads.append(rows(spark, 0, 0), 4)
    assert loads.ledger() == [4] and spark.table(loads.name).count() == 0


def test_runs_over_arriving_files(spark, loads, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    rows(spark, 0, 5).coalesce(1).write.parquet(source)
    schema = rows(spark, 0, 1).schema
    load = lambda **more: load_into_table(spark, source, schema, loads, checkpoint, **more)
    assert load() == [0] and load() == [0]
    rows(spark, 5, 9).coalesce(1).write.mode("append").parquet(source)

    def cut_off(batch, number):
        loads.write(batch.limit(1), number)
        raise RuntimeError("lost")

    with pytest.raises(StreamingQueryException):
        load(append=cut_off)
    assert spark.table(loads.name).count() == 5
    rows(spark, 9, 12).coalesce(1).write.mode("append").parquet(source)
    load(max_files=1)
    assert loads.ledger() == [0, 1, 2]
    assert [r["id"] for r in spark.table(loads.name).orderBy("id").collect()] == list(range(12))
    assert spark.table(loads.name).groupBy("load").agg(F.count(F.lit(1)).alias("n")).count() == 3


def test_refuses_a_column_of_its_own_name(spark, tmp_path):
    with pytest.raises(ValueError, match="load"):
        TableLoads(spark, "x", spark.range(1).toDF("load").schema, str(tmp_path))
