"""Table functions called from SQL: schemas at analysis, batches, partitions."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import sql_table_functions as TF


class Sizes:
    """The size of each batch, and the partition's total at its end."""

    def schema(self, table, label):
        return T.StructType([T.StructField(label, T.LongType()), T.StructField("whole", T.BooleanType())])

    def start(self, label):
        return {"n": 0}

    def batch(self, state, rows, label):
        state["n"] += rows.num_rows
        yield pa.table({label: [rows.num_rows], "whole": [False]})

    def finish(self, state, label):
        yield pa.table({label: [state["n"]], "whole": [True]})


def test_batches_are_bounded(spark):
    TF.register_over_table(spark, "batch_sizes", Sizes())
    spark.range(0, 12_345, 1, 1).createOrReplaceTempView("numbers")
    got = spark.sql("SELECT * FROM batch_sizes(TABLE(numbers), 'size')")
    assert got.columns == ["size", "whole"]  # the literal names the column
    rows = got.collect()
    assert [r["size"] for r in rows if not r["whole"]] == [5000, 5000, 2345] and [r["size"] for r in rows if r["whole"]] == [12_345]
    one = spark.sql("SELECT * FROM batch_sizes(TABLE(SELECT id, id % 3 AS k FROM numbers) PARTITION BY (k), 'size') WHERE whole")
    assert sorted(r["size"] for r in one.collect()) == [4115, 4115, 4115]


def test_unpivot(spark):
    TF.register_over_table(spark, "unpivot_test", TF.Unpivot())
    spark.createDataFrame([(1, "a", None, 1.5), (2, None, 3, 2.0)], "k int, x string, y int, z double").createOrReplaceTempView("wide")
    got = spark.sql("SELECT * FROM unpivot_test(TABLE(wide), 'k, x') ORDER BY k, name")
    assert got.dtypes == [("k", "int"), ("x", "string"), ("name", "string"), ("value", "string")]
    assert [tuple(r) for r in got.collect()] == [(1, "a", "y", None), (1, "a", "z", "1.5"), (2, None, "y", "3"), (2, None, "z", "2.0")]
    with pytest.raises(Exception, match="no column 'q'"):
        spark.sql("SELECT * FROM unpivot_test(TABLE(wide), 'q')")
    with pytest.raises(Exception, match="a table"):
        spark.sql("SELECT * FROM unpivot_test(1, 'k')")


def test_sessions_carry_over_batches(spark, monkeypatch):
    monkeypatch.setattr(TF, "BATCH_ROWS", 3)
    TF.register_over_table(spark, "sessions_test", TF.Sessions())
    rows = spark.range(40).selectExpr("id % 2 AS k", "id", "CASE WHEN id = 7 THEN NULL ELSE id + 10 * (id div 8) END AS t")
    got = spark.sql("SELECT * FROM sessions_test(TABLE({rows}) PARTITION BY k ORDER BY id, 't', 5)".replace("ORDER BY id, ", "ORDER BY (id), "), rows=rows)
    assert {r["id"]: r["session"] for r in got.collect()} == {i: i // 8 for i in range(40)}


def test_lateral(spark):
    TF.register_lateral(spark, "letters_of", lambda text, n: ((c, i) for i, c in enumerate((text or "") * n)), "c string, i int")
    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "k int, s string")
    got = spark.sql("SELECT k, c, i FROM {rows} r, LATERAL letters_of(r.s, 2) ORDER BY k, i", rows=rows).collect()
    assert [tuple(r) for r in got] == [(1, "a", 0), (1, "b", 1), (1, "a", 2), (1, "b", 3)]
    assert spark.sql("SELECT k, c FROM {rows} r LEFT JOIN LATERAL letters_of(r.s, 1) ON true", rows=rows).where(F.col("c").isNull()).count() == 2
