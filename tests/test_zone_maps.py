"""Skipping must never change an answer."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import profiles
from millrace.operators import zone_maps as Z
from tests.samples import rows


@pytest.fixture(scope="module")
def data(spark):
    return spark.range(2000).select(
        "id",
        F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 700).cast("int").alias("a"),
        F.when(F.col("id") < 300, None).otherwise(F.col("id") / 3).alias("b"),
        F.concat(F.lit("s"), F.lpad((F.col("id") % 90).cast("string"), 3, "0")).alias("s"),
    )



def block():
    return F.floor(F.col("id") / 100)


PREDICATES = [
    Z.Compare("id", "=", 512), Z.Compare("id", "<", 150), Z.Compare("a", "<=", 3), Z.Compare("b", ">", 650.0),
    Z.Compare("b", ">=", 660.0), Z.literal_first(1900, "<", "id"), Z.literal_first(5, ">=", "a"),
    Z.Between("id", 300, 420), Z.Between("id", 300, 420, negated=True), Z.Between("id", -5, 5000, negated=True),
    Z.OneOf("id", (5, 1999, 40000)), Z.IsNull("b"), Z.Compare("s", ">", "s085"), Z.Other("a % 7 = 3"),
    Z.Compare("id", "<", 100) | Z.Compare("id", ">", 1900), Z.Compare("id", ">", 100) & Z.Compare("a", "<", 50),
    (Z.IsNull("b") | Z.Compare("b", ">", 600.0)) & Z.Other("id % 2 = 0"), Z.Compare("b", "=", None),
]


@pytest.mark.parametrize("p", PREDICATES, ids=str)
def test_skipping_keeps_the_answer(data, p):
    zones = Z.zone_map(data, block(), ["id", "a", "b", "s"])
    assert rows(Z.prune(data, block(), zones, p)) == rows(data.where(p.exact()))


def test_blocks_are_dropped(data):
    zones = Z.zone_map(data, block(), ["id", "a", "b"])
    kept = lambda p: {r["block"] for r in Z.kept_blocks(zones, p).collect()}
    assert kept(Z.Between("id", 300, 420)) == {3, 4}
    assert kept(Z.Between("id", 300, 399, negated=True)) == set(range(20)) - {3}
    assert kept(Z.literal_first(1850, "<", "id")) == {18, 19}
    assert kept(Z.Compare("b", "<", 1e9)) == set(range(3, 20))  # all-NULL blocks drop out
    assert kept(Z.IsNull("b")) == {0, 1, 2}
    assert kept(Z.Other("id = 1")) == set(range(20))
    assert kept(Z.OneOf("id", (5, 1999))) == {0, 19}
    report = Z.skipping_report(zones, Z.Between("id", 300, 420)).first()
    assert (report["kept"], report["total"], report["rows_kept"], report["rows_total"]) == (2, 20, 200, 2000)


def test_empty_blocks_drop(spark):
    zones = spark.createDataFrame([(1, 0, None, None, 0)], "block bigint, n_rows bigint, min_id bigint, max_id bigint, nulls_id bigint")
    assert Z.kept_blocks(zones, Z.Other("true")).count() == 0


def test_append_merges(data):
    cols = ["id", "a", "b", "s"]
    parts = [Z.zone_map(data.where(c), block(), cols) for c in ("id < 950", "id >= 950")]
    assert rows(Z.merge_zone_maps(*parts)) == rows(Z.zone_map(data, block(), cols))


def test_files_as_blocks(spark, data, tmp_path):
    path = str(tmp_path / "files")
    data.repartitionByRange(8, "id").write.parquet(path)
    zones = Z.file_zone_map(spark, path, ["id", "b"])
    p = Z.Between("id", 300, 420)
    got = Z.scan_kept_files(spark, path, zones, p)
    assert rows(got) == rows(data.where(p.exact()))
    assert len(got.inputFiles()) < 8
    assert Z.scan_kept_files(spark, path, zones, Z.Compare("id", ">", 99999)).count() == 0


def test_order_profile(spark):
    df = spark.createDataFrame(
        [("up", 1, 1), ("up", 2, 1), ("up", 3, 9), ("down", 1, 9), ("down", 2, 2), ("mix", 1, 1), ("mix", 2, 5),
         ("mix", 3, 2), ("one", 1, 4)], "g string, t int, v int")
    for hot in (None, 1):
        got = {r["g"]: (r["state"], r["max_step"]) for r in profiles.order_profile(df, ["g"], [("t", "asc")], "v", hot).collect()}
        assert got == {"up": ("ascending", 8), "down": ("descending", 7), "mix": ("unordered", None), "one": ("ascending", 0)}


@pytest.mark.parametrize("hot", [None, 40])
def test_column_runs(spark, hot):
    n = 400
    ints, words = [i // 50 for i in range(n)], [f"w{i % 5}" if i % 9 else None for i in range(n)]
    df = spark.createDataFrame(list(zip(range(n), ints, words)), "t int, i int, w string").withColumn("g", F.lit(1))
    got = {r["column_name"]: tuple(r)[2:] for r in profiles.column_runs(df, ["g"], [("t", "asc")], ["i", "w"], hot).collect()}
    runs = sum(w is not None and (i == 0 or words[i - 1] != w) for i, w in enumerate(words))
    assert got == {"i": (400, 8, 8), "w": (sum(w is not None for w in words), runs, 5)}


def test_kept_files_of_a_partitioned_table(spark, tmp_path):
    """Partition columns come back, also for values that paths must escape."""
    path = str(tmp_path / "parts")
    df = spark.range(200).select("id", F.concat(F.lit("a b"), F.floor(F.col("id") / 50), F.lit(":x%")).alias("g"))
    df.write.partitionBy("g").parquet(path)
    zones = Z.file_zone_map(spark, path, ["id"])
    predicate = Z.Between("id", 60, 120) & Z.Other("g <> 'a b2:x%'")
    got = Z.scan_kept_files(spark, path, zones, predicate)
    assert sorted((r.id, r.g) for r in got.collect()) == [(i, "a b1:x%") for i in range(60, 100)]
    assert len(got.inputFiles()) < len(spark.read.parquet(path).inputFiles())
