"""Scripts, user functions and table functions."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog.tables import temporary_database
from millrace.operators import scripts
from millrace.operators.sql_table_functions import Sessions, Unpivot, register_lateral, register_over_table
from millrace.operators.table_functions import table_function
from millrace.operators.user_functions import aggregate_segments, aggregate_with, scalar_function
from millrace.plans.registry import Registry, table
from millrace.scratch import materialize, new_name
from millrace.session import Warehouse
from millrace.sources.scans import spread_rows

R = Registry()
query = R.query
TASK_ROWS = 100_000  # rows of a task that calls a Python function for each


@query("script_transform", """
    SELECT o_orderkey AS k, nullif(o_orderstatus, 'P') AS status, o_totalprice AS price FROM orders""")
def script_transform(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "nullif(o_orderstatus, 'P') AS s", "o_totalprice")
    return scripts.transform(o, "cat", "k bigint, status string, price double")


@query("script_map_reduce", """
    SELECT o_orderpriority AS word, count(*) AS n FROM orders GROUP BY o_orderpriority""")
def script_map_reduce(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    mapped = scripts.transform(o, "cut -f2", "word string")
    # A combiner next to the mapper: only counts are shuffled, however often a word occurs.
    counted = scripts.transform(
        mapped.sortWithinPartitions("word"), r"uniq -c | sed 's/^ *\([0-9]*\) \(.*\)/\2\t\1/'", "word string, n bigint"
    )
    clustered = counted.repartition("word").sortWithinPartitions("word")  # one row per word and task
    return scripts.transform(
        clustered, "awk -F'\\t' '{s[$1] += $2} END {for (w in s) print w \"\\t\" s[w]}'", "word string, n bigint"
    )


@query("script_env", """
    SELECT 'EUR' AS unit, s_suppkey AS k, s_acctbal AS bal FROM supplier WHERE s_acctbal > 5000""")
def script_env(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    program = "BEGIN { FS = \"\\t\" } $2 > limit { print unit \"\\t\" $1 \"\\t\" $2 }"
    return scripts.transform(
        s, 'awk -v unit="$UNIT" -v limit="$LIMIT" -f "$SCRIPT_DIR/keep.awk"', "unit string, k bigint, bal double",
        env={"UNIT": "EUR", "LIMIT": "5000"}, files={"keep.awk": program},
    )


@query("udf_scalar", """
    SELECT p_partkey, p_retailprice * 100 + p_size AS code, p_name || '/' || p_brand AS label FROM part""")
def udf_scalar(spark, sf):
    name = new_name("price_code")

    def price_code(price: pd.Series, size: pd.Series) -> pd.Series:
        return price * 100 + size

    def label(a: pd.Series, b: pd.Series) -> pd.Series:
        return a + "/" + b

    scalar_function(spark, name, price_code, "double")
    join = scalar_function(spark, new_name("label"), label, "string")
    p = table(spark, sf, "part").withColumn("label", join("p_name", "p_brand"))
    return p.selectExpr("p_partkey", f"{name}(p_retailprice, p_size) AS code", "label")


class GeometricMean:
    """n, sum of logarithms, smallest and largest value."""

    state = "n bigint, logs double, lo double, hi double"
    result = "n bigint, geo_mean double, spread double"

    def start(self, rows: pd.DataFrame) -> tuple:
        x = rows.iloc[:, 0]
        return len(x), float(x.map(math.log).sum()), float(x.min()), float(x.max())

    def merge(self, a: tuple, b: tuple) -> tuple:
        return a[0] + b[0], a[1] + b[1], min(a[2], b[2]), max(a[3], b[3])

    def finish(self, state: tuple) -> tuple:
        return state[0], math.exp(state[1] / state[0]), state[3] - state[2]


@query("udaf_grouped", """
    SELECT nullif(o_orderstatus, 'P') AS s, count(*) AS n, round(exp(avg(ln(o_totalprice))), 4) AS geo_mean,
           round(max(o_totalprice) - min(o_totalprice), 4) AS spread FROM orders GROUP BY 1""")
def udaf_grouped(spark, sf):
    o = table(spark, sf, "orders").selectExpr("nullif(o_orderstatus, 'P') AS s", "o_totalprice")
    out = aggregate_with(o, ["s"], ["o_totalprice"], GeometricMean())
    return out.select("s", "n", F.round("geo_mean", 4).alias("geo_mean"), F.round("spread", 4).alias("spread"))


class LogSums:
    """The geometric mean for many groups at a time."""

    state = "n bigint, logs double, lo double, hi double"
    result = "n bigint, geo_mean double, spread double"

    def fold(self, rows, starts):
        x = rows.column(0).to_numpy()
        return np.diff(starts, append=len(x)), np.add.reduceat(np.log(x), starts), np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)

    def merge(self, states, starts):
        n, logs, lo, hi = (c.to_numpy() for c in states.columns)
        return np.add.reduceat(n, starts), np.add.reduceat(logs, starts), np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts)

    def finish(self, states):
        n, logs, lo, hi = (c.to_numpy() for c in states.columns)
        return n, np.exp(logs / n), hi - lo


@query("udaf_many_keys", """
    SELECT l_orderkey, count(*) AS n, round(exp(avg(ln(l_extendedprice))), 4) AS geo_mean,
           round(max(l_extendedprice) - min(l_extendedprice), 4) AS spread FROM lineitem GROUP BY l_orderkey""")
def udaf_many_keys(spark, sf):
    # One key per order: a call takes thousands of them.
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice")
    out = aggregate_segments(l, ["l_orderkey"], ["l_extendedprice"], LogSums())
    return out.select("l_orderkey", "n", F.round("geo_mean", 4).alias("geo_mean"), F.round("spread", 4).alias("spread"))


@table_function("v bigint")
def shift_and_cap(rows: DataFrame, n: int, cap: int) -> DataFrame:
    """Keys moved up by ``n``, kept below ``cap``."""
    key = F.col(rows.columns[0]) + n
    return rows.select(key.alias("v")).where(F.col("v") < cap)


@table_function()
def shift_any(spark: SparkSession, rows: DataFrame, n: int, cap: int) -> tuple[DataFrame, str]:
    """As above; the result's column name and type follow the input's."""
    first = rows.schema.fields[0]
    moved = spark.sql("SELECT x + :n AS v FROM {rows}", args={"n": n}, rows=rows.select(F.col(first.name).alias("x")))
    return moved.where(F.col("v") < cap), f"shifted_{first.name} {first.dataType.simpleString()}"


CAP = 10**12  # above every key: the whole table goes through
SHIFTED = f"SELECT o_custkey + 15 AS {{name}} FROM orders WHERE o_custkey + 15 < {CAP}"


def _with_view(spark, sf, run):
    view = new_name("keys")
    table(spark, sf, "orders").select("o_custkey", "o_orderkey").createOrReplaceTempView(view)
    wh = Warehouse(spark)
    wh.register(shift_and_cap)
    wh.register(shift_any)
    try:
        return run(wh, view)
    finally:
        spark.catalog.dropTempView(view)


@query("tgf_static_schema", SHIFTED.format(name="v"))
def tgf_static_schema(spark, sf):
    return _with_view(spark, sf, lambda wh, view: wh.generate("shift_and_cap", view, 15, CAP))


@query("tgf_dynamic_schema", SHIFTED.format(name="shifted_o_custkey"))
def tgf_dynamic_schema(spark, sf):
    return _with_view(spark, sf, lambda wh, view: wh.sql_df(f"generate shift_any({view}, 15, {CAP})"))


@query("tgf_save_as", "SELECT v, count(*) AS n FROM (" + SHIFTED.format(name="v") + ") t GROUP BY v")
def tgf_save_as(spark, sf):
    def run(wh, view):
        with temporary_database(spark) as db:
            wh.generate("shift_and_cap", view, 15, CAP, as_table=f"{db}.shifted")
            return materialize(spark.table(f"{db}.shifted").groupBy("v").agg(F.count(F.lit(1)).alias("n")))

    return _with_view(spark, sf, run)


def _digits(text):
    return enumerate(int(c) for c in text or "" if c.isdigit())


@query("udtf_polymorphic", """
    SELECT name, digit, count(*) AS n, count(DISTINCT c_custkey) AS customers FROM
      (SELECT c_custkey, name, CAST(unnest(string_split(regexp_replace(value, '[^0-9]', '', 'g'), '')) AS INT) AS digit
       FROM (SELECT c_custkey, 'c_name' AS name, c_name AS value FROM customer
             UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer) u) d
    GROUP BY name, digit""")
def udtf_polymorphic(spark, sf):
    # The first function's columns depend on its arguments, the second runs beside each of its rows.
    register_over_table(spark, "unpivot_columns", Unpivot())
    register_lateral(spark, "digits_of", _digits, "place int, digit int")
    return spark.sql("""
        SELECT name, digit, count(*) AS n, count(DISTINCT c_custkey) AS customers
        FROM unpivot_columns(TABLE(SELECT c_custkey, c_name, c_nationkey FROM {c}), 'c_custkey') u, LATERAL digits_of(u.value)
        GROUP BY name, digit""", c=spread_rows(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), TASK_ROWS))


@query("udtf_partitions", """
    SELECT user_id, count(*) AS n, max(s) AS sessions FROM
      (SELECT user_id, sum(CASE WHEN ts - before > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
         (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before
          FROM (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events) e) b) t
    GROUP BY user_id""")
def udtf_partitions(spark, sf):
    register_over_table(spark, "number_sessions", Sessions())
    e = table(spark, sf, "events").select("user_id", "event_id", F.unix_timestamp("ts").alias("ts"))
    return spark.sql("""
        SELECT user_id, count(*) AS n, max(session) AS sessions
        FROM number_sessions(TABLE({e}) PARTITION BY user_id ORDER BY (ts, event_id), 'ts', 3600)
        GROUP BY user_id""", e=e)
