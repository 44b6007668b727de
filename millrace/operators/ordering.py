"""Sorting, limits and distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.windows import Order, order_cols
from millrace.skew import LEFT_WAYS, RIGHT_WAYS, _marked, _marks, hot_keys, row_salt

SPREAD = "_spread"


def total_sort(df: DataFrame, order: Order, *tie_breakers: str) -> DataFrame:
    """ORDER BY. Tie breakers let the range partitioning cut through a value
    that many rows share, so one popular value does not fill one task."""
    return df.orderBy(*order_cols([*order, *[(c, "asc") for c in tie_breakers]]))


def top_k(df: DataFrame, order: Order, k: int) -> DataFrame:
    """ORDER BY ... LIMIT k: k rows per task, merged on the driver's behalf."""
    return df.orderBy(*order_cols(order)).limit(k)


def distribute_by(
    df: DataFrame, keys: list[str], parts: int | None = None, spread: bool = False, hot_rows: int | None = None
) -> DataFrame:
    """DISTRIBUTE BY: rows of one key share a partition, however many they are.
    Only with ``spread`` a key too large for one task goes to as many partitions
    as it has pieces. Without ``parts`` the session's shuffle partitions apply
    and AQE merges small ones."""
    count = [parts] if parts else []
    hot = hot_keys(df, keys, hot_rows) if spread else []
    if not hot:
        return df.repartition(*count, *keys)
    marked = _marked(df, _marks(df, keys, hot, []), keys)
    salted = marked.withColumn(SPREAD, row_salt(df, F.col(LEFT_WAYS)))
    return salted.repartition(*count, *keys, SPREAD).drop(LEFT_WAYS, RIGHT_WAYS, SPREAD)


def cluster_by(
    df: DataFrame, keys: list[str], parts: int | None = None, spread: bool = False, hot_rows: int | None = None
) -> DataFrame:
    """CLUSTER BY = DISTRIBUTE BY + SORT BY the same keys."""
    return distribute_by(df, keys, parts, spread, hot_rows).sortWithinPartitions(*keys)


def first_in_groups(df: DataFrame, groups: list[str], order: Order, k: int) -> DataFrame:
    """The k first rows of every group. Spark cuts each task's share of a group
    to k rows before the shuffle (WindowGroupLimit), so group size is no concern."""
    w = Window.partitionBy(*groups).orderBy(*order_cols(order))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def sort_by_limit(df: DataFrame, order: Order, k: int) -> DataFrame:
    """SORT BY ... LIMIT k: the k first rows of every partition, without a shuffle
    of more than k rows per partition."""
    return first_in_groups(df.withColumn("_part", F.spark_partition_id()), ["_part"], order, k).drop("_part")
