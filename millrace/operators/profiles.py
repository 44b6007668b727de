"""Column profiles per block: sort order, step width, runs and distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.windows import Order, near_rows

def order_profile(
    df: DataFrame, block: list[str], order: Order, column: str, hot_rows: int | None = None
) -> DataFrame:
    """Per block: ``ascending``, ``descending`` or ``unordered``, and for ordered
    blocks the largest step between neighbours."""
    stepped = near_rows(
        df, block, order, 1, 0, {"_step": lambda w: F.col(column) - F.lag(column).over(w)}, hot_rows
    )
    up, down = F.coalesce(F.min("_step") >= 0, F.lit(True)), F.coalesce(F.max("_step") <= 0, F.lit(True))
    state = F.when(up, "ascending").when(down, "descending").otherwise("unordered")
    return stepped.groupBy(*block).agg(
        F.count(F.lit(1)).alias("n_rows"),
        state.alias("state"),
        F.when(up | down, F.coalesce(F.max(F.abs("_step")), F.lit(0))).alias("max_step"),
    )


def column_runs(
    df: DataFrame, block: list[str], order: Order, columns: list[str], hot_rows: int | None = None
) -> DataFrame:
    """Per block and column: values, runs of equal neighbours in the order, and
    distinct values. NULLs are left out. All columns share one window."""
    marked = near_rows(df, block, order, 1, 0, {f"_p_{c}": (lambda w, c=c: F.lag(c).over(w)) for c in columns}, hot_rows)
    starts = lambda c: F.col(c).isNotNull() & (F.col(f"_p_{c}").isNull() | (F.col(f"_p_{c}") != F.col(c)))
    counts = [F.struct(F.lit(c).alias("column_name"), F.count(c).alias("n_values"), F.count_if(starts(c)).alias("n_runs"),
                       F.count_distinct(c).alias("n_distinct")).alias(c) for c in columns]
    return marked.groupBy(*block).agg(*counts).select(*block, F.inline(F.array(*columns)))
