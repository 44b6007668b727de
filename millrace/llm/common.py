"""What several operators share: key columns, tables read back, filtering by key."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.scratch import materialize
from millrace.skew import checked_broadcast

SPACES = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_of(column: str = "text") -> Column:
    """The text; NULL counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(col, UPPER, LOWER)


def word_count(column: str = "text") -> Column:
    """Words between runs of white space (space, tab, line breaks)."""
    trimmed = F.regexp_replace(text_of(column), f"^{SPACES}|{SPACES}$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACES))).cast("long")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder; lineage ends there."""
    return materialize(df, f"llm-{label}")


def packed(rows: DataFrame, *, leave_out: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """The given columns beside the whole row as one struct ``own``, so that no
    name of the rows can clash with a name of ours; ``select("own.*")`` unpacks."""
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in leave_out]
    return rows.select(*[c.alias(n) for n, c in columns.items()], F.struct(*kept).alias("own"))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what runs inside: whole texts
    are large, and a batch stands in the memory of the JVM and of Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def rows_with(df: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose key is (``left_semi``) or isn't (``left_anti``) in
    ``keys``. The keys are copied to all executors only if their measured size
    allows (1,000,000 rows and 64 MB); beyond that both sides are shuffled."""
    return df.join(checked_broadcast(keys), on, how)
