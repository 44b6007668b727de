"""Block statistics and data skipping.

A zone map is a DataFrame with one row per block: ``block``, ``n_rows`` and for
each column ``min_c``, ``max_c``, ``nulls_c``. NULLs stay outside min and max.
``distinct_c`` is a sketch of the distinct values where one was asked for.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.sketches import distinct_sketch
from millrace.skew import checked_broadcast

BLOCK = "block"
MAX_FILE_LIST = 200_000


def zone_map(df: DataFrame, block: Column, columns: list[str], distinct: list[str] | None = None) -> DataFrame:
    """Statistics of each block in one pass; ``distinct`` names the columns whose
    distinct values are sketched as well."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [distinct_sketch(c, df.schema[c].dataType).alias(f"distinct_{c}") for c in distinct or []]
    for c in columns:
        aggs += [
            F.min(c).alias(f"min_{c}"),
            F.max(c).alias(f"max_{c}"),
            F.count_if(F.col(c).isNull()).alias(f"nulls_{c}"),
        ]
    return df.groupBy(block.alias(BLOCK)).agg(*aggs)


def merge_zone_maps(*maps: DataFrame) -> DataFrame:
    """Statistics after an append; a block in several maps is merged."""
    both = reduce(lambda a, b: a.unionByName(b), maps)
    aggs = []
    for c in both.columns:
        if c != BLOCK:
            merge = F.min if c.startswith("min_") else F.max if c.startswith("max_") else F.hll_union_agg if c.startswith("distinct_") else F.sum
            aggs.append(merge(c).alias(c))
    return both.groupBy(BLOCK).agg(*aggs)


# ---------------------------------------------------------------- predicates


class Predicate:
    """A row condition that can also say which blocks may hold a match."""

    def exact(self) -> Column:
        raise NotImplementedError

    def may_match(self) -> Column:
        return F.lit(True)

    def __and__(self, other: Predicate) -> Predicate:
        return Both(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Either(self, other)


FLIPPED = {"=": "=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


@dataclass(frozen=True)
class Compare(Predicate):
    column: str
    op: str  # = < <= > >=
    value: Any

    def exact(self) -> Column:
        c, v = F.col(self.column), F.lit(self.value)
        return {"=": c == v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[self.op]

    def may_match(self) -> Column:
        lo, hi, v = F.col(f"min_{self.column}"), F.col(f"max_{self.column}"), F.lit(self.value)
        return {"=": (lo <= v) & (hi >= v), "<": lo < v, "<=": lo <= v, ">": hi > v, ">=": hi >= v}[self.op]


def literal_first(value: Any, op: str, column: str) -> Compare:
    """``5 < c`` is ``c > 5``."""
    return Compare(column, FLIPPED[op], value)


@dataclass(frozen=True)
class Between(Predicate):
    column: str
    low: Any
    high: Any
    negated: bool = False

    def exact(self) -> Column:
        inside = F.col(self.column).between(self.low, self.high)
        return ~inside if self.negated else inside

    def may_match(self) -> Column:
        lo, hi = F.col(f"min_{self.column}"), F.col(f"max_{self.column}")
        if self.negated:  # only a block that lies wholly inside is without a match
            return ~((lo >= F.lit(self.low)) & (hi <= F.lit(self.high)))
        return (lo <= F.lit(self.high)) & (hi >= F.lit(self.low))


@dataclass(frozen=True)
class OneOf(Predicate):
    column: str
    values: tuple

    def exact(self) -> Column:
        return F.col(self.column).isin(*self.values)

    def may_match(self) -> Column:
        return reduce(lambda a, b: a | b, [Compare(self.column, "=", v).may_match() for v in self.values])


@dataclass(frozen=True)
class IsNull(Predicate):
    column: str

    def exact(self) -> Column:
        return F.col(self.column).isNull()

    def may_match(self) -> Column:
        return F.col(f"nulls_{self.column}") > 0


@dataclass(frozen=True)
class Other(Predicate):
    """Any other condition: keeps every block."""

    condition: str

    def exact(self) -> Column:
        return F.expr(self.condition)


@dataclass(frozen=True)
class Both(Predicate):
    a: Predicate
    b: Predicate

    def exact(self) -> Column:
        return self.a.exact() & self.b.exact()

    def may_match(self) -> Column:
        return F.coalesce(self.a.may_match(), F.lit(False)) & F.coalesce(self.b.may_match(), F.lit(False))


@dataclass(frozen=True)
class Either(Predicate):
    a: Predicate
    b: Predicate

    def exact(self) -> Column:
        return self.a.exact() | self.b.exact()

    def may_match(self) -> Column:
        return F.coalesce(self.a.may_match(), F.lit(False)) | F.coalesce(self.b.may_match(), F.lit(False))


def kept_blocks(zones: DataFrame, predicate: Predicate) -> DataFrame:
    """Blocks that may hold a matching row; an all-NULL block has no minimum and
    drops out of comparisons."""
    return zones.where((F.col("n_rows") > 0) & F.coalesce(predicate.may_match(), F.lit(False)))


def prune(df: DataFrame, block: Column, zones: DataFrame, predicate: Predicate) -> DataFrame:
    """Rows that match, looked for in kept blocks only."""
    kept = checked_broadcast(kept_blocks(zones, predicate).select(F.col(BLOCK).alias("_block")))
    return df.withColumn("_block", block).join(kept, "_block", "left_semi").drop("_block").where(predicate.exact())


def skipping_report(zones: DataFrame, predicate: Predicate) -> DataFrame:
    keep = (F.col("n_rows") > 0) & F.coalesce(predicate.may_match(), F.lit(False))
    return zones.agg(
        F.count_if(keep).alias("kept"),
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum(F.when(keep, F.col("n_rows"))), F.lit(0)).alias("rows_kept"),
        F.sum("n_rows").alias("rows_total"),
    )


# ---------------------------------------------------------------- files as blocks


def file_zone_map(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """One row per data file."""
    return zone_map(spark.read.parquet(path), F.col("_metadata.file_path"), columns)


def scan_kept_files(spark: SparkSession, path: str, zones: DataFrame, predicate: Predicate) -> DataFrame:
    """Open only the files that may match. The list of names is bounded; beyond
    the bound all files are scanned, with the reader's own statistics."""
    kept = kept_blocks(zones, predicate).select(BLOCK).limit(MAX_FILE_LIST + 1).collect()
    whole = spark.read.parquet(path)
    if len(kept) > MAX_FILE_LIST:
        return whole.where(predicate.exact())
    if not kept:
        return whole.where(F.lit(False))
    # The names are URLs; basePath keeps the partition columns, as in a scan of the whole directory.
    names = [unquote(r[BLOCK]) for r in kept]
    return spark.read.schema(whole.schema).option("basePath", path).parquet(*names).where(predicate.exact())
