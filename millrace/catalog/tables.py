"""Cached tables: saved tables plus Spark's cache, tied by a table property."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import CatalogError
from millrace.operators.scripts import sql_text
from millrace.scratch import materialize, new_dir, new_name

PROPERTY = "millrace.cache"
NONE, MEMORY, MEMORY_ONLY = "NONE", "MEMORY", "MEMORY_ONLY"
LEVELS = {MEMORY: StorageLevel.MEMORY_AND_DISK, MEMORY_ONLY: StorageLevel.MEMORY_ONLY}
TRUE_WORDS = ("true", "memory", "yes", "1")


def cache_mode(text: str | bool | None) -> str:
    """Read a mode: ``true`` means MEMORY, ``false`` or nothing means NONE."""
    word = str(text or "").strip().lower()
    if word in ("", "false", "none", "no", "0"):
        return NONE
    if word in TRUE_WORDS:
        return MEMORY
    if word == "memory_only":
        return MEMORY_ONLY
    raise CatalogError(f"unknown cache mode {text!r}")


def gather(df: DataFrame, partition_columns: list[str]) -> DataFrame:
    """Bring the rows of a table partition together before they are written, so
    that not every task writes a file into every partition. A rebalance, not a
    plain repartition: AQE cuts a large partition into several tasks."""
    return df.hint("rebalance", *[F.col(c) for c in partition_columns])


@dataclass(frozen=True)
class Insert:
    """One target of a multi-insert: SQL expressions over the source's columns."""

    where: str = "true"
    columns: tuple[str, ...] = ("*",)
    group_by: tuple[str, ...] = ()
    overwrite: bool = False

    def rows(self, df: DataFrame) -> DataFrame:
        chosen = df.where(self.where)
        if self.group_by:
            return chosen.groupBy(*[F.expr(g) for g in self.group_by]).agg(*[F.expr(c) for c in self.columns])
        return chosen.selectExpr(*self.columns)


class TableCatalog:
    """Create, fill, cache and drop tables. MEMORY tables write through to their
    files; the cache and the files always agree. MEMORY_ONLY differs in its
    storage level: blocks that do not fit are computed again from the files."""

    def __init__(self, spark: SparkSession, cached_suffix: bool = False) -> None:
        self.spark = spark
        self.cached_suffix = cached_suffix

    # -- create

    def mode_for(self, name: str, cache: str | bool | None) -> str:
        if cache is None and self.cached_suffix and name.lower().endswith("_cached"):
            return MEMORY
        return cache_mode(cache)

    def create(
        self,
        name: str,
        df: DataFrame,
        cache: str | bool | None = None,
        partition_by: list[str] | None = None,
        bucket_by: tuple[int, list[str]] | None = None,
        mode: str = "errorifexists",
        format: str = "parquet",
    ) -> str:
        """CREATE TABLE AS SELECT. Returns the cache mode."""
        if partition_by:
            df = gather(df, partition_by)
        writer = df.write.format(format).mode(mode)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        if bucket_by:
            n, cols = bucket_by
            writer = writer.bucketBy(n, *cols).sortBy(*cols)
        writer.saveAsTable(name)
        chosen = self.mode_for(name, cache)
        self._set_property(name, chosen)
        if chosen != NONE:
            self._cache(name, chosen)
        return chosen

    def save_dataset(self, df: DataFrame, name: str, fields: list[str]) -> bool:
        """Save a dataset as a cached table under new column names. If its rows
        cannot be computed, no table is left behind and the answer is False."""
        if len(fields) != len(df.columns):
            raise CatalogError(f"{len(df.columns)} columns need {len(df.columns)} names, got {len(fields)}")
        if self.spark.catalog.tableExists(name):
            return False
        try:
            self.create(name, df.toDF(*fields), cache=MEMORY)
        except Exception:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            return False
        return True

    # -- cache state

    def _set_property(self, name: str, mode: str) -> None:
        self.spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{PROPERTY}' = '{mode}')")

    def _recorded(self, name: str) -> str | None:
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {name}").collect()
        return next((r["value"] for r in rows if r["key"] == PROPERTY), None)

    def mode(self, name: str) -> str:
        """The recorded cache mode of a table."""
        return cache_mode(self._recorded(name))

    def sync(self, name: str) -> str:
        """Bring the cache in line with a table's property, or with its name if
        the suffix rule is on and no property is set."""
        recorded = self._recorded(name)
        mode = self.mode_for(name, recorded)
        if recorded is None and mode != NONE:
            self._set_property(name, mode)
        if mode == NONE and self.is_cached(name):
            self.spark.catalog.uncacheTable(name)
        elif mode != NONE and not self.is_cached(name):
            self._cache(name, mode)
        return mode

    def _cache(self, name: str, mode: str) -> None:
        self.spark.catalog.cacheTable(name, LEVELS[mode])

    def cache(self, name: str, mode: str = MEMORY) -> None:
        """CACHE t. A table keeps its mode while cached."""
        wanted, now = cache_mode(mode), self.mode(name)
        if wanted == NONE:
            raise CatalogError("use uncache")
        if now not in (NONE, wanted) and self.is_cached(name):
            raise CatalogError(f"{name} is cached as {now}; uncache it before {wanted}")
        self._set_property(name, wanted)
        if not self.is_cached(name):
            self._cache(name, wanted)

    def uncache(self, name: str) -> None:
        """UNCACHE t: the table stays readable from its files."""
        self._set_property(name, NONE)
        if self.is_cached(name):
            self.spark.catalog.uncacheTable(name)

    def is_cached(self, name: str) -> bool:
        return self.spark.catalog.isCached(name)

    def reload(self, database: str | None = None) -> list[str]:
        """Bring the cache in line with the recorded property of every table, as
        at the start of a session. Returns the tables that are now cached."""
        database = database or self.spark.catalog.currentDatabase()
        return [
            name
            for t in self.spark.catalog.listTables(database)
            if not t.isTemporary and t.tableType != "VIEW"
            and self.sync(name := f"{database}.{t.name}") != NONE
        ]

    # -- change

    def insert(self, name: str, df: DataFrame) -> None:
        """INSERT INTO, by position; a cached table shows the new rows."""
        self._aligned(name, df).write.insertInto(name)

    def overwrite(self, name: str, df: DataFrame) -> None:
        """INSERT OVERWRITE; the rows may come from the table itself."""
        self._replace(self._aligned(name, df), lambda rows: rows.write.insertInto(name, overwrite=True))

    @staticmethod
    def _replace(df: DataFrame, write: Callable[[DataFrame], object]) -> None:
        """Write directly; only rows read from the target are staged first."""
        try:
            write(df)
        except AnalysisException as e:
            if not (e.getCondition() or "").startswith("UNSUPPORTED_OVERWRITE"):
                raise
            write(materialize(df, "overwrite"))

    def _aligned(self, name: str, df: DataFrame) -> DataFrame:
        target = self.spark.table(name)
        if len(target.columns) != len(df.columns):
            raise CatalogError(f"{name} has {len(target.columns)} columns, got {len(df.columns)}")
        return df.toDF(*target.columns)

    def insert_partition(self, name: str, df: DataFrame, overwrite: bool = False, **partition) -> None:
        """Static partition insert: ``PARTITION (k = v)``."""
        literal = lambda v: "NULL" if v is None else repr(v) if isinstance(v, (int, float)) else sql_text(str(v))
        spec = ", ".join(f"{k} = {literal(v)}" for k, v in partition.items())
        word = "OVERWRITE TABLE" if overwrite else "INTO"
        statement = f"INSERT {word} {name} PARTITION ({spec}) SELECT * FROM {{rows}}"
        self._replace(df, lambda rows: self.spark.sql(statement, rows=rows))

    def insert_dynamic(self, name: str, df: DataFrame, overwrite: bool = False) -> None:
        """Dynamic partition insert: the last columns name the partition. With
        ``overwrite`` only partitions that occur in ``df`` are replaced."""
        key = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(key, None)
        self.spark.conf.set(key, "dynamic")
        partitions = [c.name for c in self.spark.catalog.listColumns(name) if c.isPartition]
        rows = gather(df.toDF(*self.spark.table(name).columns), partitions)
        try:
            self._replace(rows, lambda rows: rows.write.insertInto(name, overwrite=overwrite))
        finally:
            self.spark.conf.unset(key) if before is None else self.spark.conf.set(key, before)

    def rename(self, old: str, new: str) -> None:
        mode = self.mode(old)
        if self.is_cached(old):
            self.spark.catalog.uncacheTable(old)
        self.spark.sql(f"ALTER TABLE {old} RENAME TO {new}")
        if mode != NONE:
            self._cache(new, mode)

    def drop(self, name: str) -> None:
        if self.spark.catalog.tableExists(name) and self.is_cached(name):
            self.spark.catalog.uncacheTable(name)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def multi_insert(self, df: DataFrame, targets: dict[str, str | Insert]) -> None:
        """``FROM src INSERT ... INSERT ...`` into uncached tables. Each target
        has its own condition, columns and groups, and is written directly from
        its own pruned scan: no copy of the source is staged."""
        for name in targets:
            if self.mode(name) != NONE:
                raise CatalogError(f"{name} is cached; insert into it on its own")
        for name, target in targets.items():
            part = target if isinstance(target, Insert) else Insert(target)
            rows = part.rows(df)
            self.overwrite(name, rows) if part.overwrite else self.insert(name, rows)


@contextmanager
def temporary_database(spark: SparkSession) -> Iterator[str]:
    """A database in the shared scratch folder, dropped with its tables at the end."""
    name = new_name("millrace")
    spark.sql(f"CREATE DATABASE {name} LOCATION '{new_dir(spark, name)}'")
    try:
        yield name
    finally:
        for t in spark.catalog.listTables(name):
            if not t.isTemporary and spark.catalog.isCached(f"{name}.{t.name}"):
                spark.catalog.uncacheTable(f"{name}.{t.name}")
        spark.sql(f"DROP DATABASE {name} CASCADE")
