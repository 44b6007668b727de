"""The session object: SQL in several result forms, cached tables, table functions."""

from __future__ import annotations

import re
from collections import namedtuple
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.catalog.tables import TableCatalog
from millrace.errors import QueryError, TableFunctionError
from millrace.operators.table_functions import TableFunction, TableFunctions
from millrace.sources.sinks import load_data

# Statements Spark SQL does not know.
GENERATE = re.compile(r"\s*generate\s+([\w.]+)\s*\((.*)\)\s*(?:as\s+(\w+))?\s*;?\s*", re.IGNORECASE | re.DOTALL)
# One argument: a quoted text, with any commas and brackets, or a bare word.
ARGUMENT = re.compile(r"""\s*(?:'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)"|([^,'"]*?))\s*(?:,|$)""", re.DOTALL)
CACHE = re.compile(r"\s*(cache|uncache)\s+(?!table\b)([\w.]+)\s*;?\s*", re.IGNORECASE)
LOAD = re.compile(
    r"\s*load\s+data\s+(?:local\s+)?inpath\s+['\"](.+?)['\"]\s+(overwrite\s+)?into\s+table\s+([\w.]+)"
    r"\s*(?:partition\s*\((.*?)\))?\s*;?\s*",
    re.IGNORECASE,
)
# Statements after which the cache may differ from a table's property.
DDL = re.compile(
    r"\s*(?:create\s+table(?:\s+if\s+not\s+exists)?|alter\s+table)\s+([\w.`]+)(?:\s+rename\s+to\s+([\w.`]+))?",
    re.IGNORECASE,
)


def generate_arguments(text: str) -> list[str]:
    """The arguments of a GENERATE statement; quotes keep commas and brackets."""
    args, at = [], 0
    while text.strip() and at <= len(text):
        m = ARGUMENT.match(text, at)
        if not m:
            raise QueryError(f"cannot read the arguments {text!r}")
        quoted = m.group(1) if m.group(1) is not None else m.group(2)
        args.append(m.group(3).strip() if quoted is None else re.sub(r"\\(.)", r"\1", quoted, flags=re.DOTALL))
        if m.end() == len(text) and not text[at:].rstrip().endswith(","):
            break
        at = m.end()
        if at == len(text):
            break
    return args


@dataclass(frozen=True)
class Options:
    max_rows: int = 1000  # rows handed to the driver by sql() and run_sql()
    cached_suffix: bool = False  # cache tables whose name ends in _cached
    null_text: str = "NULL"
    load_format: str = "delimited"  # files named by LOAD DATA statements
    compress_cache: bool | None = None  # None: as the session has it
    prune_cache: bool | None = None  # skip cached batches by their minimum and maximum
    regex_columns: bool | None = None  # back-quoted column names are patterns

    def session_settings(self) -> dict[str, bool | None]:
        return {
            "spark.sql.inMemoryColumnarStorage.compressed": self.compress_cache,
            "spark.sql.inMemoryColumnarStorage.partitionPruning": self.prune_cache,
            "spark.sql.parser.quotedRegexColumnNames": self.regex_columns,
        }


@dataclass(frozen=True)
class ResultSet:
    schema: T.StructType
    rows: list[Row]


class Warehouse:
    def __init__(self, spark: SparkSession, options: Options | None = None) -> None:
        self.spark = spark
        self.options = options or Options()
        self.catalog = TableCatalog(spark, self.options.cached_suffix)
        self.functions = TableFunctions(spark)
        for key, value in self.options.session_settings().items():
            if value is not None:
                spark.conf.set(key, str(value).lower())

    # -- statements

    def sql_df(self, command: str, **params: Any) -> DataFrame:
        """Run a statement, keep the answer as a DataFrame."""
        try:
            m = GENERATE.fullmatch(command)
            if m:
                args = generate_arguments(m.group(2))
                return self.generate(m.group(1), *args, as_table=m.group(3))
            m = CACHE.fullmatch(command)
            if m:
                (self.catalog.cache if m.group(1).lower() == "cache" else self.catalog.uncache)(m.group(2))
                return self.spark.createDataFrame([], "result string")
            m = LOAD.fullmatch(command)
            if m:
                pairs = [p.split("=", 1) for p in (m.group(4) or "").split(",") if p.strip()]
                partition = {k.strip(): v.strip().strip("'\"") for k, v in pairs} or None
                load_data(self.spark, m.group(1), m.group(3), bool(m.group(2)), partition, self.options.load_format)
                return self.spark.createDataFrame([], "result string")
            df = self.spark.sql(command, args=params or None)
            m = DDL.match(command)
            if m:
                name = m.group(2) or m.group(1)
                if self.spark.catalog.tableExists(name.replace("`", "")):
                    self.catalog.sync(name)
            return df
        except PySparkException as e:
            raise QueryError(str(e)) from e

    def sql(self, command: str, max_rows: int | None = None, **params: Any) -> list[str]:
        """Answer rows as text lines with tabs; nested values as JSON."""
        lines = self.as_text(self.capped(self.sql_df(command, **params), max_rows))
        return [r["line"] for r in self._collect(lines)]

    def run_sql(self, command: str, max_rows: int | None = None, **params: Any) -> ResultSet:
        """Schema and at most ``max_rows`` answer rows."""
        df = self.sql_df(command, **params)
        return ResultSet(df.schema, self._collect(self.capped(df, max_rows)))

    def tuples(self, command: str, names: list[str] | None = None, **params: Any) -> Iterator[tuple]:
        """Answer rows as named tuples, fetched one partition at a time."""
        df = self.sql_df(command, **params)
        cls = namedtuple("Answer", names or df.columns, rename=True)
        try:
            for row in df.toLocalIterator():
                yield cls(*row)
        except PySparkException as e:
            raise QueryError(str(e)) from e

    def capped(self, df: DataFrame, max_rows: int | None = None) -> DataFrame:
        return df.limit(self.options.max_rows if max_rows is None else max_rows)

    def as_text(self, df: DataFrame) -> DataFrame:
        def cell(f: T.StructField):
            col = F.col(f"`{f.name}`")
            nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
            text = F.to_json(col, {"ignoreNullFields": "false"}) if nested else col.cast("string")
            return F.coalesce(text, F.lit(self.options.null_text))

        return df.select(F.concat_ws("\t", *[cell(f) for f in df.schema.fields]).alias("line"))

    @staticmethod
    def _collect(df: DataFrame) -> list[Row]:
        try:
            return df.collect()
        except PySparkException as e:
            raise QueryError(str(e)) from e

    # -- table functions

    def register(self, fn: TableFunction) -> TableFunction:
        return self.functions.register(fn)

    def generate(self, name: str, *args: Any, as_table: str | None = None) -> DataFrame:
        """Call a table function; with ``as_table`` save its rows as a cached table."""
        df = self.functions.call(name.split(".")[-1], *args)
        if as_table is None:
            return df
        if not self.catalog.save_dataset(df, as_table, df.columns):
            raise TableFunctionError(f"could not save the rows of {name} as {as_table}")
        return self.spark.table(as_table)


class TypedRow:
    """A row with getters by name or position that check the Python type."""

    def __init__(self, row: Row) -> None:
        self.row = row

    def get(self, field: str | int) -> Any:
        return self.row[field]

    def _typed(self, field: str | int, *kinds: type) -> Any:
        value = self.row[field]
        if value is not None and (not isinstance(value, kinds) or (bool not in kinds and isinstance(value, bool))):
            raise TypeError(f"{field} holds {type(value).__name__}, not {kinds[0].__name__}")
        return value

    def get_int(self, field: str | int) -> int | None:
        return self._typed(field, int)

    def get_double(self, field: str | int) -> float | None:
        return self._typed(field, float)

    def get_string(self, field: str | int) -> str | None:
        return self._typed(field, str)

    def get_boolean(self, field: str | int) -> bool | None:
        return self._typed(field, bool)

    def is_null(self, field: str | int) -> bool:
        return self.row[field] is None
