"""Table functions: Python functions from DataFrames and literals to a DataFrame.

A parameter annotated ``DataFrame`` takes a table name (or a DataFrame), one
annotated ``SparkSession`` gets the session, ``int``/``float``/``bool``/``str``
take literals. The result is given the declared column names and types.
"""

from __future__ import annotations

import inspect
import typing
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import TableFunctionError

LITERALS = {int: int, float: float, str: str}


@dataclass(frozen=True)
class TableFunction:
    name: str
    call: Callable
    schema: str | None  # None: the function returns (DataFrame, schema text)
    parameters: tuple[tuple[str, type], ...]

    @property
    def arguments(self) -> list[tuple[str, type]]:
        return [(n, t) for n, t in self.parameters if t is not SparkSession]


def table_function(schema: str | None = None, name: str | None = None) -> Callable[[Callable], TableFunction]:
    """Declare a table function; leave ``schema`` out if only a run can tell it."""

    def declare(fn: Callable) -> TableFunction:
        hints = typing.get_type_hints(fn)
        parameters = []
        for p in inspect.signature(fn).parameters:
            kind = hints.get(p)
            if kind not in (DataFrame, SparkSession, bool, *LITERALS):
                raise TableFunctionError(f"{fn.__name__}: parameter {p} needs a supported type, not {kind}")
            parameters.append((p, kind))
        return TableFunction(name or fn.__name__, fn, schema, tuple(parameters))

    return declare


def parse_schema(text: str) -> T.StructType:
    try:
        parsed = T.StructType.fromDDL(text)
    except Exception as e:
        raise TableFunctionError(f"bad table function schema {text!r}: {e}") from e
    if not parsed.fields:
        raise TableFunctionError("a table function needs at least one output column")
    return parsed


def _literal(kind: type, value: Any, where: str) -> Any:
    if kind is bool:
        if isinstance(value, bool):
            return value
        if str(value).lower() in ("true", "false"):
            return str(value).lower() == "true"
    else:
        try:
            return LITERALS[kind](value)
        except (TypeError, ValueError):
            pass
    raise TableFunctionError(f"{where}: {value!r} is not {kind.__name__}")


class TableFunctions:
    """The table functions known to one session."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.known: dict[str, TableFunction] = {}

    def register(self, fn: TableFunction) -> TableFunction:
        if not isinstance(fn, TableFunction):
            raise TableFunctionError("declare the function with @table_function first")
        if fn.schema is not None:
            parse_schema(fn.schema)
        self.known[fn.name.lower()] = fn
        return fn

    def call(self, name: str, *args: Any) -> DataFrame:
        fn = self.known.get(name.lower())
        if fn is None:
            raise TableFunctionError(f"unknown table function {name!r}")
        if len(args) != len(fn.arguments):
            raise TableFunctionError(f"{name} takes {len(fn.arguments)} arguments, got {len(args)}")
        given, bound = iter(args), []
        for p, kind in fn.parameters:
            if kind is SparkSession:
                bound.append(self.spark)
                continue
            value = next(given)
            if kind is DataFrame:
                bound.append(value if isinstance(value, DataFrame) else self.spark.table(str(value)))
            else:
                bound.append(_literal(kind, value, f"{name}({p})"))
        result, schema = fn.call(*bound), fn.schema
        if schema is None:
            if not (isinstance(result, tuple) and len(result) == 2):
                raise TableFunctionError(f"{name} declares no schema and returned none")
            result, schema = result
        if not isinstance(result, DataFrame):
            raise TableFunctionError(f"{name} must return a DataFrame")
        return conform(result, parse_schema(schema), name)


def conform(df: DataFrame, schema: T.StructType, name: str) -> DataFrame:
    """Give ``df`` the declared names and types, by position."""
    if len(df.columns) != len(schema.fields):
        raise TableFunctionError(
            f"{name} returned {len(df.columns)} columns, its schema has {len(schema.fields)}"
        )
    df = df.toDF(*[f.name for f in schema.fields])
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
