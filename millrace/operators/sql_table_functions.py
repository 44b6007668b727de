"""Table functions that SQL calls: over whole tables, over rows of a lateral join,
with a schema that depends on the arguments.

A function over a table sees batches of at most ``BATCH_ROWS`` rows, whatever the
table's or a partition's size, and gives batches back. Its result's schema is told
from the table's schema and the other arguments when the query is analysed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

BATCH_ROWS = 5000


class BatchFunction(Protocol):
    """``schema`` tells the result's columns from the table's and the literal
    arguments, and raises ``ValueError`` on bad ones; ``start`` makes what a
    partition carries from batch to batch, ``batch`` turns a batch of rows into
    any number of batches, ``finish`` gives what is left at the partition's end."""

    def schema(self, table: T.StructType, *args: Any) -> T.StructType: ...

    def start(self, *args: Any) -> Any: ...

    def batch(self, state: Any, rows: pa.Table, *args: Any) -> Iterator[pa.Table]: ...

    def finish(self, state: Any, *args: Any) -> Iterator[pa.Table]: ...


def register_over_table(spark: SparkSession, name: str, function: BatchFunction) -> None:
    """``SELECT … FROM name(TABLE(t) [PARTITION BY … ORDER BY …], literal, …)``."""

    class OverTable:
        def __init__(self) -> None:
            self.rows: list = []
            self.started, self.state, self.args = False, None, ()

        @staticmethod
        def analyze(table: AnalyzeArgument, *args: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable:
                raise ValueError(f"the first argument of {name} is a table: TABLE(t)")
            if any(not a.isConstantExpression for a in args):
                raise ValueError(f"{name} takes literals after the table")
            return AnalyzeResult(function.schema(table.dataType, *[a.value for a in args]))

        def eval(self, row, *args):
            if not self.started:
                self.started, self.state, self.args = True, function.start(*args), args
            self.rows.append(row.asDict())
            if len(self.rows) >= BATCH_ROWS:
                yield from self.run()

        def run(self):
            rows, self.rows = self.rows, []
            for out in function.batch(self.state, pa.Table.from_pylist(rows), *self.args):
                yield from _tuples(out)

        def terminate(self):
            if self.rows:
                yield from self.run()
            if self.started:
                for out in function.finish(self.state, *self.args):
                    yield from _tuples(out)

    spark.udtf.register(name, udtf(OverTable))


def _tuples(table: pa.Table) -> Iterator[tuple]:
    return zip(*[c.to_pylist() for c in table.columns])


def register_lateral(spark: SparkSession, name: str, function: Callable[..., Iterator[tuple]], returns: str) -> None:
    """``SELECT … FROM t, LATERAL name(t.a, …)``: ``function`` gets the arguments of
    one row and gives that row's result rows. Spark takes no Arrow functions there."""

    class Lateral:
        def eval(self, *args):
            yield from function(*args)

    spark.udtf.register(name, udtf(Lateral, returnType=returns))


class Unpivot:
    """Columns to rows: the named key columns, and for every other column its name
    and its value as text. NULL values give rows, too."""

    def schema(self, table: T.StructType, keys: str) -> T.StructType:
        wanted = _names(keys)
        missing = [k for k in wanted if k not in table.names]
        if missing or len(wanted) == len(table.names):
            raise ValueError(f"unpivot: no column {missing[0]!r}" if missing else "unpivot: no column is left")
        return T.StructType([*[table[k] for k in wanted], T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])

    def start(self, keys: str) -> None:
        return None

    def batch(self, state: None, rows: pa.Table, keys: str) -> Iterator[pa.Table]:
        wanted = _names(keys)
        for c in rows.column_names:
            if c not in wanted:
                texts = pa.array([None if v is None else str(v) for v in rows.column(c).to_pylist()], pa.string())
                yield pa.table([*[rows.column(k) for k in wanted], pa.array([c] * rows.num_rows, pa.string()), texts], names=[*wanted, "name", "value"])

    def finish(self, state: None, keys: str) -> Iterator[pa.Table]:
        return iter(())


class Sessions:
    """Rows of a partition, in its order, with the number of their session: a new
    one begins where ``column`` rises by more than ``gap``. Carries one value."""

    def schema(self, table: T.StructType, column: str, gap: float) -> T.StructType:
        if column not in table.names:
            raise ValueError(f"sessions: no column {column!r}")
        return T.StructType([*table.fields, T.StructField("session", T.LongType())])

    def start(self, column: str, gap: float) -> dict:
        return {"last": None, "session": 0}

    def batch(self, state: dict, rows: pa.Table, column: str, gap: float) -> Iterator[pa.Table]:
        out = []
        for v in rows.column(column).to_pylist():
            if v is not None:
                if state["last"] is not None and v - state["last"] > gap:
                    state["session"] += 1
                state["last"] = v
            out.append(state["session"])
        yield rows.append_column("session", pa.array(out, pa.int64()))

    def finish(self, state: dict, column: str, gap: float) -> Iterator[pa.Table]:
        return iter(())


def _names(text: str) -> list[str]:
    return [k.strip() for k in text.split(",")]
