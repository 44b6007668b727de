"""User-defined scalar and aggregate functions in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "_fan"
FAN_IN = 256
MAX_KEYS_HELD = 50_000


def scalar_function(spark: SparkSession, name: str, fn: Callable, returns: str) -> Callable[..., Column]:
    """CREATE TEMPORARY FUNCTION: a function of pandas Series, usable from SQL
    under ``name`` and from Python through the returned callable."""
    wrapped = F.pandas_udf(fn, returns)
    spark.udf.register(name, wrapped)
    return wrapped


class Mergeable(Protocol):
    """An aggregate whose states of disjoint row sets can be merged.

    ``state`` and ``result`` are DDL schemas. ``start`` turns a batch of one
    group's rows into a state, ``merge`` combines two states, ``finish`` gives
    the result values. States are tuples.
    """

    state: str
    result: str

    def start(self, rows: pd.DataFrame) -> tuple: ...

    def merge(self, a: tuple, b: tuple) -> tuple: ...

    def finish(self, state: tuple) -> tuple: ...


def aggregate_with(df: DataFrame, keys: list[str], values: list[str], agg: Mergeable) -> DataFrame:
    """GROUP BY with a user aggregate, in the shape of partial + merge + final.

    Each task folds its rows into one state per key (sent on early when it holds
    many keys); only states are shuffled, first into ``FAN_IN`` groups per key,
    then into one. No call ever sees all rows of a group.
    """
    key_fields = [df.schema[k] for k in keys]
    state_schema = T.StructType.fromDDL(agg.state)
    partial_schema = T.StructType([*key_fields, *state_schema.fields, T.StructField(PART, T.IntegerType())])
    state_names = state_schema.names

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            part = rows[PART][0].as_py()
            rows = rows.append_column("_i", pa.array(range(rows.num_rows), pa.int64()))
            grouped = rows.group_by(keys).aggregate([("_i", "list")])
            data = rows.select(values)
            for row in grouped.to_pylist():
                key = tuple(row[k] for k in keys)
                state = agg.start(data.take(pa.array(row["_i_list"])).to_pandas())
                held[key] = agg.merge(held[key], state) if key in held else state
            if len(held) > MAX_KEYS_HELD:
                yield out(held, part)
                held = {}
        if held:
            yield out(held, part)

    arrow_schema = _arrow_schema(partial_schema)

    def out(held: dict[tuple, tuple], part: int) -> pa.RecordBatch:
        columns = list(zip(*[(*k, *s, part) for k, s in held.items()]))
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(columns, arrow_schema)], schema=arrow_schema
        )

    def combine(final: bool) -> Callable:
        def merge(table: pa.Table) -> pa.Table:
            states = list(zip(*[table[n].to_pylist() for n in state_names]))
            total = states[0]
            for s in states[1:]:
                total = agg.merge(total, s)
            head = [table[k][:1] for k in keys]
            if final:
                schema, tail = result_arrow, agg.finish(total)
            else:
                schema, tail = arrow_schema, (*total, 0)
            tail_arrays = [pa.array([v], f.type) for v, f in zip(tail, list(schema)[len(keys):])]
            arrays = [pc.cast(pa.chunked_array(h.chunks).combine_chunks(), schema.field(i).type) for i, h in enumerate(head)]
            return pa.Table.from_arrays([*arrays, *tail_arrays], schema=schema)

        return merge

    result_schema = T.StructType([*key_fields, *T.StructType.fromDDL(agg.result).fields])
    result_arrow = _arrow_schema(result_schema)
    spread = df.select(*keys, *values, (F.spark_partition_id() % FAN_IN).alias(PART))
    partial = spread.mapInArrow(fold, partial_schema)
    merged = partial.groupBy(*keys, PART).applyInArrow(combine(False), partial_schema)
    return merged.groupBy(*keys).applyInArrow(combine(True), result_schema)


# ---------------------------------------------------------------- aggregates over segments


class Segmented(Protocol):
    """A user aggregate that works on many groups in one call.

    ``state`` and ``result`` are DDL schemas. Rows come ordered by key; ``starts``
    holds where each group begins. ``fold`` turns rows into one state per group,
    ``merge`` states of the same groups into one each, ``finish`` states into
    results; all give arrays, one per column, with an entry per group.
    """

    state: str
    result: str

    def fold(self, rows: pa.Table, starts: np.ndarray) -> Sequence: ...

    def merge(self, states: pa.Table, starts: np.ndarray) -> Sequence: ...

    def finish(self, states: pa.Table) -> Sequence: ...


def segment_starts(keys: pa.Table) -> np.ndarray:
    """Where runs of equal keys begin. NULL equals NULL, NaN equals NaN."""
    new = np.zeros(max(0, keys.num_rows - 1), bool)
    for column in keys.columns:
        c = column.combine_chunks()
        a, b = c[:-1], c[1:]
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        if pa.types.is_floating(c.type):
            nan = pc.fill_null(pc.is_nan(c), False).to_numpy(zero_copy_only=False)
            differ = differ & ~(nan[:-1] & nan[1:])
        null = c.is_null().to_numpy(zero_copy_only=False)
        new |= differ | (null[:-1] != null[1:])
    return np.concatenate(([0], np.flatnonzero(new) + 1)) if keys.num_rows else np.empty(0, np.int64)


def aggregate_segments(df: DataFrame, keys: list[str], values: list[str], agg: Segmented) -> DataFrame:
    """GROUP BY with a user aggregate, however many keys there are: a Python call
    per batch of rows, not per key. Each task folds its rows into states before
    the shuffle; states of one key meet in order and are merged batch by batch,
    with the key that a batch ends in carried on, so no call sees all of a group."""
    key_fields = [df.schema[k] for k in keys]
    states = T.StructType([*key_fields, *T.StructType.fromDDL(agg.state).fields])
    results = T.StructType([*key_fields, *T.StructType.fromDDL(agg.result).fields])
    state_names = states.names[len(keys):]
    state_arrow, result_arrow = _arrow_schema(states), _arrow_schema(results)

    def grouped(table: pa.Table, call: Callable, schema: pa.Schema) -> pa.Table:
        starts = segment_starts(table.select(keys))
        heads = table.select(keys).take(pa.array(starts))
        arrays = [pa.array(a, f.type) for a, f in zip(call(table.drop_columns(keys), starts), list(schema)[len(keys):])]
        return pa.Table.from_arrays([*[c.cast(schema.field(i).type) for i, c in enumerate(heads.columns)], *arrays], schema=schema)

    def by_key(table: pa.Table) -> pa.Table:
        return table.sort_by([(k, "ascending") for k in keys])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(grouped(by_key(pa.Table.from_batches([batch])), agg.fold, state_arrow))
            if sum(t.num_rows for t in held) > MAX_KEYS_HELD:
                whole = grouped(by_key(pa.concat_tables(held)), agg.merge, state_arrow)
                held = [whole]
                if whole.num_rows > MAX_KEYS_HELD // 2:  # most keys differ: nothing to gain from holding them
                    yield from whole.to_batches()
                    held = []
        if held:
            yield from grouped(by_key(pa.concat_tables(held)), agg.merge, state_arrow).to_batches()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch], schema=state_arrow) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch], schema=state_arrow)])
            merged = grouped(table, agg.merge, state_arrow)
            done, rest = merged[:-1], merged[-1:]  # the last key may go on in the next batch
            yield from out(done)
        if rest is not None:
            yield from out(rest)

    def out(table: pa.Table) -> list[pa.RecordBatch]:
        if not table.num_rows:
            return []
        arrays = [pa.array(a, f.type) for a, f in zip(agg.finish(table.select(state_names)), list(result_arrow)[len(keys):])]
        return pa.Table.from_arrays([*[c.cast(result_arrow.field(i).type) for i, c in enumerate(table.select(keys).columns)], *arrays], schema=result_arrow).to_batches()

    partial = df.select(*keys, *values).mapInArrow(fold, states)
    return partial.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(finish, results)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
