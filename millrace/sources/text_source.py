"""Delimited and regular-expression text as data sources of Spark's own kind.

``register`` makes the formats ``delimited_text`` and ``regex_text`` known to
``spark.read.format`` and to SQL. Files are read in byte ranges. Spark hands the
reader its filters: their columns are parsed first, and only lines that pass are
parsed further; the option ``columns`` names the only columns that are parsed.
Batches leave the reader as Arrow.

Options: ``path`` (a file or folder), ``field``, ``item`` and ``key`` (separators of
fields, of items, of map keys; deeper levels follow on), ``null`` (text that stands
for NULL), ``pattern`` (regex_text: one group per column), ``columns`` (names with
commas; the others are NULL), ``split_bytes``.
"""

from __future__ import annotations

import datetime
import decimal
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull,
    IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith,
)
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.sources.text_formats import NULL_TEXT, SEPARATORS

SPLIT_BYTES = 64 << 20
BATCH_LINES = 50_000
SCALARS = (T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.DateType, T.DecimalType)
BOUNDS = {T.ByteType: 1 << 7, T.ShortType: 1 << 15, T.IntegerType: 1 << 31, T.LongType: 1 << 63}
COMPARE = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}
TEXT_TESTS = {StringStartsWith: pc.starts_with, StringEndsWith: pc.ends_with, StringContains: pc.match_substring}


@dataclass
class Range(InputPartition):
    """Bytes of a file; the lines that begin in them belong to the range."""

    path: str
    start: int
    stop: int


def _value(text: str | None, kind: T.DataType, separators: Sequence[str], null_text: str):
    """One value, NULL if the text is not of the type."""
    if text is None or text == null_text:
        return None
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.ArrayType):
        return [_value(x, kind.elementType, separators[1:], null_text) for x in text.split(separators[0])] if text else []
    if isinstance(kind, T.MapType):
        pairs = [x.partition(separators[1]) for x in text.split(separators[0])] if text else []
        whole = [(_value(k, kind.keyType, separators[2:], null_text), _value(v if s else None, kind.valueType, separators[2:], null_text)) for k, s, v in pairs]
        return [(k, v) for k, v in whole if k is not None]
    if isinstance(kind, T.StructType):
        parts = text.split(separators[0])
        return {f.name: _value(parts[i] if i < len(parts) else None, f.dataType, separators[1:], null_text) for i, f in enumerate(kind.fields)}
    try:
        if isinstance(kind, tuple(BOUNDS)):
            n = int(decimal.Decimal(text.strip()))
            return n if -BOUNDS[type(kind)] <= n < BOUNDS[type(kind)] else None
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return float(text)
        if isinstance(kind, T.BooleanType):
            return {"true": True, "false": False}.get(text.strip().lower())
        if isinstance(kind, T.DateType):
            return datetime.date.fromisoformat(text.strip())
        if isinstance(kind, T.DecimalType):
            n = decimal.Decimal(text.strip()).quantize(decimal.Decimal(1).scaleb(-kind.scale), decimal.ROUND_HALF_UP)
            return n if len(n.as_tuple().digits) <= kind.precision else None
    except (ValueError, ArithmeticError):
        return None
    raise ValueError(f"{kind.simpleString()} is not read from text")


def _column(texts: pa.Array, kind: T.DataType, arrow: pa.DataType, separators: Sequence[str], null_text: str) -> pa.Array:
    if isinstance(kind, T.StringType):
        return pc.if_else(pc.equal(texts, null_text), pa.scalar(None, texts.type), texts).cast(arrow)
    plain = isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType))
    if plain:  # whole columns at once where every text is of the type
        try:
            return pc.if_else(pc.equal(texts, null_text), pa.scalar(None, texts.type), texts).cast(arrow)
        except pa.ArrowInvalid:
            pass
    return pa.array([_value(x, kind, separators, null_text) for x in texts.to_pylist()], arrow)


def _test(batch_filter: Filter, column: pa.Array) -> pa.Array:
    if isinstance(batch_filter, IsNull):
        return pc.is_null(column)
    if isinstance(batch_filter, IsNotNull):
        return pc.is_valid(column)
    if isinstance(batch_filter, In):
        return pc.is_in(column, value_set=pa.array([v for v in batch_filter.value if v is not None], column.type))
    if type(batch_filter) in TEXT_TESTS:
        return TEXT_TESTS[type(batch_filter)](column, batch_filter.value)
    if isinstance(batch_filter, EqualNullSafe) and batch_filter.value is None:
        return pc.is_null(column)
    compare = COMPARE[EqualTo if isinstance(batch_filter, EqualNullSafe) else type(batch_filter)]
    return compare(column, pa.scalar(batch_filter.value, column.type))


class TextReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.schema, self.options = schema, dict(options)
        if "path" not in self.options:
            raise ValueError("the option path is missing")
        if not all(f.nullable for f in schema.fields):
            raise ValueError("any text may be NULL: leave NOT NULL out of the columns")
        self.filters: list[Filter] = []
        wanted = self.options.get("columns")
        names = None if wanted is None else {c.strip().lower() for c in wanted.split(",")}
        self.wanted = {f.name for f in schema.fields if names is None or f.name.lower() in names}
        self.null_text = self.options.get("null", NULL_TEXT)

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        known = (*COMPARE, *TEXT_TESTS, EqualNullSafe, In, IsNull, IsNotNull)
        kinds = {f.name: f.dataType for f in self.schema.fields}
        for f in filters:
            kind = kinds.get(f.attribute[0]) if type(f) in known and len(f.attribute) == 1 else None
            # Numbers with NaN or other rules of their own are left to Spark.
            if isinstance(kind, SCALARS) and not isinstance(kind, (T.FloatType, T.DoubleType)) and f.attribute[0] in self.wanted:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[Range]:
        fs, root = _filesystem(self.options["path"])
        size = int(self.options.get("split_bytes", SPLIT_BYTES))
        found = fs.get_file_info(root)
        files = [found] if found.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        out = []
        for f in sorted(files, key=lambda f: f.path):
            inner = f.path[len(root) :].strip("/").split("/")
            if f.type != pafs.FileType.File or any(p[:1] in ("_", ".") for p in inner if p):
                continue
            step = f.size if _compressed(f.path) else size
            out += [Range(f.path, a, min(a + step, f.size)) for a in range(0, f.size, max(1, step))]
        return out or [Range("", 0, 0)]

    def _lines(self, part: Range) -> Iterator[list[str]]:
        fs, _ = _filesystem(self.options["path"])
        if not part.path:
            return
        lines: list[str] = []
        if _compressed(part.path):
            with fs.open_input_stream(part.path, compression="detect") as raw, pa.PythonFile(raw, "r") as f:
                blocks, rest = iter(lambda: f.read(1 << 20), b""), b""
                for block in blocks:
                    *whole, rest = (rest + block).split(b"\n")
                    yield [x.decode(errors="replace") for x in whole]
                if rest:
                    yield [rest.decode(errors="replace")]
            return
        with fs.open_input_file(part.path) as f:
            at = part.start
            f.seek(max(0, at - 1))
            rest, first = b"", at > 0
            while True:
                block = f.read(1 << 20)
                if not block:
                    break
                *whole, rest = (rest + block).split(b"\n")
                if first and whole:  # the line that began before the range; at its very end that is nothing
                    at, first = at - 1 + len(whole[0]) + 1, False
                    whole = whole[1:]
                for x in whole:
                    if at >= part.stop:
                        break
                    lines.append(x.rstrip(b"\r").decode(errors="replace"))
                    at += len(x) + 1
                if len(lines) >= BATCH_LINES:
                    yield lines
                    lines = []
                if not first and at >= part.stop:
                    rest = b""
                    break
            if rest and not first and at < part.stop:
                lines.append(rest.rstrip(b"\r").decode(errors="replace"))
        if lines:
            yield lines

    def _texts(self, lines: pa.Array):
        """A function from a column's number to its texts."""
        pattern = self.options.get("pattern")
        if pattern is not None:
            hits = [m.groups() if (m := re.fullmatch(pattern, x)) else () for x in lines.to_pylist()]
            return lambda i: pa.array([h[i] if i < len(h) else None for h in hits], pa.string())
        parts = pc.split_pattern(lines, self.options.get("field", SEPARATORS[0]))
        starts, sizes = parts.offsets, pc.list_value_length(parts)

        def texts(i: int) -> pa.Array:
            at = pc.add(starts.slice(0, len(parts)), i)
            return parts.values.take(pc.if_else(pc.less(pa.scalar(i, pa.int32()), sizes), at, pa.scalar(None, pa.int32())))

        return texts

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)
        separators = (self.options.get("item", SEPARATORS[1]), self.options.get("key", SEPARATORS[2]), *SEPARATORS[3:])
        places = {f.name: i for i, f in enumerate(self.schema.fields)}
        for part in self._lines(partition):
            lines = pa.array(part, pa.string())

            def column(name: str, texts) -> pa.Array:
                i = places[name]
                if name not in self.wanted:
                    return pa.nulls(len(lines), arrow.field(i).type)
                return _column(texts(i), self.schema.fields[i].dataType, arrow.field(i).type, separators, self.null_text)

            for f in self.filters:  # lines that fail are parsed no further
                if len(lines):
                    lines = lines.filter(pc.fill_null(_test(f, column(f.attribute[0], self._texts(lines))), False))
            if len(lines):
                texts = self._texts(lines)
                yield pa.RecordBatch.from_arrays([column(f.name, texts) for f in self.schema.fields], schema=arrow)


def _compressed(path: str) -> bool:
    return path.endswith((".gz", ".bz2", ".zst"))


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path.rstrip("/")


class DelimitedText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "delimited_text"

    def schema(self) -> T.StructType:
        raise ValueError("text has no schema of its own: name the columns")

    def reader(self, schema: T.StructType) -> TextReader:
        return TextReader(schema, self.options)


class RegexText(DelimitedText):
    @classmethod
    def name(cls) -> str:
        return "regex_text"

    def reader(self, schema: T.StructType) -> TextReader:
        if "pattern" not in self.options:
            raise ValueError("the option pattern is missing")
        if any(not isinstance(f.dataType, T.StringType) for f in schema.fields):
            raise ValueError("columns of regex_text are strings")
        return TextReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make both formats known to a session, with filters handed to the readers."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (DelimitedText, RegexText):
        spark.dataSource.register(source)


def create_text_table(spark: SparkSession, name: str, columns: str, path: str, format: str = "delimited_text", **options: str) -> DataFrame:
    """A named table over text files, as DDL of older engines makes them with row
    formats. The files stay where they are and are read anew each time.

    Spark's ``CREATE TABLE … USING`` doesn't hand a table's options to formats
    written in Python, so this is a view: ``CREATE TEMPORARY VIEW … USING``.
    """
    register(spark)
    quoted = ", ".join(f"{k} '{_quoted(v)}'" for k, v in {"path": path, **options}.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} ({columns}) USING {format} OPTIONS ({quoted})")
    return spark.table(name)


def _quoted(text: str) -> str:
    return "".join(f"\\u{ord(c):04x}" if ord(c) < 32 else {"\\": "\\\\", "'": "\\'"}.get(c, c) for c in text)
