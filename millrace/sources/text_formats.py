"""Row formats of plain text: nested delimiters and regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the default text format: separators by nesting level, NULL marker.
SEPARATORS = ("\x01", "\x02", "\x03", "\x04", "\x05", "\x06", "\x07", "\x08")
NULL_TEXT = "\\N"


def _parse(text: Column, kind: T.DataType, separators: tuple[str, ...], null_text: str) -> Column:
    text = F.nullif(text, F.lit(null_text))
    cut = lambda col, sep: F.split(col, re.escape(sep))
    if isinstance(kind, T.ArrayType):
        items = F.transform(
            cut(text, separators[0]), lambda x: _parse(x, kind.elementType, separators[1:], null_text)
        )
        return F.when(text == "", F.array().cast(kind)).otherwise(items)
    if isinstance(kind, T.MapType):
        inner = separators[2:]

        def pair(entry: Column) -> Column:
            kv = F.split(entry, re.escape(separators[1]), 2)
            return F.struct(
                _parse(F.get(kv, F.lit(0)), kind.keyType, inner, null_text).alias("key"),
                _parse(F.get(kv, F.lit(1)), kind.valueType, inner, null_text).alias("value"),
            )

        entries = F.filter(F.transform(cut(text, separators[0]), pair), lambda e: e["key"].isNotNull())
        return F.when(text == "", F.create_map().cast(kind)).otherwise(F.map_from_entries(entries))
    if isinstance(kind, T.StructType):
        parts = cut(text, separators[0])
        fields = [
            _parse(F.get(parts, F.lit(i)), f.dataType, separators[1:], null_text).alias(f.name)
            for i, f in enumerate(kind.fields)
        ]
        return F.when(text.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.StringType):
        return text
    return text.try_cast(kind)


def parse_delimited(
    lines: DataFrame,
    schema: str | T.StructType,
    separators: tuple[str, ...] = SEPARATORS,
    null_text: str = NULL_TEXT,
    column: str = "value",
) -> DataFrame:
    """Parse text lines: level-0 separator between fields, the next ones inside
    arrays, maps and structs. Extra fields are ignored, missing ones are NULL."""
    target = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parts = lines.select(F.split(F.col(column), re.escape(separators[0])).alias("_f"))
    return parts.select(
        *[
            _parse(F.get("_f", F.lit(i)), f.dataType, separators[1:], null_text).alias(f.name)
            for i, f in enumerate(target.fields)
        ]
    )


def _render(col: Column, kind: T.DataType, separators: tuple[str, ...], null_text: str) -> Column:
    if isinstance(kind, T.ArrayType):
        text = F.array_join(
            F.transform(col, lambda x: _render(x, kind.elementType, separators[1:], null_text)), separators[0]
        )
    elif isinstance(kind, T.MapType):
        text = F.array_join(
            F.transform(
                F.map_entries(col),
                lambda e: F.concat(
                    _render(e["key"], kind.keyType, separators[2:], null_text),
                    F.lit(separators[1]),
                    _render(e["value"], kind.valueType, separators[2:], null_text),
                ),
            ),
            separators[0],
        )
    elif isinstance(kind, T.StructType):
        fields = [_render(col[f.name], f.dataType, separators[1:], null_text) for f in kind.fields]
        text = F.when(col.isNotNull(), F.concat_ws(separators[0], *fields))
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit(null_text))


def render_delimited(
    df: DataFrame, separators: tuple[str, ...] = SEPARATORS, null_text: str = NULL_TEXT
) -> DataFrame:
    """The inverse of ``parse_delimited``: one text column ``value``."""
    cells = [_render(F.col(f"`{f.name}`"), f.dataType, separators[1:], null_text) for f in df.schema.fields]
    return df.select(F.concat_ws(separators[0], *cells).alias("value"))


def parse_regex(lines: DataFrame, pattern: str, names: list[str], column: str = "value") -> DataFrame:
    """One string column per capture group; NULL where a line does not match."""
    col = F.col(column)
    hit = col.rlike(f"^(?:{pattern})$")
    return lines.select(
        *[F.when(hit, F.regexp_extract(col, f"^(?:{pattern})$", i + 1)).alias(n) for i, n in enumerate(names)]
    )
