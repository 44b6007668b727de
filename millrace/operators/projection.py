"""Projection and filter helpers beyond ``select`` and ``where``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def select_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Columns whose whole name matches a regular expression (Java flavour, as
    in a back-quoted Hive column pattern; case-insensitive)."""
    return df.select(df.colRegex(f"`(?i){pattern}`"))


def select_unmatched(df: DataFrame, pattern: str) -> DataFrame:
    """All columns but those whose name matches (the ``(ds)?+.+`` idiom)."""
    gone = re.compile(pattern, re.IGNORECASE)
    return df.select(*[c for c in df.columns if not gone.fullmatch(c)])


def _string_hash(col: Column) -> Column:
    """``h = 31 h + byte`` over the signed UTF-8 bytes, in 32 bits."""
    code = F.hex(F.encode(col, "UTF-8"))

    def step(h: Column, i: Column) -> Column:
        byte = F.conv(F.substring(code, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")
        signed = F.when(byte > 127, byte - 256).otherwise(byte)
        return F.pmod(h * 31 + signed, F.lit(1 << 32))

    places = F.filter(F.sequence(F.lit(0), F.octet_length(col)), lambda i: i < F.octet_length(col))
    return F.aggregate(places, F.lit(0).cast("bigint"), step)


def bucket_of(df: DataFrame, column: str, buckets: int) -> Column:
    """Bucket number of a value as Hive assigns it: the low 31 bits of its hash,
    modulo the bucket count. Whole numbers, booleans and strings hash as in
    Hive; other types are spread by ``xxhash64`` (same sample size, other
    members). NULL goes to bucket 0."""
    col, kind = F.col(column), df.schema[column].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.BooleanType)):
        h = col.cast("int").cast("bigint")
    elif isinstance(kind, T.LongType):
        h = col.bitwiseXOR(F.shiftrightunsigned(col, 32))
    elif isinstance(kind, T.StringType):
        h = _string_hash(col)
    else:
        h = F.xxhash64(col)
    return F.coalesce(h, F.lit(0)).bitwiseAND(F.lit((1 << 31) - 1)) % buckets


def sample_bucket(df: DataFrame, x: int, y: int, column: str) -> DataFrame:
    """``TABLESAMPLE (BUCKET x OUT OF y ON column)``: a filter, no shuffle."""
    if not 1 <= x <= y:
        raise ValueError(f"bucket {x} out of {y} does not exist")
    return df.where(bucket_of(df, column, y) == x - 1)
