"""Text functions Spark has no direct counterpart for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed part names of a URL, as parse_url takes them; QUERY:key asks for one parameter.
URL_PARTS = ("PROTOCOL", "HOST", "PATH", "QUERY", "REF", "FILE", "AUTHORITY", "USERINFO")


def field(value: Column, *options: Column) -> Column:
    """Position of ``value`` among the options, 0 if absent or NULL."""
    return F.coalesce(F.array_position(F.array(*options), value), F.lit(0)).cast("bigint")


def url_part(url: Column, part: str) -> Column:
    """One part of a URL; NULL for text that is no URL."""
    name, _, key = part.partition(":")
    if name not in URL_PARTS:
        raise ValueError(f"unknown URL part {part!r}")
    args = [url, F.lit(name)] + ([F.lit(key)] if key else [])
    return F.try_parse_url(*args)


def url_tuple(url: Column, *parts: str) -> list[Column]:
    """parse_url_tuple: several parts at once, named ``c0``, ``c1``, ..."""
    return [url_part(url, p).alias(f"c{i}") for i, p in enumerate(parts)]
