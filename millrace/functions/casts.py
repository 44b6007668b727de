"""Casts that answer NULL for text they cannot read."""

from __future__ import annotations

from pyspark.sql import Column


def soft_cast(value: Column, to: str) -> Column:
    return value.try_cast(to)
