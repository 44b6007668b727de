"""Array and map functions with Hive's answers for NULL and missing entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def size(x: Column) -> Column:
    """Number of entries, -1 for NULL."""
    return F.coalesce(F.size(x), F.lit(-1))


def item(array: Column, index: Column | int) -> Column:
    """``a[i]``: NULL when out of range."""
    return F.get(array, F.lit(index) if isinstance(index, int) else index)


def entry(mapping: Column, key: Column) -> Column:
    """``m[k]``: NULL when the key is missing."""
    return F.try_element_at(mapping, key)
