"""Numeric functions whose Hive meaning differs from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a: Column, b: Column) -> Column:
    """``/``: NULL for a zero divisor, never an error."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def int_divide(a: Column, b: Column) -> Column:
    """``div``: whole part of the quotient, NULL for a zero divisor."""
    return F.when(b != 0, F.call_function("div", a.cast("bigint"), b.cast("bigint")))


def remainder(a: Column, b: Column) -> Column:
    """``%``: sign of the dividend, NULL for a zero divisor."""
    return F.try_mod(a, b)


def positive_mod(a: Column, b: Column) -> Column:
    return F.when(b != 0, F.pmod(a, b))


def log_or_null(x: Column) -> Column:
    """Natural logarithm, NULL at and below zero."""
    return F.when(x > 0, F.ln(x))


def variance(x: Column) -> Column:
    """``variance`` means the population variance."""
    return F.var_pop(x)


def std(x: Column) -> Column:
    """``std`` and ``stddev`` mean the population deviation."""
    return F.stddev_pop(x)
