"""Arithmetic whose results differ from Spark's own: integer averages, rounding casts, plain number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_avg(x: Column) -> Column:
    """AVG of an integer column stays an integer and drops the fraction."""
    total, n = F.sum(x), F.count(x)
    return F.when(n > 0, (total - F.try_mod(total, n)) / n).cast("long")


def sum_as(x: Column, kind: str) -> Column:
    """SUM in the argument's own type."""
    return F.sum(x).cast(kind)


def sum0(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0))


def to_int(x: Column) -> Column:
    """CAST to INT rounds half away from zero."""
    return F.round(x.cast("decimal(38,10)"), 0).cast("int")


def int_div(a: Column, b: Column) -> Column:
    """/ of integers is an integer, NULL when dividing by zero."""
    return F.when(b != 0, (a - F.try_mod(a, b)) / b).cast("long")


def mod(a: Column, b: Column) -> Column:
    """Sign of the dividend; NULL for a zero divisor."""
    return F.try_mod(a, b)


def keep_ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


def keep_floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def format_plain(x: Column, digits: int | float) -> Column:
    """FORMAT: fixed decimals, half up, no thousands separator; a fractional number of digits is rounded."""
    n = max(0, int(digits + 0.5))
    return F.round(x.cast("decimal(38,10)"), n).cast(f"decimal(38,{n})").cast("string")


def exact_power(x: Column, n: int) -> Column:
    """POW with an integer base and a small exponent as an exact decimal."""
    out = F.lit(1).cast("decimal(38,0)")
    for _ in range(n):
        out = (out * x.cast("decimal(18,0)")).cast("decimal(38,0)")
    return out


def tau() -> Column:
    return F.pi() * 2
