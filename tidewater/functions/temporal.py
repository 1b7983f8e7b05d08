"""Dates and times: lenient parsing, and formats with percent specifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Percent specifiers and Spark's pattern letters.
SPECIFIERS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "i": "mm", "s": "ss", "S": "ss", "f": "SSS", "T": "HH:mm:ss"}
DATES = ["yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyyMMdd"]
TIMES = ["H:m:s", "HHmmss", "H:m:s.SSS"]


def pattern(fmt: str) -> str:
    """A percent format as a Spark pattern; an unknown specifier stands for its letter."""
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            i += 1
            out.append(SPECIFIERS.get(fmt[i], f"'{fmt[i]}'"))
        elif fmt[i].isalpha():
            out.append(f"'{fmt[i]}'")
        else:
            out.append(fmt[i])
        i += 1
    return "".join(out).replace("''", "")


def parse_date(s: Column) -> Column:
    """A date from 2022-7-2, 2022/7/2, 2022.7.2 or 20220702; NULL from anything else."""
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(p)) for p in DATES]).cast("date")


def parse_timestamp(s: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f"{d} {t}")) for d in DATES for t in TIMES], *[F.try_to_timestamp(s, F.lit(p)) for p in DATES])


def parse_time(s: Column) -> Column:
    """A time of day as a timestamp of the first day."""
    return F.coalesce(*[F.try_to_timestamp(F.concat(F.lit("1970-01-01 "), s), F.lit(f"yyyy-MM-dd {t}")) for t in TIMES])


def date_format(d: Column, fmt: str = "%Y-%m-%d") -> Column:
    return F.date_format(d, pattern(fmt)) if fmt else F.lit(None).cast("string")


def time_format(t: Column, fmt: str = "%H:%i:%s") -> Column:
    return F.date_format(parse_time(t), pattern(fmt))


def timestamp_format(x: Column, fmt: str = "%Y-%m-%d %H:%i:%s", seconds: bool = False) -> Column:
    """Of a timestamp, or of seconds since the epoch."""
    return F.date_format(F.timestamp_seconds(x) if seconds else x, pattern(fmt))


def from_unixtime(n: Column) -> Column:
    return F.timestamp_seconds(n)


def unix_timestamp(x: Column, numeric: bool = False) -> Column:
    """Seconds since the epoch; a number passes through."""
    return x.cast("long") if numeric else F.unix_timestamp(x)


def datediff(a: Column, b: Column) -> Column:
    return F.datediff(a, b).cast("long")


def current_time() -> Column:
    return F.date_format(F.current_timestamp(), "HH:mm:ss")
