"""String predicates and functions: case-insensitive LIKE with classes, rounded positions, multi-character trims."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def like_regex(pattern: str, escape: str = "\\") -> str:
    """A LIKE pattern as a regular expression: % and _ are wild, [...] and [^...] are classes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            out.append(pattern[i : end + 1])
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def like(x: Column, pattern: str, escape: str = "\\") -> Column:
    """LIKE ignores case. Patterns without classes stay ILIKE, so that Catalyst knows them."""
    if "[" not in pattern and escape == "\\":
        return x.ilike(pattern)
    return x.rlike(f"(?is)^{like_regex(pattern, escape)}$")


def like_binary(x: Column, pattern: str) -> Column:
    """LIKE BINARY heeds case; a prefix pattern becomes a pushed StringStartsWith."""
    if re.fullmatch(r"[^%_\\]*%", pattern):
        return x.startswith(pattern[:-1])
    return x.like(pattern)


def rounded(n: Column | int | float) -> Column:
    return F.lit(int(n + 0.5) if n >= 0 else -int(-n + 0.5)) if isinstance(n, (int, float)) else F.round(n).cast("int")


def concat(a: Column, b: Column) -> Column:
    """|| and CONCAT: anything is cast to a string; NULL with anything is NULL."""
    return F.concat(a.cast("string"), b.cast("string"))


def left(s: Column, n) -> Column:
    return F.left(s, rounded(n))


def right(s: Column, n) -> Column:
    return F.right(s, rounded(n))


def mid(s: Column, p, n=None) -> Column:
    """MID and SUBSTRING: one-based, negative from the end; rounded arguments; a negative length gives ''."""
    if n is None:
        return F.substr(s, rounded(p))
    return F.when(rounded(n) < 0, F.lit("")).otherwise(F.substr(s, rounded(p), F.greatest(rounded(n), F.lit(0))))


def locate(part: str, s: Column) -> Column:
    return F.when(s.isNull(), None).otherwise(F.locate(part, s)) if part else F.lit(1)


def instr(s: Column, part: str) -> Column:
    return F.instr(s, part)


def trim(s: Column, what: str = " ", side: str = "both") -> Column:
    """TRIM([BOTH|LEADING|TRAILING] what FROM s): ``what`` is removed as a whole, again and again."""
    p = re.escape(what)
    if side in ("both", "leading"):
        s = F.regexp_replace(s, f"^(?:{p})+", "")
    if side in ("both", "trailing"):
        s = F.regexp_replace(s, f"(?:{p})+$", "")
    return s


def repeat(s: Column, n) -> Column:
    return F.repeat(s, rounded(n))


def replace(s: Column, a: str, b: str) -> Column:
    return F.replace(s, F.lit(a), F.lit(b))
