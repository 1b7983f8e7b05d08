"""Arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def item(a: Column, i: int) -> Column:
    """arr[i]: one-based; NULL past the end."""
    return F.try_element_at(a, F.lit(i))


def slice_first(a: Column, field: str) -> Column:
    """SLICE of a multiset of rows: each row's first field, by name."""
    return F.transform(a, lambda x: x[field])


def entry(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def json_extract(j: Column, path: str) -> Column:
    return F.get_json_object(j, path)
