"""Rows dealt into bundles of about a megabyte of text, which passes over the corpus can come back to.

A bundle is the rows whose id and text have one hash; within it rows stand in the order of id and text hash. Every pass sees the
same bundle in the same order, so a row and a place in it are named by two integers, and what a pass over other data has
found about them returns by the bundle's number, without the texts moving again: a plan that reads the bundles several
times shuffles the texts once, since Spark reuses the exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import partitions


class Bundles:
    """``rows``: the documents' columns and tag, bundle; ``n`` bundles."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int = 1 << 20):
        spark = docs.sparkSession
        self.id, self.text, self.columns = id_col, text_col, docs.columns
        self.bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        self.parts = partitions(spark, self.bytes, 64 << 20)
        self.n = int(max(self.parts, -(-self.bytes // size)))
        tag = F.xxhash64(text_col)
        self.rows = docs.withColumns({"_tag": tag, "_bundle": self.number(F.col(id_col), tag)}).repartition(self.parts, "_bundle")

    def number(self, id_: Column, tag: Column) -> Column:
        """The bundle of a row with an id and the hash of a text."""
        return F.pmod(F.xxhash64(id_, tag), F.lit(self.n)).cast("int")

    def apply(self, work, schema: str) -> DataFrame:
        """work(bundle number, table in order) for each bundle."""
        id_col = self.id
        return self.rows.groupBy("_bundle").applyInArrow(lambda key, t: work(key[0].as_py(), ordered(t, id_col)), schema)

    def apply_with(self, other: DataFrame, work, schema: str) -> DataFrame:
        """work(bundle number, table in order, rows of ``other`` with that ``_bundle``) for each bundle that has rows."""
        id_col = self.id
        empty = pa.schema(_arrow(schema))

        def run(key, t, found):
            if not t.num_rows:
                return empty.empty_table()
            return work(key[0].as_py(), ordered(t, id_col), found)

        return self.rows.groupBy("_bundle").cogroup(other.groupBy("_bundle")).applyInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def ordered(t: pa.Table, id_col: str) -> pa.Table:
    """By id, nulls last, and tag."""
    keys = pa.table({"i": t.column(id_col), "t": t.column("_tag")})
    return t.take(pc.sort_indices(keys, sort_keys=[("i", "ascending"), ("t", "ascending")], null_placement="at_end"))


def pieces_of(t: pa.Table, column: str, limit: int) -> list[tuple[int, pa.Array]]:
    """(first row, texts) in pieces of about ``limit`` bytes."""
    texts = t.column(column).combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, begin = [], 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + limit, side="right")))
        out.append((begin, texts.slice(begin, end - begin)))
        begin = end
    return out
