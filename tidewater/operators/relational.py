"""Scans by key, literal relations, null-matching joins, explicit null order, merged index lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sizes import broadcast_if_small

#: IN lists up to this length are pushed to the scan; longer ones become a semi join.
IN_LIST = 1000


def get_by_keys(df: DataFrame, column: str, keys: list) -> DataFrame:
    """Rows with one of the keys."""
    if len(keys) <= IN_LIST:
        return df.where(F.col(column).isin(keys))
    side = df.sparkSession.createDataFrame([(k,) for k in set(keys)], f"{column} {df.schema[column].dataType.simpleString()}")
    return df.join(broadcast_if_small(side), column, "left_semi")


def key_range(df: DataFrame, column: str, low=None, high=None, with_low: bool = True, with_high: bool = True) -> DataFrame:
    """Rows in a range of a key, its ends included or not."""
    if low is not None:
        df = df.where(F.col(column) >= low if with_low else F.col(column) > low)
    if high is not None:
        df = df.where(F.col(column) <= high if with_high else F.col(column) < high)
    return df


def index_merge(df: DataFrame, key: list[str], conditions: list[Column]) -> DataFrame:
    """Rows that any lookup finds, each once: one scan with the conditions joined by OR (NULL counts as not found)."""
    return df.where(reduce(lambda a, b: a | b, conditions)).dropDuplicates(key)


def merge_delta(base: DataFrame, delta: DataFrame, key: list[str], deleted: str = "_deleted") -> DataFrame:
    """A base and uncommitted changes: the changes win, deleted keys vanish."""
    return base.join(delta.select(*key), key, "left_anti").unionByName(delta.where(~F.col(deleted)).drop(deleted))


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def null_matching_join(a: DataFrame, b: DataFrame, left: str, right: str, how: str = "inner") -> DataFrame:
    """An equi-join in which NULL keys match each other."""
    return a.join(b, a[left].eqNullSafe(b[right]), how)


def ordered(df: DataFrame, *keys: tuple[str, bool]) -> DataFrame:
    """ORDER BY with NULL as the highest value: last when ascending, first when descending. keys: (column, descending)."""
    return df.orderBy(*[F.col(c).desc_nulls_first() if down else F.col(c).asc_nulls_last() for c, down in keys])


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return df.offset(offset).limit(limit) if offset else df.limit(limit)


def all_rows(df: DataFrame, left: Column, op: str, other: DataFrame, column: str) -> DataFrame:
    """Rows for which ``left op ALL (other.column)``: against the other's extreme; all rows if it is empty, none if it has a NULL."""
    edge = F.max if op in (">", ">=") else F.min
    facts = other.agg(edge(column).alias("_edge"), F.count(F.lit(1)).alias("_n"), F.count(column).alias("_known"))
    test = {">": left > F.col("_edge"), ">=": left >= F.col("_edge"), "<": left < F.col("_edge"), "<=": left <= F.col("_edge")}[op]
    return df.join(F.broadcast(facts)).where((F.col("_n") == 0) | ((F.col("_n") == F.col("_known")) & test)).drop("_edge", "_n", "_known")


def any_row(df: DataFrame, left: Column, op: str, other: DataFrame, column: str) -> DataFrame:
    """Rows for which ``left op ANY (other.column)``."""
    edge = F.min if op in (">", ">=") else F.max
    facts = other.agg(edge(column).alias("_edge"))
    test = {">": left > F.col("_edge"), ">=": left >= F.col("_edge"), "<": left < F.col("_edge"), "<=": left <= F.col("_edge")}[op]
    return df.join(F.broadcast(facts)).where(test).drop("_edge")


def unique(df: DataFrame, key: list[str]) -> DataFrame:
    """One row: whether no key occurs twice (NULL keys never count as equal)."""
    full = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    twice = df.where(full).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.agg((F.count(F.lit(1)) == 0).alias("is_unique"))


def hash_partitioned(df: DataFrame, n: int, *keys: str) -> DataFrame:
    return df.repartition(n, *keys)


def range_partitioned(df: DataFrame, n: int, *keys: str) -> DataFrame:
    return df.repartitionByRange(n, *keys)


def gather(frames: list[DataFrame], tasks: int | None = None) -> DataFrame:
    """All rows of several inputs of the same columns, in fewer tasks if a number is given (no shuffle)."""
    out = reduce(DataFrame.unionByName, frames)
    return out.coalesce(tasks) if tasks else out


def copy_to(df: DataFrame, paths: list[str]) -> list[DataFrame]:
    """The same rows in each of the new folders. They are computed once; the other copies are read from the first, so that
    all agree even if the rows don't come out alike twice."""
    df.write.parquet(paths[0])
    first = df.sparkSession.read.parquet(paths[0])
    for path in paths[1:]:
        first.write.parquet(path)
    return [df.sparkSession.read.parquet(path) for path in paths]
