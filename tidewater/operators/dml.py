"""Data modification as new versions of a DataFrame, with the counts of the rows affected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType


class DuplicateKey(ValueError):
    """An inserted key is there already."""


def insert(table: DataFrame, rows: DataFrame, key: list[str], on_conflict: str = "skip") -> DataFrame:
    """The table with the rows. Rows whose key is there are passed over ("skip") or are an error ("error"); of rows with one key, one goes in."""
    if on_conflict == "error":
        clash = rows.join(table.select(*key), key, "left_semi").limit(1).count() or rows.groupBy(*key).count().where("count > 1").limit(1).count()
        if clash:
            raise DuplicateKey("Duplicate entry")
    fresh = rows.dropDuplicates(key).join(table.select(*key), key, "left_anti").select(*table.columns)
    return table.unionByName(fresh)


def inserted(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """One row: how many rows an insert with "skip" adds."""
    return rows.dropDuplicates(key).join(table.select(*key), key, "left_anti").agg(F.count(F.lit(1)).alias("affected"))


def update(table: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return table.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c) if c in changes else F.col(c) for c in table.columns])


def updated(table: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    """One row: how many rows an update changes; a row that gets its own values isn't counted."""
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(x.cast(table.schema[c].dataType)) for c, x in changes.items()])
    return table.where(condition).where(differs).agg(F.count(F.lit(1)).alias("affected"))


def delete(table: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition isn't true."""
    return table.where(~F.coalesce(condition, F.lit(False)))


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows replace those with their key, or are added."""
    return table.join(rows.select(*key), key, "left_anti").select(*table.columns).unionByName(rows.dropDuplicates(key).select(*table.columns))


def compare_and_set(table: DataFrame, key: list[str], old: DataFrame, new: DataFrame) -> DataFrame:
    """Replaces the rows that equal ``old`` in every column by the rows of ``new`` with their key."""
    same = reduce(lambda a, b: a & b, [table[c].eqNullSafe(old[c]) for c in table.columns])
    matched = table.join(old, same, "left_semi")
    swapped = new.join(matched.select(*key), key, "left_semi").select(*table.columns)
    return table.join(swapped.select(*key), key, "left_anti").select(*table.columns).unionByName(swapped)


def with_auto_increment(rows: DataFrame, column: str, order: list[str], start: int = 1, parts: int = 64) -> DataFrame:
    """Numbers rows from ``start`` in an order. Ranges of the first key of the order are counted first, so ranking is not one
    task's work. Their bounds are literal values taken before either pass, so that both deal the rows alike."""
    first = rows.schema[order[0]].dataType
    known = rows.where(F.col(order[0]).isNotNull()).select(F.col(order[0]).alias("k"))
    numeric = isinstance(first, (NumericType, DateType, TimestampType, TimestampNTZType))
    if numeric:
        cuts = known.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)]).alias("c")).first().c or []
    else:  # of a bounded sample, by hash
        some = [r.k for r in known.orderBy(F.xxhash64("k")).limit(parts * 64).orderBy("k").collect()]
        cuts = [some[i * len(some) // parts] for i in range(1, parts)] if some else []
    cuts = sorted(set(cuts))
    range_ = F.lit(0)
    if cuts:
        bounds = F.array(*[F.lit(c).cast(first) for c in cuts])
        range_ = F.when(F.col(order[0]).isNull(), F.lit(0)).otherwise(F.size(F.filter(bounds, lambda b: b < F.col(order[0]))) + 1)
    dealt = rows.withColumn("_p", range_)
    counts = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    ranked = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    return ranked.join(F.broadcast(before), "_p").select((F.col("_b") + F.col("_r") + (start - 1)).cast("long").alias(column), *rows.columns)
