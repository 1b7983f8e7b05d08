"""Table statistics: histogram, distinct count, count-min sketch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 254


def analyze(df: DataFrame, column: str) -> DataFrame:
    """One row: rows, nulls, distinct (approximate), least, greatest."""
    c = F.col(column)
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(c.isNull().cast("long")).alias("nulls"), F.approx_count_distinct(c).alias("ndv"), F.min(c).alias("least"), F.max(c).alias("greatest"))


def analyze_table(df: DataFrame) -> DataFrame:
    """A row per column: column_name, n, nulls, ndv (approximate), least and greatest as text. One scan, one aggregation."""
    plain = [f.name for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct", "variant")]
    col = lambda c: F.col(f"`{c}`")
    facts = [F.struct(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n"), F.sum(col(c).isNull().cast("long")).alias("nulls"), F.approx_count_distinct(col(c)).alias("ndv"), F.min(col(c)).cast("string").alias("least"), F.max(col(c)).cast("string").alias("greatest")) for c in plain]
    return df.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))


def histogram(df: DataFrame, column: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, low, high, n) of equal-width buckets between the least and the greatest value: two aggregations, no sort."""
    facts = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / buckets
    at = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((F.col(column).cast("double") - F.col("lo")) / width), F.lit(buckets - 1)))
    counted = df.where(F.col(column).isNotNull()).select(column).join(F.broadcast(facts)).groupBy(at.cast("int").alias("bucket"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("bucket", (F.col("lo") + F.col("bucket") * width).alias("low"), (F.col("lo") + (F.col("bucket") + 1) * width).alias("high"), "n")


class CountMin:
    """Frequency estimates from a sketch of depth x width counters, built map-side as one row."""

    def __init__(self, df: DataFrame, column: str, depth: int = 5, width: int = 2048, seed: int = 1):
        self.depth, self.width, self.seed = depth, width, seed
        cells = F.explode(F.array(*[(F.pmod(F.xxhash64(F.lit(seed + d), column), F.lit(width)) + d * width).cast("int") for d in range(depth)]))
        got = df.where(F.col(column).isNotNull()).select(cells.alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toPandas()
        self.cells = np.zeros(depth * width, dtype=np.int64)  # depth * width at most reach the driver
        self.cells[got["cell"]] = got["n"]
        self.spark = df.sparkSession

    def estimate(self, value, kind: str = "string") -> int:
        row = self.spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(self.seed + d), F.lit(value).cast(kind)), F.lit(self.width)).alias(f"d{d}") for d in range(self.depth)]).first()
        return int(min(self.cells[row[d] + d * self.width] for d in range(self.depth)))
