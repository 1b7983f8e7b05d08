"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, so a hub with very many links is combined before the shuffle and its join can
be split; edges go to checkpoints in the shared folder, never to the driver. A step's files follow the number of edges, not
the shuffle's partitions: on a local file system the executor starts two processes for each file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint

#: Edges of one file.
EACH = 1 << 16


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link: component is the least node it reaches. Nodes are longs."""
    now = checkpoint(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    state, cores = _state(now), edges.sparkSession.sparkContext.defaultParallelism
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = checkpoint(small.coalesce(max(cores, -(-state[0] // EACH))))  # no step has more edges than the one before
        was, state = state, _state(now)
        if state == was:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
