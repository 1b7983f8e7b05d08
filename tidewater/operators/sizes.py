"""Broadcasting behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that Catalyst may estimate for a side that is broadcast.
LIMIT = 32 << 20


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A broadcast hint if the estimate is within the limit; else the frame alone, and the join shuffles."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df
