"""What several operators need from the session: the shared folder, checkpoints, word classes."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a class for Java's and DuckDB's regular expressions.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Tasks of one shuffle.
MOST_TASKS = 100_000

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine (tests)."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    now = spark.sparkContext._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return os.path.dirname(now.get())
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="tidewater-")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with files in the shared folder, and lets Spark remove the shuffle files that led there."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    was = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        return df.select("*").checkpoint()
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


def partitions(spark: SparkSession, size: int = 0, each: int = 32 << 20) -> int:
    """Tasks for a shuffle of ``size`` bytes: those of the session, and more if they would hold over ``each`` bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-size // each)))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate, for Parquet the size of the files, which takes no scan; 0 where it has none."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return found if found < 1 << 50 else 0


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that was made by shared_path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
