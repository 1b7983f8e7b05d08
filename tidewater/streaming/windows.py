"""Structured Streaming over event tables: watermarked windows, sessions, deduplication. An extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import remove, scratch


def stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A Parquet file or folder as a stream, in its batch schema; times become instants."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    found = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and _is_file(spark, path) else spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return found


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def tumbling(events: DataFrame, time: str, size: str, keys: list[str], late: str = "1 hour", slide: str | None = None, value: str = "value") -> DataFrame:
    """Counts and sums of ``value`` by window (sliding, if ``slide``) and keys, with a watermark for late rows."""
    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return e.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    """Sessions of each key: rows no further apart than ``gap``."""
    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return e.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def distinct(events: DataFrame, time: str, keys: list[str], late: str | None = None) -> DataFrame:
    """The first row of each key. Without ``late`` that is exact, and the state holds every key seen. With ``late`` a key is
    forgotten once the watermark is that far past it, and a row of it that comes later counts as new."""
    if late is None:
        return events.dropDuplicates(keys)
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def drain(result: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now and returns the result table.

    Each trigger writes Parquet to the shared folder; nothing is gathered on the driver. A complete result replaces the one
    before it, appended rows add up, and a trigger that is run again writes over its own files.
    """
    spark = result.sparkSession
    folder = scratch(spark, "drained")
    written: list[str] = []

    def write(rows: DataFrame, trigger: int) -> None:
        path = f"{folder}/rows/{trigger}"
        rows.write.mode("overwrite").parquet(path)
        while mode == "complete" and written:
            remove(spark, written.pop())
        written.append(path)

    query = result.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    remove(spark, f"{folder}/state")
    return spark.read.schema(result.schema).parquet(*dict.fromkeys(written)) if written else spark.createDataFrame([], result.schema)
