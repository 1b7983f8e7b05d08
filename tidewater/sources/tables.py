"""Tables as Parquet folders or files, and as views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """SCAN(name): columns and filters that a query uses reach the Parquet reader."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def register(spark: SparkSession, directory: str, names: list[str] = TABLES) -> None:
    """Temporary views for SQL text."""
    for name in names:
        table(spark, directory, name).createOrReplaceTempView(name)
