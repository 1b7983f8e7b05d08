"""Named queries with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import TABLES, register, table


class Tables:
    """A session's tables in a directory, as attributes."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return table(self.spark, self.directory, name)

    def sql(self, text: str, *names: str, **args) -> DataFrame:
        """SQL over views of the named tables."""
        register(self.spark, self.directory, list(names))
        return self.spark.sql(text, args=args) if args else self.spark.sql(text)


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f: Callable[[Tables], DataFrame]):
            self.queries[name] = lambda spark, directory: f(Tables(spark, directory))
            if sql:
                self.oracles[name] = sql
            return f

        return add
