"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def session(master: str = "local[*]", **options: str) -> SparkSession:
    """A session with the engine's settings: UTC, case-insensitive names, adaptive execution.

    On one machine a shuffle has 8 partitions. On a cluster shuffles start from many, which adaptive execution joins to
    partitions of the advisory size, so their number follows the data.
    """
    builder = SparkSession.builder.master(master).appName("tidewater")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.caseSensitive": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **({"spark.sql.shuffle.partitions": "8"} if master.startswith("local") else {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8192"}),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (settings | {k.replace("__", "."): v for k, v in options.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once per application, as a zip file."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tidewater-"), "tidewater.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tidewater", os.path.relpath(full, top)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
