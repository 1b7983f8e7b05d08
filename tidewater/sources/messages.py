"""JSON and Avro records, in files or from Kafka."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = False) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep=sep, header=header)


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=not lines)


def decode_json(df: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Records in a column, as their fields; records that can't be read are rows of NULL."""
    return df.select(F.from_json(F.col(value).cast("string"), schema).alias("r")).select("r.*")


def kafka(spark: SparkSession, servers: str, topic: str, start: str = "earliest") -> DataFrame:
    """A stream of a topic's records; needs Spark's Kafka package on the class path."""
    return spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": start}).load()


def kafka_json(spark: SparkSession, servers: str, topic: str, schema: str) -> DataFrame:
    return decode_json(kafka(spark, servers, topic), schema)


def decode_avro(df: DataFrame, schema: str, value: str = "value", registry_header: bool = True) -> DataFrame:
    """Avro records in a column, as their fields; ``registry_header``: five bytes of a schema registry come first. Needs Spark's Avro package."""
    from pyspark.sql.avro.functions import from_avro

    raw: Column = F.col(value)
    if registry_header:
        raw = F.substring(raw, 6, 1 << 30)
    return df.select(from_avro(raw, schema).alias("r")).select("r.*")


def kafka_avro(spark: SparkSession, servers: str, topic: str, schema: str) -> DataFrame:
    return decode_avro(kafka(spark, servers, topic), schema)
