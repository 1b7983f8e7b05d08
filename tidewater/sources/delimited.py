"""LOAD DATA and INTO OUTFILE: delimited text with NULL as \\N, booleans as 1 and 0, binary as base64."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DateType, StructType, TimestampNTZType, TimestampType

from ..functions.temporal import parse_date, parse_timestamp

NULL = "\\N"


def _value(x: Column, kind) -> Column:
    """A text field as a value of the column's type; what can't be read is NULL."""
    if isinstance(kind, BooleanType):
        return F.when(x.isin("1", "true", "TRUE"), True).when(x.isin("0", "false", "FALSE"), False)
    if isinstance(kind, DateType):
        return parse_date(x)
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return parse_timestamp(x).cast(kind)
    if isinstance(kind, BinaryType):
        return F.unbase64(x)
    if isinstance(kind, ArrayType):
        inner = F.regexp_replace(x, r"^\[|\]$", "")
        return F.when(inner == "", F.array().cast(kind)).otherwise(F.split(inner, ",").try_cast(kind))
    return x.try_cast(kind)


def load_data(spark: SparkSession, path: str, schema: StructType, sep: str = "\t", enclosed: str | None = None, escaped: str = "\\", line_end: str = "\n", starting: str = "", ignore: int = 0, encoding: str = "UTF-8") -> DataFrame:
    """Rows of a delimited file. ``starting``: what a line has to hold; it and what comes before it are passed over.
    ``ignore``: the first lines of each file. Missing fields are NULL, and so are fields that are \\N as they stand; an
    escape before any other character is dropped. A line end always ends a row."""
    lines = spark.read.option("encoding", encoding).text(path, lineSep=line_end)
    if ignore:  # only a file's first block can hold its first lines
        lines = lines.select("value", F.input_file_name().alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
        head = lines.where(F.col("b") == 0).withColumn("r", F.row_number().over(Window.partitionBy("f").orderBy("i"))).where(F.col("r") > ignore)
        lines = head.select("value").unionByName(lines.where(F.col("b") > 0).select("value"))
    if starting:
        lines = lines.where(F.col("value").contains(starting)).select(F.regexp_replace("value", "^.*?" + re.escape(starting), "").alias("value"))
    e, s = re.escape(escaped), re.escape(sep)
    plain = f"(?:{e}.|(?!{s})[^{e}])*"
    field = f"{re.escape(enclosed)}(?:{e}.|[^{e}{re.escape(enclosed)}])*{re.escape(enclosed)}|{plain}" if enclosed else plain
    parts = lines.select(F.regexp_extract_all(F.concat("value", F.lit(sep)), F.lit(f"(?s)({field}){s}"), F.lit(1)).alias("p"))

    def clean(x: Column) -> Column:
        bare = F.when(x.startswith(enclosed) & x.endswith(enclosed) & (F.char_length(x) > 1), F.substr(x, F.lit(2), F.char_length(x) - 2)).otherwise(x) if enclosed else x
        return F.when(bare == NULL, F.lit(None)).otherwise(F.regexp_replace(bare, f"(?s){e}(.)", "$1"))

    return parts.select(*[_value(clean(F.try_element_at("p", F.lit(i + 1))), f.dataType).alias(f.name) for i, f in enumerate(schema)])


def _field(x: Column, kind, special: list[str], enclosed: str, escaped: str) -> Column:
    if isinstance(kind, BooleanType):
        text = F.when(x, "1").otherwise("0")
    elif isinstance(kind, BinaryType):
        text = F.base64(x)
    elif isinstance(kind, ArrayType):
        text = F.concat(F.lit("["), F.array_join(x.cast("array<string>"), ","), F.lit("]"))
    else:
        text = x.cast("string")
        for c in special:
            text = F.replace(text, F.lit(c), F.lit(escaped + c))
    return F.when(x.isNull(), F.lit(NULL)).otherwise(F.concat(F.lit(enclosed), text, F.lit(enclosed)))


def export_outfile(df: DataFrame, path: str, sep: str = "\t", enclosed: str = "", escaped: str = "\\", line_end: str = "\n", starting: str = "") -> None:
    """Writes delimited lines to a new folder, a file per task; an existing path is an error."""
    special = [escaped] + [c for c in (sep, enclosed, line_end) if c]
    fields = [_field(F.col(f"`{f.name}`"), f.dataType, special, enclosed, escaped) for f in df.schema]
    df.select(F.concat(F.lit(starting), F.concat_ws(sep, *fields)).alias("value")).write.mode("error").option("lineSep", line_end).text(path)
