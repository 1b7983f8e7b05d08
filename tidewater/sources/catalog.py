"""The information schema, and SHOW statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.strings import like

#: Tables of the information schema that never have rows, with the first of their columns.
ALWAYS_EMPTY = ["events", "triggers", "routines", "files", "key_column_usage", "column_statistics", "user_privileges", "schema_privileges", "table_privileges", "views", "column_privileges", "collations"]


def tables(spark: SparkSession) -> DataFrame:
    rows = [(t.namespace[-1] if t.namespace else spark.catalog.currentDatabase(), t.name, "VIEW" if t.isTemporary else "BASE TABLE") for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_schema string, table_name string, table_type string")


def columns(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    rows = []
    for t in names or [t.name for t in spark.catalog.listTables()]:
        rows += [(t, f.name, i + 1, "YES" if f.nullable else "NO", f.dataType.simpleString()) for i, f in enumerate(spark.table(t).schema)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, is_nullable string, data_type string")


def schemata(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d.catalog or "", d.name) for d in spark.catalog.listDatabases()], "catalog_name string, schema_name string")


def global_variables(spark: SparkSession) -> DataFrame:
    return spark.sql("SET -v").selectExpr("key AS variable_name", "value AS variable_value")


def partitions(spark: SparkSession, table: str) -> DataFrame:
    """The files of a table with their sizes are its partitions here."""
    return spark.table(table).selectExpr("_metadata.file_path AS partition_name", "_metadata.file_size AS data_length").distinct()


def table_constraints(spark: SparkSession) -> DataFrame:
    """Primary keys that columns carry in their metadata."""
    rows = [(t.name, f.name) for t in spark.catalog.listTables() for f in spark.table(t.name).schema if f.metadata.get("primary_key")]
    return spark.createDataFrame(rows, "table_name string, column_name string").selectExpr("table_name", "column_name", "'PRIMARY KEY' AS constraint_type")


def statistics(spark: SparkSession) -> DataFrame:
    """Columns of the primary keys that tables carry as a property."""
    rows = []
    for t in spark.catalog.listTables():
        if not t.isTemporary:
            key = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES `{t.name}`").collect()}.get("tidewater.key", "")
            rows += [(t.name, "PRIMARY", i + 1, c) for i, c in enumerate(key.split(",")) if c]
    return spark.createDataFrame(rows, "table_name string, index_name string, seq_in_index int, column_name string")


def information_schema(spark: SparkSession, name: str) -> DataFrame:
    known = {"tables": tables, "columns": columns, "schemata": schemata, "global_variables": global_variables, "table_constraints": table_constraints, "statistics": statistics}
    return known[name.lower()](spark) if name.lower() in known else empty_table(spark, name)


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    if name.lower() not in ALWAYS_EMPTY:
        raise ValueError(f"no such table: {name}")
    return spark.createDataFrame([], "table_schema string, table_name string")


def show_tables(spark: SparkSession, pattern: str = "%") -> DataFrame:
    t = tables(spark)
    return t.where(like(t["table_name"], pattern)).select("table_name")


def show_columns(spark: SparkSession, table: str, pattern: str = "%") -> DataFrame:
    """Field, type and nullability; the table may be a view or a frame's columns."""
    c = columns(spark, [table])
    return c.where(like(c["column_name"], pattern)).selectExpr("column_name AS field", "data_type AS type", "is_nullable AS null")


def explain(df: DataFrame, mode: str = "formatted") -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
