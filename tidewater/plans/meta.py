"""The information schema and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.statistics import analyze, histogram
from ..sources import catalog
from ..sources.tables import TABLES, register
from .registry import Registry

q = Registry()
NAMES = "[" + ", ".join(f"'{n}'" for n in TABLES) + "]"


def registered(t):
    register(t.spark, t.directory)
    return t.spark


q("info_tables", f"SELECT unnest({NAMES}) AS table_name, 'VIEW' AS table_type")(lambda t: catalog.tables(registered(t)).where(F.col("table_name").isin(TABLES)).select("table_name", "table_type"))
q("info_columns", "SELECT 'nation' AS table_name, * FROM (VALUES ('n_nationkey', 1, 'YES', 'int'), ('n_name', 2, 'YES', 'string'), ('n_regionkey', 3, 'YES', 'int')) v(column_name, ordinal_position, is_nullable, data_type)")(lambda t: catalog.columns(registered(t), ["nation"]))
q("info_schemata", "SELECT 'default' AS schema_name")(lambda t: catalog.schemata(t.spark).where("schema_name = 'default'").select("schema_name"))
q("info_always_empty", "SELECT 'a' AS table_schema, 'b' AS table_name WHERE false")(lambda t: catalog.empty_table(t.spark, "triggers"))
q("show_tables_like", "SELECT unnest(['part', 'pages']) AS table_name")(lambda t: catalog.show_tables(registered(t), "PA%"))
q("show_columns_like", "SELECT * FROM (VALUES ('p_name', 'string', 'YES')) v(field, type, \"null\")")(lambda t: catalog.show_columns(registered(t), "part", "%NAME"))
q("analyze_counts", "SELECT count(*) AS n, CAST(sum((o_custkey IS NULL)::INT) AS BIGINT) AS nulls, min(o_custkey) AS least, max(o_custkey) AS greatest FROM orders")(lambda t: analyze(t.orders, "o_custkey").drop("ndv"))
q("analyze_histogram", "WITH f AS (SELECT CAST(min(o_totalprice) AS DOUBLE) lo, CAST(max(o_totalprice) AS DOUBLE) hi FROM orders) SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 254)), 253) AS INT) AS bucket, count(*) AS n FROM orders, f GROUP BY 1")(lambda t: histogram(t.orders, "o_totalprice").select("bucket", "n"))
