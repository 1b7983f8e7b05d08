"""Order-insensitive comparison of a Spark result with DuckDB's."""

import decimal

import duckdb

from tidewater.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def duck(directory):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{directory}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, dict):
        return str(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, decimal.Decimal):
        v = int(v) if v == v.to_integral_value() else float(v)
    return repr(v) if isinstance(v, float) else str(v)


def rows(table):
    columns = [table.column(c).to_pylist() for c in sorted(table.column_names)]
    return sorted(tuple(plain(v) for v in r) for r in zip(*columns))


def same(spark_df, duck_df):
    a, b = spark_df.toArrow(), duck_df.to_arrow_table()
    assert sorted(a.column_names) == sorted(b.column_names)
    assert rows(a) == rows(b)
