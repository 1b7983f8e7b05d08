"""Data modification, loading and exporting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dml
from ..operators.relational import key_range, values
from ..sources.delimited import export_outfile, load_data
from ..sources.scratch import scratch
from .registry import Registry

q = Registry()
c = F.col


def nation(t):
    return t.nation.select("n_nationkey", "n_name")


NEW = [(3, "TWICE"), (30, "NEW"), (31, "NEWER")]
q("insert_ignore_dup", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT * FROM (VALUES (30, 'NEW'), (31, 'NEWER'))")(lambda t: dml.insert(nation(t), values(t.spark, NEW, "n_nationkey int, n_name string"), ["n_nationkey"]))
q("insert_count", "SELECT 2::BIGINT AS affected")(lambda t: dml.inserted(nation(t), values(t.spark, NEW, "n_nationkey int, n_name string"), ["n_nationkey"]))
q("insert_select", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey + 100, r_name FROM region")(lambda t: dml.insert(nation(t), t.region.select((c("r_regionkey") + 100).alias("n_nationkey"), c("r_name").alias("n_name")), ["n_nationkey"]))
q("update_expr", "SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN s_acctbal * 2 ELSE s_acctbal END AS s_acctbal FROM supplier")(lambda t: dml.update(t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal"), c("s_nationkey") == 3, {"s_acctbal": c("s_acctbal") * 2}).select("s_suppkey", "s_acctbal"))
q("update_expr_count", "SELECT count(*) AS affected FROM part WHERE p_size < 20 AND p_size <> 10")(lambda t: dml.updated(t.part, c("p_size") < 20, {"p_size": F.lit(10)}))
q("delete_where", "SELECT c_custkey FROM customer WHERE NOT coalesce(c_acctbal < 0, false)")(lambda t: dml.delete(t.customer, c("c_acctbal") < 0).select("c_custkey"))
q("delete_range", "SELECT o_orderkey FROM orders WHERE NOT (o_orderkey >= 100 AND o_orderkey < 9000)")(lambda t: key_range(t.orders, "o_orderkey", high=100, with_high=False).unionByName(key_range(t.orders, "o_orderkey", low=9000)).select("o_orderkey"))
q("upsert", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT * FROM (VALUES (3, 'TWICE'), (30, 'NEW'), (31, 'NEWER'))")(lambda t: dml.upsert(nation(t), values(t.spark, NEW, "n_nationkey int, n_name string"), ["n_nationkey"]))


@q("compare_and_set", "SELECT n_nationkey, CASE WHEN n_nationkey = 1 THEN 'SWAPPED' ELSE n_name END AS n_name FROM nation")
def _(t):
    old = nation(t).where("n_nationkey = 1").unionByName(values(t.spark, [(2, "not this")], "n_nationkey int, n_name string"))
    return dml.compare_and_set(nation(t), ["n_nationkey"], old, values(t.spark, [(1, "SWAPPED"), (2, "no")], "n_nationkey int, n_name string"))


q("auto_increment", "SELECT row_number() OVER (ORDER BY p_name, p_partkey) + 1000 AS id, p_partkey FROM part")(lambda t: dml.with_auto_increment(t.part.select("p_partkey", "p_name"), "id", ["p_name", "p_partkey"], 1001, 8).select("id", "p_partkey"))


@q("load_export_roundtrip", "SELECT p_partkey, p_name, p_size, p_retailprice, p_size > 20 AS big, NULLIF(p_brand, 'Brand#1') AS brand FROM part")
def _(t):
    path = scratch(t.spark, "outfile")
    out = t.part.select("p_partkey", "p_name", "p_size", "p_retailprice", (c("p_size") > 20).alias("big"), F.nullif(c("p_brand"), F.lit("Brand#1")).alias("brand"))
    export_outfile(out, path, sep="|")
    return load_data(t.spark, path, out.schema, sep="|")
