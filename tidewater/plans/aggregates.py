"""Aggregation, set operations and sub-queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import int_avg, sum0, sum_as
from ..operators.relational import all_rows, any_row, unique
from .registry import Registry

q = Registry()

q("agg_sum_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 2) AS avg_price FROM lineitem GROUP BY ALL")(
    lambda t: t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 2).alias("avg_price"))
)
q("agg_count_star", "SELECT count(*) AS n FROM lineitem")(lambda t: t.lineitem.agg(F.count("*").alias("n")))
q("agg_count_col", "SELECT count(NULLIF(s_nationkey, 5)) AS n, count(*) AS every FROM supplier")(lambda t: t.supplier.agg(F.count(F.nullif(F.col("s_nationkey"), F.lit(5))).alias("n"), F.count("*").alias("every")))
q("agg_count_group", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")(lambda t: t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")))
q("agg_sum_int", "SELECT p_brand, CAST(sum(p_size) AS INT) AS total FROM part GROUP BY p_brand")(lambda t: t.part.groupBy("p_brand").agg(sum_as(F.col("p_size"), "int").alias("total")))
q("agg_sum0_empty", "SELECT coalesce(sum(p_size), 0)::BIGINT AS s0, sum(p_size)::BIGINT AS s FROM part WHERE p_size < 0")(lambda t: t.part.where("p_size < 0").agg(sum0(F.col("p_size")).alias("s0"), F.sum("p_size").alias("s")))
q("agg_min_max_types", "SELECT min(o_orderdate) AS d0, max(o_orderdate) AS d1, min(o_orderpriority) AS s0, max(o_orderpriority) AS s1, min(o_totalprice) AS p0, max(o_totalprice) AS p1, min(o_orderkey) AS k0 FROM orders")(
    lambda t: t.orders.agg(F.min("o_orderdate").alias("d0"), F.max("o_orderdate").alias("d1"), F.min("o_orderpriority").alias("s0"), F.max("o_orderpriority").alias("s1"), F.min("o_totalprice").alias("p0"), F.max("o_totalprice").alias("p1"), F.min("o_orderkey").alias("k0"))
)
q("agg_avg_double", "SELECT c_mktsegment, round(avg(c_acctbal), 4) AS a FROM customer GROUP BY c_mktsegment")(lambda t: t.customer.groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("a")))
q("agg_avg_int_trunc", "SELECT p_brand, CAST(sum(p_size) // count(p_size) AS BIGINT) AS a FROM part GROUP BY p_brand")(lambda t: t.part.groupBy("p_brand").agg(int_avg(F.col("p_size")).alias("a")))
q("agg_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")(lambda t: t.lineitem.select("l_returnflag", "l_linestatus").distinct())
q("agg_count_distinct_one", "SELECT count(DISTINCT o_custkey) AS n, sum(DISTINCT o_custkey)::BIGINT AS s FROM orders")(lambda t: t.orders.agg(F.count_distinct("o_custkey").alias("n"), F.sum_distinct("o_custkey").alias("s")))
q("agg_count_distinct_multi", "SELECT count(DISTINCT l_suppkey) AS a, count(DISTINCT l_partkey) AS b, count(DISTINCT l_returnflag) AS c FROM lineitem")(lambda t: t.lineitem.agg(F.count_distinct("l_suppkey").alias("a"), F.count_distinct("l_partkey").alias("b"), F.count_distinct("l_returnflag").alias("c")))
q("agg_mixed_distinct", "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS d, max(l_quantity) AS m FROM lineitem GROUP BY l_returnflag")(lambda t: t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("d"), F.max("l_quantity").alias("m")))
q("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")(lambda t: t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12"))
q("agg_global_empty", "SELECT count(*) AS n, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0")(lambda t: t.orders.where("o_orderkey < 0").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("m")))
q("agg_stddev_var", "SELECT round(stddev_samp(l_quantity), 6) AS s, round(stddev_pop(l_quantity), 6) AS p, round(var_samp(l_quantity), 6) AS vs, round(var_pop(l_quantity), 6) AS vp FROM lineitem")(
    lambda t: t.lineitem.agg(F.round(F.stddev_samp("l_quantity"), 6).alias("s"), F.round(F.stddev_pop("l_quantity"), 6).alias("p"), F.round(F.var_samp("l_quantity"), 6).alias("vs"), F.round(F.var_pop("l_quantity"), 6).alias("vp"))
)
q("agg_single_value", "SELECT c_custkey FROM customer WHERE c_nationkey = (SELECT n_nationkey FROM nation WHERE n_nationkey = 7)")(lambda t: t.sql("SELECT c_custkey FROM customer WHERE c_nationkey = (SELECT n_nationkey FROM nation WHERE n_nationkey = 7)", "customer", "nation"))

q("union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT r_name FROM region")(lambda t: t.nation.select(F.col("n_name").alias("name")).union(t.region.select("r_name")).union(t.region.select("r_name")))
q("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")(lambda t: t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct())
q("union_values", "SELECT 1 AS a UNION ALL SELECT 2 UNION ALL SELECT 2")(lambda t: t.sql("SELECT 1 AS a UNION ALL VALUES (2), (2)"))
q("scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)")(lambda t: t.sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)", "orders"))
q("correlated_scalar", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS best FROM customer")(lambda t: t.sql("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS best FROM customer", "customer", "orders"))
q("subquery_all", "SELECT c_custkey FROM customer WHERE c_acctbal > ALL (SELECT s_acctbal FROM supplier)")(lambda t: all_rows(t.customer, F.col("c_acctbal"), ">", t.supplier, "s_acctbal").select("c_custkey"))
q("subquery_any", "SELECT c_custkey FROM customer WHERE c_acctbal < ANY (SELECT s_acctbal FROM supplier WHERE s_acctbal < 0)")(lambda t: any_row(t.customer, F.col("c_acctbal"), "<", t.supplier.where("s_acctbal < 0"), "s_acctbal").select("c_custkey"))
q("subquery_unique", "SELECT count(*) = 0 AS is_unique FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)")(lambda t: unique(t.orders, ["o_custkey"]))
q("subquery_array", "SELECT r_regionkey, (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey) AS names FROM region")(
    lambda t: t.region.join(t.nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names")), "r_regionkey", "left").select("r_regionkey", "names")
)
q("cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1) SELECT c_custkey, round(s, 2) AS s FROM big JOIN customer ON c_custkey = o_custkey WHERE s > 2000000")(
    lambda t: t.sql("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1) SELECT c_custkey, round(s, 2) AS s FROM big JOIN customer ON c_custkey = o_custkey WHERE s > 2000000", "orders", "customer")
)
