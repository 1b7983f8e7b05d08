"""Scans, filters, predicates, sorting and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.strings import like, like_binary
from ..operators.relational import empty, get_by_keys, hash_partitioned, index_merge, key_range, merge_delta, ordered, page, range_partitioned, values
from .registry import Registry

q = Registry()

q("scan_full", "SELECT n_nationkey, n_name, n_regionkey FROM nation")(lambda t: t.nation)
q("scan_project", "SELECT l_orderkey, l_quantity * 2 AS twice FROM lineitem")(lambda t: t.lineitem.select("l_orderkey", (F.col("l_quantity") * 2).alias("twice")))
q("function_scan", "SELECT r_regionkey, r_name FROM region")(lambda t: t.sql("SELECT r_regionkey, r_name FROM region", "region"))
q("filter_cmp", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.02")(lambda t: t.lineitem.where((F.col("l_quantity") >= 45) & (F.col("l_discount") < 0.02)).select("l_orderkey", "l_linenumber", "l_quantity"))
q("filter_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 15")(lambda t: t.part.where(F.col("p_size").between(10, 15)).select("p_partkey", "p_size"))
q("filter_not_between", "SELECT p_partkey, p_size FROM part WHERE p_size NOT BETWEEN 5 AND 45")(lambda t: t.part.where(~F.col("p_size").between(5, 45)).select("p_partkey", "p_size"))
q("filter_in_large", f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN ({', '.join(str(i * 7) for i in range(1, 40))})")(lambda t: t.orders.where(F.col("o_orderkey").isin([i * 7 for i in range(1, 40)])).select("o_orderkey", "o_totalprice"))
q("filter_not_in", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")(lambda t: t.customer.where(~F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment"))
q("filter_like_ci", "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE '%steel%'")(lambda t: t.part.where(like(F.col("p_type"), "%STeel%")).select("p_partkey", "p_type"))
q("filter_like_class", "SELECT n_nationkey, n_name FROM nation WHERE regexp_matches(n_name, '^[a-m].*[^0-4]$', 'i')")(lambda t: t.nation.where(like(F.col("n_name"), "[a-m]%[^0-4]")).select("n_nationkey", "n_name"))
q("filter_like_escape", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%#_%' ESCAPE '#'")(lambda t: t.part.where(like(F.col("p_name"), "%#_%", "#")).select("p_partkey", "p_name"))
q("filter_like_binary", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'S%'")(lambda t: t.part.where(like_binary(F.col("p_type"), "S%")).select("p_partkey", "p_type"))
q("filter_not_like_binary", "SELECT p_partkey, p_type FROM part WHERE NOT p_type LIKE '%E%'")(lambda t: t.part.where(~like_binary(F.col("p_type"), "%E%")).select("p_partkey", "p_type"))


@q("filter_is_null", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_name IS NOT NULL AND c_custkey < 5")
def _(t):
    j = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").where(F.col("o_orderkey").isNull()).select("c_custkey", "o_orderkey")
    return j.unionByName(t.customer.where(F.col("c_name").isNotNull() & (F.col("c_custkey") < 5)).select("c_custkey", F.lit(None).cast("long").alias("o_orderkey")))


BOOLS = "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal > 0 END AS a, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_nationkey > 10 END AS b FROM supplier"


@q("filter_bool_3vl", f"SELECT s_suppkey, a AND b AS both_, a OR b AS either, NOT a AS neg, a IS TRUE AS t, a IS NOT FALSE AS nf, b IS FALSE AS f, b IS NOT TRUE AS nt FROM ({BOOLS})")
def _(t):
    a = F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal") > 0)
    b = F.when(F.col("s_suppkey") % 5 != 0, F.col("s_nationkey") > 10)
    is_true, is_false = lambda x: F.coalesce(x, F.lit(False)), lambda x: F.coalesce(~x, F.lit(False))
    return t.supplier.select("s_suppkey", (a & b).alias("both_"), (a | b).alias("either"), (~a).alias("neg"), is_true(a).alias("t"), (~is_false(a)).alias("nf"), is_false(b).alias("f"), (~is_true(b)).alias("nt"))


q("filter_null_drops", f"SELECT s_suppkey FROM ({BOOLS}) WHERE a")(lambda t: t.supplier.where(F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal") > 0)).select("s_suppkey"))
q("pk_point_get", "SELECT * FROM orders WHERE o_orderkey = 77")(lambda t: get_by_keys(t.orders, "o_orderkey", [77]))
q("pk_multi_get", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (1, 5, 9, 5000, 99999999)")(lambda t: get_by_keys(t.orders, "o_orderkey", [1, 5, 9, 5000, 99999999]).select("o_orderkey", "o_custkey"))
q("pk_get_many", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey < 6000")(lambda t: get_by_keys(t.orders, "o_orderkey", list(range(0, 6000, 3))).select("o_orderkey", "o_custkey"))
q("key_range_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 200")(lambda t: key_range(t.orders, "o_orderkey", 100, 200, with_low=False).select("o_orderkey", "o_totalprice"))
q("prefix_scan", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'part')  OR starts_with(p_name, 'Part')")(lambda t: t.part.where(F.col("p_name").startswith("part") | F.col("p_name").startswith("Part")).select("p_partkey", "p_name"))
q("index_lookup", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 10")(lambda t: t.orders.where(F.col("o_custkey") == 10).select("o_orderkey", "o_custkey"))
q("index_merge_or", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_custkey = 10 OR o_orderpriority = '1-URGENT'")(lambda t: index_merge(t.orders, ["o_orderkey"], [F.col("o_custkey") == 10, F.col("o_orderpriority") == "1-URGENT"]).select("o_orderkey", "o_custkey", "o_orderpriority"))
q("index_covering_scan", "SELECT o_custkey FROM orders WHERE o_custkey BETWEEN 20 AND 30")(lambda t: key_range(t.orders, "o_custkey", 20, 30).select("o_custkey"))


@q("txn_merged_scan", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'CHANGED' ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 4 UNION ALL SELECT 100, 'NEW'")
def _(t):
    delta = values(t.spark, [(3, "CHANGED", False), (4, "GONE", True), (100, "NEW", False)], "n_nationkey int, n_name string, _deleted boolean")
    return merge_delta(t.nation.select("n_nationkey", "n_name"), delta, ["n_nationkey"])


q("values_literal", "SELECT * FROM (VALUES (1, 'a', 1.5::DOUBLE), (2, NULL, 2.5), (NULL, 'c', NULL)) v(i, s, d)")(lambda t: values(t.spark, [(1, "a", 1.5), (2, None, 2.5), (None, "c", None)], "i int, s string, d double"))
q("values_empty", "SELECT 1 AS i, 'a' AS s WHERE false")(lambda t: empty(t.spark, "i int, s string"))
q("case_when", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class, NULLIF(p_size, 7) AS not7, COALESCE(NULLIF(p_size, 7), -1) AS or1, CASE WHEN p_size > 20 THEN 1 ELSE 0 END AS big FROM part")(
    lambda t: t.part.select("p_partkey", F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large").alias("class"), F.nullif(F.col("p_size"), F.lit(7)).alias("not7"), F.coalesce(F.nullif(F.col("p_size"), F.lit(7)), F.lit(-1)).alias("or1"), F.when(F.col("p_size") > 20, 1).otherwise(0).alias("big"))
)
q("dynamic_param", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")(lambda t: t.sql("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > :least AND c_mktsegment = :segment", "customer", least=5000, segment="BUILDING"))
q("exchange_hash", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey < 50")(lambda t: hash_partitioned(t.orders.where("o_custkey < 50").select("o_orderkey", "o_custkey"), 4, "o_custkey"))
q("exchange_range", "SELECT o_orderkey FROM orders WHERE o_orderkey < 500")(lambda t: range_partitioned(t.orders.where("o_orderkey < 500").select("o_orderkey"), 4, "o_orderkey"))

q("order_multi", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 50")(lambda t: page(ordered(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), ("c_mktsegment", False), ("c_acctbal", True), ("c_custkey", False)), 50))
q("order_full", "SELECT s_suppkey, s_name FROM supplier ORDER BY s_name DESC")(lambda t: ordered(t.supplier.select("s_suppkey", "s_name"), ("s_name", True)))
q("order_nulls", "SELECT s_suppkey, NULLIF(s_nationkey, 5) AS k FROM supplier ORDER BY k DESC NULLS FIRST, s_suppkey LIMIT 20")(lambda t: page(ordered(t.supplier.select("s_suppkey", F.nullif(F.col("s_nationkey"), F.lit(5)).alias("k")), ("k", True), ("s_suppkey", False)), 20))
q("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")(lambda t: page(ordered(t.orders.select("o_orderkey"), ("o_orderkey", False)), 10, 25))
q("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")(lambda t: page(ordered(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), ("l_extendedprice", True), ("l_orderkey", False), ("l_linenumber", False)), 100))
q("limit_zero", "SELECT n_nationkey FROM nation LIMIT 0")(lambda t: t.nation.select("n_nationkey").limit(0))
