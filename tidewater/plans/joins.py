"""Joins, semi joins and anti joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.relational import null_matching_join
from ..operators.sizes import broadcast_if_small
from .registry import Registry

q = Registry()
c = F.col
ON = "c_custkey = o_custkey"

q("join_inner", f"SELECT c_custkey, o_orderkey FROM customer JOIN orders ON {ON}")(lambda t: t.customer.join(t.orders, c("c_custkey") == c("o_custkey")).select("c_custkey", "o_orderkey"))
q("join_inner_filtered", f"SELECT c_name, o_orderkey FROM customer JOIN orders ON {ON} WHERE o_totalprice > 200000 AND c_mktsegment = 'BUILDING'")(lambda t: t.customer.where(c("c_mktsegment") == "BUILDING").join(t.orders.where("o_totalprice > 200000"), c("c_custkey") == c("o_custkey")).select("c_name", "o_orderkey"))
q("join_left", "SELECT n_name, s_suppkey FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 8000")(lambda t: t.nation.join(t.supplier.where("s_acctbal > 8000"), c("n_nationkey") == c("s_nationkey"), "left").select("n_name", "s_suppkey"))
q("join_left_is_null", f"SELECT c_custkey FROM customer LEFT JOIN orders ON {ON} WHERE o_orderkey IS NULL")(lambda t: t.customer.join(t.orders, c("c_custkey") == c("o_custkey"), "left").where("o_orderkey IS NULL").select("c_custkey"))
q("join_right", "SELECT s_suppkey, n_name FROM (SELECT * FROM supplier WHERE s_acctbal > 8000) RIGHT JOIN nation ON n_nationkey = s_nationkey")(lambda t: t.supplier.where("s_acctbal > 8000").join(t.nation, c("n_nationkey") == c("s_nationkey"), "right").select("s_suppkey", "n_name"))
q("join_full", "SELECT a.n_nationkey AS a, b.s_suppkey AS b FROM (SELECT * FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT * FROM supplier WHERE s_nationkey > 10) b ON a.n_nationkey = b.s_nationkey")(
    lambda t: t.nation.where("n_nationkey < 15").join(t.supplier.where("s_nationkey > 10"), c("n_nationkey") == c("s_nationkey"), "full").select(c("n_nationkey").alias("a"), c("s_suppkey").alias("b"))
)
q("join_cross", "SELECT r_name, n_name FROM region, nation")(lambda t: t.region.crossJoin(t.nation).select("r_name", "n_name"))
q("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey > b.n_regionkey")(
    lambda t: t.nation.alias("a").join(broadcast_if_small(t.nation).alias("b"), (c("a.n_nationkey") < c("b.n_nationkey")) & (c("a.n_regionkey") > c("b.n_regionkey"))).select(c("a.n_nationkey").alias("a"), c("b.n_nationkey").alias("b"))
)
q("join_mixed_residual", f"SELECT c_custkey, o_orderkey FROM customer JOIN orders ON {ON} AND o_totalprice > c_acctbal * 30")(lambda t: t.customer.join(t.orders, (c("c_custkey") == c("o_custkey")) & (c("o_totalprice") > c("c_acctbal") * 30)).select("c_custkey", "o_orderkey"))
q("join_left_residual", f"SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON {ON} AND o_totalprice > c_acctbal * 30")(lambda t: t.customer.join(t.orders, (c("c_custkey") == c("o_custkey")) & (c("o_totalprice") > c("c_acctbal") * 30), "left").select("c_custkey", "o_orderkey"))
q("join_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")(
    lambda t: t.supplier.alias("a").join(t.supplier.alias("b"), (c("a.s_nationkey") == c("b.s_nationkey")) & (c("a.s_suppkey") < c("b.s_suppkey"))).select(c("a.s_suppkey").alias("a"), c("b.s_suppkey").alias("b"))
)
q("join_using", "SELECT doc_id, quality FROM documents JOIN labels USING (doc_id)")(lambda t: t.documents.join(t.labels, "doc_id").select("doc_id", "quality"))
q("join_natural", "SELECT doc_id, toxic FROM documents NATURAL JOIN labels")(lambda t: t.sql("SELECT doc_id, toxic FROM documents NATURAL JOIN labels", "documents", "labels"))
q("join_three", "SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")(
    lambda t: t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")).join(t.region, c("n_regionkey") == c("r_regionkey")).groupBy("r_name", "n_name").agg(F.count("*").alias("n"))
)
q("join_agg_revenue", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")(
    lambda t: t.lineitem.join(broadcast_if_small(t.supplier.join(broadcast_if_small(t.nation), c("s_nationkey") == c("n_nationkey")).select("s_suppkey", "n_name")), c("l_suppkey") == c("s_suppkey")).groupBy("n_name").agg(F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("revenue"))
)


@q("join_nullsafe", "WITH a AS (SELECT s_suppkey, NULLIF(s_nationkey, 5) AS k FROM supplier), b AS (SELECT n_nationkey, NULLIF(n_nationkey, 6) AS j FROM nation) SELECT s_suppkey, n_nationkey FROM a JOIN b ON k IS NOT DISTINCT FROM j")
def _(t):
    a = t.supplier.select("s_suppkey", F.nullif(c("s_nationkey"), F.lit(5)).alias("k"))
    return null_matching_join(a, t.nation.select("n_nationkey", F.nullif(c("n_nationkey"), F.lit(6)).alias("j")), "k", "j").select("s_suppkey", "n_nationkey")


q("join_values", "SELECT a.k, a.x, b.y FROM (VALUES (1, 'a'), (2, 'b'), (2, 'c')) a(k, x) JOIN (VALUES (2, 'd'), (3, 'e')) b(k, y) ON a.k = b.k")(lambda t: t.sql("SELECT a.k, a.x, b.y FROM VALUES (1, 'a'), (2, 'b'), (2, 'c') a(k, x) JOIN VALUES (2, 'd'), (3, 'e') b(k, y) ON a.k = b.k"))
q("semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")(lambda t: t.customer.join(t.orders.where("o_totalprice > 300000"), c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey"))
q("semi_exists", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49 AND l_discount > 0.09)")(lambda t: t.supplier.join(t.lineitem.where("l_quantity > 49 AND l_discount > 0.09"), c("l_suppkey") == c("s_suppkey"), "left_semi").select("s_suppkey"))
q("anti_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")(lambda t: t.sql("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", "customer", "orders"))
q("anti_not_in_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(s_nationkey, 5) FROM supplier)")(lambda t: t.sql("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(s_nationkey, 5) FROM supplier)", "nation", "supplier"))
q("anti_not_exists", f"SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE {ON} AND o_orderstatus = 'F')")(lambda t: t.customer.join(t.orders.where("o_orderstatus = 'F'"), c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey"))
