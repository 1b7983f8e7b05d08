"""What Spark adds: windows, grouping sets, set differences, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..streaming import windows
from ..operators.filters import filter_column
from ..operators.relational import gather
from .registry import Registry

q = Registry()
c = F.col

q("win_rank", "SELECT s_suppkey, rank() OVER w AS r, dense_rank() OVER w AS d, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS n FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC)")(
    lambda t: t.supplier.select("s_suppkey", F.rank().over(Window.partitionBy("s_nationkey").orderBy(c("s_acctbal").desc())).alias("r"), F.dense_rank().over(Window.partitionBy("s_nationkey").orderBy(c("s_acctbal").desc())).alias("d"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy(c("s_acctbal").desc(), "s_suppkey")).alias("n"))
)
q("win_frame", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS l FROM orders")(
    lambda t: t.orders.select("o_orderkey", F.round(F.sum("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)), 2).alias("s"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("l"))
)
q("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")(lambda t: t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")))
q("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")(lambda t: t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")))
q("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))")(lambda t: t.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))", "orders"))
q("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")(lambda t: t.customer.select(c("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey")))
q("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")(lambda t: t.customer.select(c("c_custkey").alias("k")).subtract(t.orders.select("o_custkey")))
q("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")(lambda t: t.customer.select(c("c_nationkey").alias("k")).intersectAll(t.supplier.select("s_nationkey")))
q("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")(lambda t: t.customer.select(c("c_nationkey").alias("k")).exceptAll(t.supplier.select("s_nationkey")))
q("gather_inputs", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation")(
    lambda t: gather([t.customer.select(c("c_nationkey").alias("k")), t.supplier.select(c("s_nationkey").alias("k")), t.nation.select(c("n_nationkey").alias("k"))], 4)
)
q("filter_expression", "SELECT p_partkey FROM part WHERE (p_size < 10 OR p_brand = 'Brand#12') AND NOT (p_retailprice >= 1500)")(
    lambda t: t.part.where(
        filter_column(
            {
                "operator": "and",
                "arguments": [
                    {"operator": "or", "arguments": [{"comparator": "lt", "attribute": "p_size", "value": 10, "value_type": "INT"}, {"comparator": "eq", "attribute": "p_brand", "value": "Brand#12", "value_type": "STRING"}]},
                    {"operator": "not", "arguments": [{"comparator": "ge", "attribute": "p_retailprice", "value": 1500, "value_type": "DOUBLE"}]},
                ],
            }
        )
    ).select("p_partkey")
)
q("stream_tumbling", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")(
    lambda t: windows.drain(windows.tumbling(windows.stream(t.spark, f"{t.directory}/events.parquet"), "ts", "1 hour", ["event_type"])).select(c("window_start").cast("string").alias("window_start"), "event_type", "n")
)
q("stream_sliding", "WITH e AS (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM e GROUP BY ALL")(
    lambda t: windows.drain(windows.tumbling(windows.stream(t.spark, f"{t.directory}/events.parquet"), "ts", "2 hours", ["event_type"], slide="1 hour")).select(c("window_start").cast("string").alias("window_start"), "event_type", "n")
)
q("stream_session", "WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), i AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM i GROUP BY user_id, k")(
    lambda t: windows.drain(windows.sessions(windows.stream(t.spark, f"{t.directory}/events.parquet"), "ts", "30 minutes", "user_id")).select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")
)
q("stream_dedup", "SELECT count(DISTINCT event_id) AS n FROM events")(lambda t: windows.drain(windows.distinct(windows.stream(t.spark, f"{t.directory}/events.parquet"), "ts", ["event_id"]), "append").agg(F.count("*").alias("n")))
