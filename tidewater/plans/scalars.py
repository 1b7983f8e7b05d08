"""Scalar functions over columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import collection, numeric, strings, system, temporal
from .registry import Registry

q = Registry()
c = F.col

q("math_arithmetic", "SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS a, l_quantity - l_tax AS s, l_quantity * 2 AS m, -l_quantity AS n, l_linenumber // 2 AS d, l_extendedprice / l_quantity AS r FROM lineitem")(
    lambda t: t.lineitem.select("l_orderkey", "l_linenumber", (c("l_quantity") + c("l_tax")).alias("a"), (c("l_quantity") - c("l_tax")).alias("s"), (c("l_quantity") * 2).alias("m"), (-c("l_quantity")).alias("n"), numeric.int_div(c("l_linenumber"), F.lit(2)).cast("int").alias("d"), (c("l_extendedprice") / c("l_quantity")).alias("r"))
)
q("math_abs_ceil_floor", "SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f FROM customer")(lambda t: t.customer.select("c_custkey", F.abs("c_acctbal").alias("a"), numeric.keep_ceil(c("c_acctbal")).alias("c"), numeric.keep_floor(c("c_acctbal")).alias("f")))
q("math_round", "SELECT c_custkey, round(c_acctbal, 1) + 0.0 AS r1, round(c_acctbal, 0) + 0.0 AS r0, round(c_acctbal, -2) + 0.0 AS r2 FROM customer")(lambda t: t.customer.select("c_custkey", (F.round("c_acctbal", 1) + 0.0).alias("r1"), (F.round("c_acctbal", 0) + 0.0).alias("r0"), (F.round("c_acctbal", -2) + 0.0).alias("r2")))
q("math_mod_zero", "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_size % (p_size % 3) END AS m, CASE WHEN p_size <> 0 THEN -7 % p_size END AS n FROM part")(lambda t: t.part.select("p_partkey", numeric.mod(c("p_size"), c("p_size") % 3).alias("m"), numeric.mod(F.lit(-7), c("p_size")).alias("n")))
q("math_pow", "SELECT p_partkey, pow(p_size, 2) AS p, CAST(p_size * p_size * p_size AS BIGINT) AS e FROM part")(lambda t: t.part.select("p_partkey", F.pow("p_size", F.lit(2)).alias("p"), numeric.exact_power(c("p_size"), 3).cast("long").alias("e")))
q("math_trig", "SELECT p_partkey, round(sin(p_size), 9) AS s, round(cos(p_size), 9) AS c, round(tan(p_size), 6) AS t, round(asin(p_size / 100.0), 9) AS asn, round(acos(p_size / 100.0), 9) AS acs, round(atan(p_size), 9) AS atn FROM part")(
    lambda t: t.part.select("p_partkey", F.round(F.sin("p_size"), 9).alias("s"), F.round(F.cos("p_size"), 9).alias("c"), F.round(F.tan("p_size"), 6).alias("t"), F.round(F.asin(c("p_size") / 100.0), 9).alias("asn"), F.round(F.acos(c("p_size") / 100.0), 9).alias("acs"), F.round(F.atan("p_size"), 9).alias("atn"))
)
q("math_hyperbolic_log", "SELECT p_partkey, round(sinh(p_size / 50.0), 9) AS s, round(cosh(p_size / 50.0), 9) AS c, round(tanh(p_size / 50.0), 9) AS t, round(ln(p_retailprice), 9) AS l, round(exp(p_size / 50.0), 9) AS e, round(2 * pi(), 9) AS tau, round(exp(1.0), 9) AS ee FROM part")(
    lambda t: t.part.select("p_partkey", F.round(F.sinh(c("p_size") / 50.0), 9).alias("s"), F.round(F.cosh(c("p_size") / 50.0), 9).alias("c"), F.round(F.tanh(c("p_size") / 50.0), 9).alias("t"), F.round(F.ln("p_retailprice"), 9).alias("l"), F.round(F.exp(c("p_size") / 50.0), 9).alias("e"), F.round(numeric.tau(), 9).alias("tau"), F.round(F.e(), 9).alias("ee"))
)
q("math_least_greatest", "SELECT p_partkey, least(p_size, 20) AS lo, greatest(p_size, 20) AS hi FROM part")(lambda t: t.part.select("p_partkey", F.least(c("p_size"), F.lit(20)).alias("lo"), F.greatest(c("p_size"), F.lit(20)).alias("hi")))
q("format_number_plain", "SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(18,1)) AS VARCHAR) AS f1, CAST(CAST(p_size * 1000 AS DECIMAL(18,2)) AS VARCHAR) AS f2 FROM part")(lambda t: t.part.select("p_partkey", numeric.format_plain(c("p_retailprice"), 1).alias("f1"), numeric.format_plain(c("p_size") * 1000, 2).alias("f2")))
q("cast_round_half_up", "SELECT l_orderkey, l_linenumber, CAST(round(l_quantity / 2) AS INT) AS r, CAST(l_quantity AS VARCHAR) AS s, CAST(l_linenumber AS DOUBLE) AS d, CAST(CAST(l_linenumber AS VARCHAR) AS BIGINT) AS b FROM lineitem")(
    lambda t: t.lineitem.select("l_orderkey", "l_linenumber", numeric.to_int(c("l_quantity") / 2).alias("r"), c("l_quantity").cast("string").alias("s"), c("l_linenumber").cast("double").alias("d"), c("l_linenumber").cast("string").cast("long").alias("b"))
)
q("cast_kinds", "SELECT o_orderkey, o_custkey % 3 <> 0 AS b, CAST(o_totalprice AS DECIMAL(18,1)) AS d, CAST(o_orderdate AS VARCHAR)[:10] AS s, strftime(CAST(CAST(o_orderdate AS VARCHAR)[:10] AS DATE), '%Y%m%d') AS day, octet_length(encode(o_orderpriority)) AS n FROM orders")(
    lambda t: t.orders.select("o_orderkey", (c("o_custkey") % 3).cast("boolean").alias("b"), c("o_totalprice").cast("decimal(18,1)").alias("d"), F.substring(c("o_orderdate").cast("string"), 1, 10).alias("s"), F.date_format(F.substring(c("o_orderdate").cast("string"), 1, 10).cast("date"), "yyyyMMdd").alias("day"), F.octet_length(c("o_orderpriority").cast("binary")).cast("long").alias("n"))
)
q("str_concat", "SELECT n_nationkey, n_name || n_nationkey AS a, concat(n_name, '!') AS b, CASE WHEN n_nationkey > 5 THEN n_name || '-' || n_regionkey END AS c FROM nation")(
    lambda t: t.nation.select("n_nationkey", strings.concat(c("n_name"), c("n_nationkey")).alias("a"), strings.concat(c("n_name"), F.lit("!")).alias("b"), strings.concat(strings.concat(c("n_name"), F.lit("-")), F.when(c("n_nationkey") > 5, c("n_regionkey"))).alias("c"))
)
q("str_left_right", "SELECT p_partkey, left(p_name, 4) AS l, right(p_name, 3) AS r, '' AS none FROM part")(lambda t: t.part.select("p_partkey", strings.left(c("p_name"), 4).alias("l"), strings.right(c("p_name"), 2.5).alias("r"), strings.left(c("p_name"), -1).alias("none")))
q("str_mid", "SELECT p_partkey, substr(p_name, 3, 2) AS a, substr(p_name, -3, 2) AS b, substr(p_name, 2) AS c, '' AS d FROM part")(lambda t: t.part.select("p_partkey", strings.mid(c("p_name"), 2.5, 1.5).alias("a"), strings.mid(c("p_name"), -3, 2).alias("b"), strings.mid(c("p_name"), 2).alias("c"), strings.mid(c("p_name"), 1, -2).alias("d")))
q("str_locate_instr", "SELECT p_partkey, instr(p_type, 'E') AS l, instr(p_type, 'EE') AS i, 1 AS e FROM part")(lambda t: t.part.select("p_partkey", strings.locate("E", c("p_type")).alias("l"), strings.instr(c("p_type"), "EE").alias("i"), strings.locate("", c("p_type")).alias("e")))
q("str_trim_family", "SELECT n_nationkey, ltrim('  ' || n_name) AS l, rtrim(n_name || '  ') AS r, regexp_replace('123123' || n_name || '123', '^(123)+|(123)+$', '', 'g') AS b, regexp_replace('xyxy' || n_name, '^(xy)+', '') AS le, regexp_replace(n_name || 'ab', '(ab)+$', '') AS tr FROM nation")(
    lambda t: t.nation.select("n_nationkey", F.ltrim(F.concat(F.lit("  "), c("n_name"))).alias("l"), F.rtrim(F.concat(c("n_name"), F.lit("  "))).alias("r"), strings.trim(F.concat(F.lit("123123"), c("n_name"), F.lit("123")), "123").alias("b"), strings.trim(F.concat(F.lit("xyxy"), c("n_name")), "xy", "leading").alias("le"), strings.trim(F.concat(c("n_name"), F.lit("ab")), "ab", "trailing").alias("tr"))
)
q("str_repeat_reverse", "SELECT n_nationkey, repeat(n_name, 2) AS r, reverse(n_name) AS v FROM nation")(lambda t: t.nation.select("n_nationkey", strings.repeat(c("n_name"), 2.1).alias("r"), F.reverse("n_name").alias("v")))
q("str_replace", "SELECT n_nationkey, replace(n_name, 'A', 'aa') AS r FROM nation")(lambda t: t.nation.select("n_nationkey", strings.replace(c("n_name"), "A", "aa").alias("r")))
q("str_case", "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, length(p_name) AS n FROM part")(lambda t: t.part.select("p_partkey", F.upper("p_name").alias("u"), F.lower("p_type").alias("l"), F.char_length("p_name").alias("n")))
q("str_starts_ends_contains", "SELECT p_partkey, starts_with(p_type, 'S') AS s, ends_with(p_type, 'S') AS e, contains(p_type, 'EE') AS c, regexp_matches(p_type, '^[A-M]') AS m FROM part")(
    lambda t: t.part.select("p_partkey", c("p_type").startswith("S").alias("s"), c("p_type").endswith("S").alias("e"), c("p_type").contains("EE").alias("c"), c("p_type").rlike("^[A-M]").alias("m"))
)
q("date_format_my", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS d, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS f, strftime(o_orderdate, '%Y') || 'A' AS u FROM orders")(
    lambda t: t.orders.select("o_orderkey", temporal.date_format(c("o_orderdate"), "%Y/%m/%d").alias("d"), temporal.date_format(c("o_orderdate"), "%Y-%m-%d %T").alias("f"), temporal.date_format(c("o_orderdate"), "%Y%A").alias("u"))
)
q("time_format_my", "SELECT event_id, strftime(ts, '%H-%M-%S') AS a, strftime(ts, '%H:%M:%S') AS b FROM events")(lambda t: t.events.select("event_id", temporal.time_format(F.date_format("ts", "HHmmss"), "%H-%i-%s").alias("a"), temporal.time_format(F.date_format("ts", "H:m:s"), "%T").alias("b")))
q("timestamp_format_my", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS f FROM events")(lambda t: t.events.select("event_id", temporal.timestamp_format(F.unix_timestamp(c("ts").cast("timestamp")), seconds=True).alias("f")))
q("unix_time_roundtrip", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS u, strftime(ts, '%Y-%m-%d %H:%M:%S') AS back FROM events")(
    lambda t: t.events.select("event_id", temporal.unix_timestamp(c("ts").cast("timestamp")).alias("u"), F.date_format(temporal.from_unixtime(temporal.unix_timestamp(c("ts").cast("timestamp"))), "yyyy-MM-dd HH:mm:ss").alias("back"))
)
q("datediff", "SELECT o_orderkey, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders")(lambda t: t.orders.select("o_orderkey", temporal.datediff(c("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).alias("d")))
q("date_parse_lenient", "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS a, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS b, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS c FROM orders")(
    lambda t: t.orders.select("o_orderkey", *[temporal.parse_date(F.date_format("o_orderdate", p)).cast("string").alias(n) for n, p in (("a", "yyyy/M/d"), ("b", "yyyyMMdd"), ("c", "yyyy.M.d"))])
)
q("array_item", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[64] AS DOUBLE) AS b, CAST(embedding[1000] AS DOUBLE) AS c FROM embeddings")(lambda t: t.embeddings.select("vec_id", *[collection.item(c("embedding"), i).cast("double").alias(n) for n, i in (("a", 1), ("b", 64), ("c", 1000))]))
q("array_constructor", "SELECT n_nationkey, array_to_string([n_nationkey, n_regionkey], ',') AS a FROM nation")(lambda t: t.nation.select("n_nationkey", F.array_join(F.array("n_nationkey", "n_regionkey").cast("array<string>"), ",").alias("a")))
q("multiset_slice", "SELECT n_nationkey, array_to_string([n_name, lower(n_name)], ',') AS a FROM nation")(lambda t: t.nation.select("n_nationkey", F.array_join(collection.slice_first(F.array(F.struct("n_name"), F.struct(F.lower("n_name").alias("n_name"))), "n_name"), ",").alias("a")))
q("map_item", "SELECT n_nationkey, n_name AS a, NULL::VARCHAR AS b FROM nation")(lambda t: t.nation.select("n_nationkey", collection.entry(F.create_map(F.lit("name"), c("n_name")), "name").alias("a"), collection.entry(F.create_map(F.lit("name"), c("n_name")), "other").alias("b")))
q("json_extract", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")(lambda t: t.events.select("event_id", collection.json_extract(c("props"), "$.k").alias("k")))
q("system_functions", "SELECT r_regionkey, '5.7.41-tidewater' AS v, 'default' AS d, 1 AS autocommit, 28800 AS wait_timeout, 0 AS case_sensitive, NULL::VARCHAR AS unknown FROM region")(
    lambda t: t.region.select("r_regionkey", system.version().alias("v"), system.database().alias("d"), system.variable(t.spark, "autocommit").cast("int").alias("autocommit"), system.variable(t.spark, "session.wait_timeout").cast("int").alias("wait_timeout"), system.variable(t.spark, "spark.sql.caseSensitive").cast("int").alias("case_sensitive"), system.variable(t.spark, "no.such.name").cast("string").alias("unknown"))
)
