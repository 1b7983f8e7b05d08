"""Operators beyond what SQL compares: errors, indexes, files, streams, plans."""

import numpy as np
import pytest
from compare import SF
from pyspark.sql import functions as F

from tidewater.operators import dml, hybrid, relational, sizes, statistics, text, vector
from tidewater.sources import catalog, delimited, messages
from tidewater.sources.tables import table


def plan(df):
    return catalog.explain(df)


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(table(spark, SF, "lineitem").where("l_quantity > 49").select("l_orderkey"))
    assert "GreaterThan(l_quantity,49.0)" in p and "l_comment" not in p
    assert "struct<l_orderkey:bigint,l_quantity:double>" in p


def test_prefix_like_is_pushed(spark):
    from tidewater.functions.strings import like_binary

    assert "StringStartsWith(p_type,ST)" in plan(table(spark, SF, "part").where(like_binary(F.col("p_type"), "ST%")))


def test_insert_error_mode(spark):
    a = relational.values(spark, [(1, "x")], "k int, v string")
    with pytest.raises(dml.DuplicateKey):
        dml.insert(a, a, ["k"], "error")
    b = relational.values(spark, [(2, "y"), (2, "z")], "k int, v string")
    with pytest.raises(dml.DuplicateKey):
        dml.insert(a, b, ["k"], "error")
    assert dml.insert(a, b, ["k"]).count() == 2


def test_update_counts_changes_only(spark):
    a = relational.values(spark, [(1, "x"), (2, None), (3, "y")], "k int, v string")
    assert dml.updated(a, F.lit(True), {"v": F.lit("x")}).first()[0] == 2
    assert dml.updated(a, F.col("k") > 9, {"v": F.lit("x")}).first()[0] == 0


def test_all_and_any_with_nulls(spark):
    a = relational.values(spark, [(1,), (5,)], "x int")
    none, some = relational.values(spark, [], "y int"), relational.values(spark, [(2,), (None,)], "y int")
    assert relational.all_rows(a, F.col("x"), ">", none, "y").count() == 2
    assert relational.all_rows(a, F.col("x"), ">", some, "y").count() == 0
    assert relational.any_row(a, F.col("x"), ">", some, "y").count() == 1
    assert relational.any_row(a, F.col("x"), ">", none, "y").count() == 0


def test_broadcast_is_checked(spark):
    small = spark.range(3)
    assert "BroadcastHashJoin" in plan(spark.range(10).join(sizes.broadcast_if_small(small), "id"))
    assert sizes.broadcast_if_small(small, limit=1) is small


def test_distance_of_unlike_dimensions(spark):
    r = spark.range(1).select(vector.l2(vector.literal([1, 2]), vector.literal([1])).alias("d")).first()
    assert r.d is None


def test_ivf_recall(spark):
    e = table(spark, SF.replace("0.001", "0.01"), "embeddings")
    index = vector.IvfIndex(e, "embedding", lists=8)
    rows = e.where("vec_id % 50 = 0").collect()
    hits = total = 0
    for r in rows:
        exact = {x.vec_id for x in vector.vector_search(e, "embedding", r.embedding, 10).collect()}
        found = {x.vec_id for x in index.search(r.embedding, 10, probes=6).collect()}
        hits, total = hits + len(exact & found), total + len(exact)
    assert hits / total >= 0.9


def test_batch_search_agrees(spark):
    e = table(spark, SF, "embeddings")
    queries = [(r.vec_id, r.embedding) for r in e.limit(3).collect()]
    got = vector.batch_search(e, "embedding", queries, 5, "COSINE").collect()
    for i, v in queries:
        exact = [r.vec_id for r in vector.vector_search(e, "embedding", v, 5, "COSINE").collect()]
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == i] == exact


def test_tokenizers(spark):
    t = lambda kind: spark.range(1).select(text.tokens(F.lit("Two Cats, 3"), kind).alias("t")).first().t
    assert t("default") == ["two", "cats", "3"]
    assert t("stem") == ["two", "cat", "3"]
    assert t("whitespace") == ["Two", "Cats,", "3"]
    assert t("raw") == ["Two Cats, 3"]
    assert t("ngram")[:2] == ["two", "wo "]
    assert t("chinese")[:3] == ["t", "w", "o"]


def test_query_syntax():
    assert text.parse_query("TITLE:Apple pear", "text") == [("title", "apple"), ("text", "pear")]


def test_hybrid_all_equal_distances(spark):
    v = relational.values(spark, [(1, 2.0), (2, 2.0)], "vec_id long, distance double")
    t = relational.values(spark, [(2, 4.0)], "doc_id long, rank_bm25 double")
    assert {r.id: r.rank_hybrid for r in hybrid.hybrid_search(v, t).collect()} == {1: 0.0, 2: 2.0}


def test_export_and_load(spark, tmp_path):
    rows = [(1, "a\tb", True, b"\x01", [1, 2]), (2, None, None, None, None), (3, "c\\d", False, b"", [])]
    df = spark.createDataFrame(rows, "k int, s string, b boolean, x binary, a array<int>")
    path = str(tmp_path / "out")
    delimited.export_outfile(df, path)
    with pytest.raises(Exception):
        delimited.export_outfile(df, path)
    back = {r.k: r for r in delimited.load_data(spark, path, df.schema).collect()}
    assert back[1].s == "a\tb" and back[1].b is True and bytes(back[1].x) == b"\x01" and back[1].a == [1, 2]
    assert back[2].s is None and back[2].b is None and back[2].a is None
    assert back[3].b is False


def test_load_with_starting_and_ignored_lines(spark, tmp_path):
    p = tmp_path / "in.txt"
    p.write_text("head\nxx>>1,2022/7/2\nskipped\n>>2,\\N\n")
    from pyspark.sql.types import StructType

    got = delimited.load_data(spark, str(p), StructType.fromDDL("k int, d date"), sep=",", starting=">>", ignore=1).orderBy("k").collect()
    assert [(r.k, str(r.d)) for r in got] == [(1, "2022-07-02"), (2, "None")]


def test_json_records(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x"}',), ("broken",)], "value string")
    assert [(r.a, r.b) for r in messages.decode_json(df, "a int, b string").collect()] == [(1, "x"), (None, None)]


def test_statistics(spark):
    o = table(spark, SF, "orders")
    sketch = statistics.CountMin(o, "o_orderpriority")
    for r in o.groupBy("o_orderpriority").count().collect():
        assert r["count"] <= sketch.estimate(r.o_orderpriority) <= 1.1 * r["count"] + 2
    s = statistics.analyze(o, "o_custkey").first()
    exact = o.select("o_custkey").distinct().count()
    assert abs(s.ndv - exact) <= 0.1 * exact
    h = statistics.histogram(o, "o_totalprice", 10).toPandas()
    assert h.n.sum() == o.count() and np.all(h.bucket < 10)


def test_auto_increment_is_gapless(spark):
    ids = [r.id for r in dml.with_auto_increment(spark.range(100).withColumnRenamed("id", "x"), "id", ["x"], 7, 5).orderBy("x").collect()]
    assert ids == list(range(7, 107))


def test_auto_increment_of_many_rows(spark):
    rows = spark.range(1_200_000).select((F.col("id") % 1000).alias("k"), F.xxhash64("id").alias("x"), F.sha2(F.col("id").cast("string"), 256).alias("s"))
    for order in (["x"], ["k", "x"], ["s"]):
        r = dml.with_auto_increment(rows, "n", order).agg(F.count_distinct("n").alias("d"), F.min("n").alias("lo"), F.max("n").alias("hi")).first()
        assert (r.d, r.lo, r.hi) == (1_200_000, 1, 1_200_000)
    numbered = dml.with_auto_increment(rows, "n", ["s"], 1, 8).where("n <= 5").orderBy("n").select("s")
    assert numbered.collect() == rows.orderBy("s").select("s").limit(5).collect()


def test_empty_information_schema(spark):
    assert catalog.empty_table(spark, "TRIGGERS").count() == 0
    with pytest.raises(ValueError):
        catalog.empty_table(spark, "none such")
