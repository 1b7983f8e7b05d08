"""Streams over several files: each file is a trigger of its own."""

import pytest
from pyspark.sql import functions as F

from tidewater.operators.text import text_search
from tidewater.streaming import windows

ROWS = [[("a", "2024-01-01 00:00:00", 1.0), ("b", "2024-01-01 00:10:00", 2.0)], [("a", "2024-01-01 09:00:00", 4.0)], [("a", "2024-01-02 09:00:00", 8.0), ("c", "2024-01-02 09:30:00", None)]]


@pytest.fixture()
def folder(spark, tmp_path):
    path = f"{tmp_path}/events"
    for rows in ROWS:
        spark.createDataFrame(rows, "key string, at string, amount double").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(path)
    return path


def test_exact_dedup_over_triggers(spark, folder):
    got = windows.drain(windows.distinct(windows.stream(spark, folder), "at", ["key"]), "append")
    assert sorted(r.key for r in got.collect()) == ["a", "b", "c"]


def test_dedup_within_watermark_keeps_every_key(spark, folder):
    got = windows.drain(windows.distinct(windows.stream(spark, folder), "at", ["key"], "1 hour"), "append")
    assert {r.key for r in got.collect()} == {"a", "b", "c"}
    assert 3 <= got.count() <= 5


def test_complete_result_is_that_of_the_last_trigger(spark, folder):
    got = windows.drain(windows.tumbling(windows.stream(spark, folder), "at", "1 day", ["key"], late="3 days", value="amount"))
    assert sorted((r.key, r.n, r.total) for r in got.collect()) == [("a", 1, 8.0), ("a", 2, 5.0), ("b", 1, 2.0), ("c", 1, None)]


def test_drain_of_no_rows(spark, tmp_path):
    path = f"{tmp_path}/none"
    spark.createDataFrame([], "key string, at timestamp, amount double").coalesce(1).write.parquet(path)
    assert windows.drain(windows.distinct(windows.stream(spark, path), "at", ["key"]), "append").count() == 0


def test_bm25_beside_columns_of_its_own_names(spark):
    rows = [(1, "red fish", 1, 2), (2, "blue fish, red fish", 3, 4), (3, None, 5, 6), (4, "", 7, 8), (5, "redder", 9, 10)]
    docs = spark.createDataFrame(rows, "id int, text string, _n int, _f0 int")
    plain = text_search(docs.select("id", "text"), "id", "red fish", 10).collect()
    got = text_search(docs, "id", "red fish", 10).collect()
    assert [(r.id, r.rank_bm25) for r in got] == [(r.id, r.rank_bm25) for r in plain]
    assert sorted((r.id, r._n, r._f0) for r in got) == [(1, 1, 2), (2, 3, 4)]
