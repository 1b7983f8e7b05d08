"""SQL text of the dialect."""

import pytest
from compare import SF

from tidewater.plans.dialect import Dialect
from tidewater.sources.tables import register, table
from tidewater.operators import vector


@pytest.fixture(scope="module")
def d(spark):
    register(spark, SF)
    return Dialect(spark, {"embeddings.embedding": "COSINE"})


CASES = [
    ("SELECT 'AbC' LIKE 'a%' AS v", True),
    ("SELECT 'AbC' LIKE BINARY 'a%' AS v", False),
    ("SELECT 'AbC' LIKE '[a-b]b_' AS v", True),
    ("SELECT 'LIKE [x] <-> y' AS v", "LIKE [x] <-> y"),
    ("SELECT ARRAY[1.0, 2.0] <-> ARRAY[2.0, 4.0] AS v", 5.0),
    ("SELECT ARRAY[1.0, 2.0] <*> ARRAY[2.0, 4.0] AS v", -9.0),
    ("SELECT round(ARRAY[1.0, 0.0] <=> ARRAY[0.0, 3.0], 6) AS v", 1.0),
    ("SELECT ARRAY[7, 8, 9][2] AS v", 8),
    ("SELECT CAST(4.5 AS INT) AS v", 5),
    ("SELECT CAST('12' AS BIGINT) AS v", 12),
    ("SELECT MID('ABCDEFG', -5, 3) AS v", "CDE"),
    ("SELECT UCASE('abc') AS v", "ABC"),
    ("SELECT DATE_FORMAT(DATE '2022-07-02', '%Y/%m/%d') AS v", "2022/07/02"),
    ("SELECT POW(2, 3) AS v", 8.0),
    ("SELECT n_nationkey AS v FROM SCAN(nation) ORDER BY n_nationkey LIMIT 3, 1", 3),
]


@pytest.mark.parametrize("text, value", CASES)
def test_value(d, text, value):
    assert d.sql(text).first().v == value


def test_prepared(d):
    d.sql("PREPARE q FROM 'SELECT count(*) AS n FROM nation WHERE n_nationkey < ?'")
    assert d.sql("EXECUTE q USING 5").first().n == 5


def test_vector_table(d, spark):
    q = [0.1] * 64
    got = d.sql(f"SELECT vec_id FROM VECTOR(embeddings, embedding, ARRAY[{', '.join(map(str, q))}], 5) v")
    want = vector.vector_search(table(spark, SF, "embeddings"), "embedding", q, 5, "COSINE")
    assert [r.vec_id for r in got.collect()] == [r.vec_id for r in want.collect()]


def test_text_and_hybrid_tables(d):
    q = ", ".join(["0.1"] * 64)
    t = "TEXT_SEARCH(documents, text, 'license', 5)"
    assert d.sql(f"SELECT doc_id FROM {t}").count() <= 5
    assert d.sql(f"SELECT id, rank_hybrid FROM HYBRID_SEARCH({t}, VECTOR(embeddings, embedding, ARRAY[{q}], 5), 0.3, 0.7) ORDER BY rank_hybrid DESC").count() >= 5
