"""DDL, DML, SHOW, SET, files and hints as SQL text."""

import uuid

import pytest
from compare import SF

from tidewater.operators.filters import filter_column
from tidewater.operators.relational import copy_to
from tidewater.plans.dialect import Dialect
from tidewater.sources.tables import register, table


@pytest.fixture(scope="module")
def d(spark, tmp_path_factory):
    register(spark, SF)
    name = f"db_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path_factory.mktemp('warehouse')}'")
    spark.sql(f"USE {name}")
    yield Dialect(spark)
    spark.sql("USE default")
    spark.sql(f"DROP DATABASE {name} CASCADE")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_table_life(d):
    d.sql("CREATE TABLE pet (id INT NOT NULL, name VARCHAR(20) DEFAULT 'none', age INT, PRIMARY KEY (id))")
    assert d.sql("INSERT INTO pet VALUES (1, 'a', 3), (2, 'b', NULL)").first().affected == 2
    assert d.sql("INSERT INTO pet (id, age) VALUES (3, 9)").first().affected == 1
    with pytest.raises(ValueError, match="Duplicate"):
        d.sql("INSERT INTO pet VALUES (1, 'x', 0)")
    assert d.sql("INSERT IGNORE INTO pet VALUES (1, 'x', 0), (4, 'd', 1)").first().affected == 1
    with pytest.raises(Exception, match="cannot be null"):
        d.sql("INSERT INTO pet (name) VALUES ('x')")
    assert d.sql("UPDATE pet SET age = age + 1, name = concat(name, '!') WHERE id < 3").first().affected == 2
    assert d.sql("DELETE FROM pet WHERE age < 3").first().affected == 1
    assert d.sql("SELECT * FROM pet WHERE age IS NULL").first().name == "b!"
    assert rows(d.sql("SELECT id, name, age FROM pet WHERE id <> 2")) == [(1, "a!", 4), (3, "none", 9)]
    assert [r.column_name for r in d.sql("SHOW INDEX FROM pet").collect()] == ["id"]
    assert [r.field for r in d.sql("DESC pet").collect()] == ["id", "name", "age"]
    assert d.sql("SELECT column_name FROM information_schema.statistics WHERE table_name = 'pet'").first().column_name == "id"
    assert "pet" in d.sql("SHOW CREATE TABLE pet").first().create_table
    d.sql("ALTER TABLE pet ADD COLUMN kind VARCHAR(5)")
    d.sql("ALTER TABLE pet DROP COLUMN age")
    assert d.sql("SELECT * FROM pet").columns == ["id", "name", "kind"]
    with pytest.raises(ValueError, match="key"):
        d.sql("UPDATE pet SET id = 9")
    d.sql("TRUNCATE TABLE pet")
    assert d.sql("SELECT * FROM pet").count() == 0
    d.sql("DROP TABLE pet")
    assert d.sql("SHOW TABLES LIKE 'pe%'").count() == 0


def test_numbered_rows(d):
    d.sql("CREATE TABLE seq (id BIGINT AUTO_INCREMENT, v INT, PRIMARY KEY (id))")
    d.sql("INSERT INTO seq (v) VALUES (10), (20)")
    d.sql("INSERT INTO seq (v) SELECT n_nationkey FROM nation")
    assert sorted(r.id for r in d.sql("SELECT id FROM seq").collect()) == list(range(1, 28))


def test_files(d, tmp_path):
    d.sql(f"SELECT n_nationkey, n_name INTO OUTFILE '{tmp_path}/out' FIELDS TERMINATED BY ',' ENCLOSED BY '\"' LINES TERMINATED BY '\\n' FROM nation")
    d.sql("CREATE TABLE n2 (k INT, name VARCHAR(25), PRIMARY KEY (k))")
    n = d.sql(f"LOAD DATA INFILE '{tmp_path}/out' INTO TABLE n2 FIELDS TERMINATED BY ',' ENCLOSED BY '\"' LINES TERMINATED BY '\\n'").first().affected
    assert n == 25 and rows(d.sql("SELECT * FROM n2")) == rows(d.sql("SELECT n_nationkey, n_name FROM nation"))


def test_variables(d):
    d.sql("SET @a = 3, @b = 'it''s'")
    assert tuple(d.sql("SELECT @a + 1 AS x, @b AS y, @none AS z").first()) == (4, "it's", None)
    d.sql("SET SESSION wait_timeout = 5")
    assert tuple(d.sql("SELECT @@wait_timeout AS w, @@session.autocommit AS c, VERSION() AS v").first()) == (5, 1, "5.7.41-tidewater")
    assert d.sql("SHOW VARIABLES LIKE 'wait%'").first().value == "5"


def test_null_is_highest(d):
    text = "SELECT v FROM (VALUES (1), (NULL), (2)) t(v) ORDER BY v"
    assert [r.v for r in d.sql(text).collect()] == [1, 2, None]
    assert [r.v for r in d.sql(text + " DESC LIMIT 2").collect()] == [None, 2]
    assert [r.r for r in d.sql("SELECT row_number() OVER (ORDER BY v DESC) AS r, v FROM (VALUES (1), (NULL)) t(v) ORDER BY v").collect()] == [2, 1]
    assert d.sql("SELECT MOD(4, 0) AS v").first().v is None


def test_views_and_plans(d):
    d.sql("CREATE OR REPLACE VIEW small AS SELECT * FROM nation WHERE n_nationkey < 4")
    assert d.sql("SELECT count(*) AS n FROM small").first().n == 4
    d.sql("DROP VIEW small")
    assert "Scan" in d.sql("EXPLAIN SELECT n_name FROM nation").first().plan
    facts = {r.column_name: r for r in d.sql("ANALYZE TABLE nation").collect()}
    assert facts["n_nationkey"].n == 25 and facts["n_nationkey"].least == "0"


def test_search_before_and_after(d):
    q = "ARRAY[" + ", ".join(["0.1"] * 64) + "]"
    found = "vec_id FROM VECTOR(embeddings, embedding, " + q + ", 5) v WHERE v.vec_id >= 100"
    assert d.sql(f"SELECT /*+ vector_pre */ {found}").count() == 5
    assert d.sql(f"SELECT {found}").count() <= 5
    assert d.sql("SELECT /*+ text_search_pre */ doc_id FROM TEXT_SEARCH(documents, text, 'the', 3) WHERE doc_id >= 10").count() <= 3


def test_filter_expressions(spark):
    leaf = lambda c, a, v, k: {"comparator": c, "attribute": a, "value": v, "value_type": k}
    tree = {"operator": "and", "arguments": [leaf("ge", "n_nationkey", 3, "INT"), {"operator": "not", "arguments": [leaf("EQ", "n_regionkey", 1, "LONG")]}]}
    n = table(spark, SF, "nation")
    assert rows(n.where(filter_column(tree)).select("n_nationkey")) == rows(n.where("n_nationkey >= 3 AND n_regionkey <> 1").select("n_nationkey"))
    with pytest.raises(ValueError):
        filter_column({"operator": "xor", "arguments": []})


def test_copies(spark, tmp_path):
    a, b = copy_to(table(spark, SF, "nation"), [f"{tmp_path}/a", f"{tmp_path}/b"])
    assert rows(a) == rows(b) == rows(table(spark, SF, "nation"))
