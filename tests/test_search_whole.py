"""Searches over every row whose id is divisible by 50."""

import pytest
from compare import duck, same

from tidewater.operators import vector
from tidewater.plans import search
from tidewater.sources.tables import table

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("index, options", [(search.IVF, search.IVF_SEARCH), ({}, {"n": 10})])
def test_ivf_recall_as_registered_and_by_default(spark, index, options):
    e = table(spark, SMALL, "embeddings")
    made = vector.IvfIndex(e, "embedding", **index)
    hits = total = 0
    for r in e.where("vec_id % 50 = 0").collect():
        exact = {x.vec_id for x in vector.vector_search(e, "embedding", r.embedding, options["n"]).collect()}
        found = {x.vec_id for x in made.search(r.embedding, **options).collect()}
        hits, total = hits + len(exact & found), total + len(exact)
    assert hits / total >= 0.9


def test_batch_search_has_every_query(spark):
    import __spark_entry__ as entry

    same(entry.queries()["vec_batch_topk_whole"](spark, SMALL), duck(SMALL).sql(entry.oracle_sql()["vec_batch_topk_whole"]))
    e = table(spark, SMALL, "embeddings")
    whole = vector.batch_join(e, "embedding", e.where("vec_id % 50 = 0"), 5, block=7).collect()
    assert {r.query_id for r in whole} == {r.vec_id for r in e.where("vec_id % 50 = 0").collect()}
    for q in e.where("vec_id % 50 = 0").limit(3).collect():
        exact = [r.vec_id for r in vector.vector_search(e, "embedding", q.embedding, 5).collect()]
        assert [r.vec_id for r in sorted(whole, key=lambda r: r["rank"]) if r.query_id == q.vec_id] == exact
