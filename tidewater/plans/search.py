"""Vector, text and hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vector
from ..operators.hybrid import hybrid_search
from ..operators.text import text_search
from ..session import ship
from .registry import Registry

q = Registry()
c = F.col
#: The query vector of most queries here: 64 values from a rule.
QUERY = [((i * 37) % 64 - 32) / 64.0 for i in range(64)]
V = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY) + "]"
X = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
L2 = f"list_sum(list_transform(list_zip({X}, {V}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
IP = f"1 - list_sum(list_transform(list_zip({X}, {V}), lambda z: z[1] * z[2]))"
COS = f"1 - list_sum(list_transform(list_zip({X}, {V}), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform({X}, lambda z: z * z))) * sqrt(list_sum(list_transform({V}, lambda z: z * z))))"


def at(metric: str):
    return F.round(vector.distance(c("embedding"), vector.literal(QUERY), metric), 4)


q("vec_l2", f"SELECT vec_id, round({L2}, 4) AS d FROM embeddings")(lambda t: t.embeddings.select("vec_id", at("L2").alias("d")))
q("vec_ip", f"SELECT vec_id, round({IP}, 4) AS d FROM embeddings")(lambda t: t.embeddings.select("vec_id", at("INNER_PRODUCT").alias("d")))
q("vec_cosine", f"SELECT vec_id, round({COS}, 4) AS d FROM embeddings")(lambda t: t.embeddings.select("vec_id", at("COSINE").alias("d")))
for metric, name, sql in (("L2", "l2", L2), ("INNER_PRODUCT", "ip", IP), ("COSINE", "cosine", COS)):
    q(f"vec_topn_{name}", f"SELECT vec_id, round({sql}, 4) AS distance FROM embeddings ORDER BY {sql}, vec_id LIMIT 10")(lambda t, metric=metric: vector.vector_search(t.embeddings, "embedding", QUERY, 10, metric).select("vec_id", F.round("distance", 4).alias("distance")))
q("vec_prefilter", f"SELECT vec_id, label, round({L2}, 4) AS distance FROM embeddings WHERE label = 3 ORDER BY {L2}, vec_id LIMIT 10")(lambda t: vector.vector_search(t.embeddings, "embedding", QUERY, 10, prefilter=c("label") == 3).select("vec_id", "label", F.round("distance", 4).alias("distance")))
q("vec_postfilter", f"SELECT vec_id, label FROM (SELECT vec_id, label FROM embeddings ORDER BY {L2}, vec_id LIMIT 40) WHERE label = 3")(lambda t: vector.vector_search(t.embeddings, "embedding", QUERY, 40, postfilter=c("label") == 3).select("vec_id", "label"))
q("vec_range", f"SELECT vec_id FROM embeddings WHERE {L2} < 6.5")(lambda t: vector.within(t.embeddings, "embedding", QUERY, 6.5).select("vec_id"))
q("vec_get_by_id", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (3, 5, 8)")(lambda t: t.embeddings.where(c("vec_id").isin(3, 5, 8)).select("vec_id", "label"))
q("vec_border_id", "SELECT min(vec_id) AS min_id, max(vec_id) AS max_id, count(vec_id) AS n FROM embeddings")(lambda t: vector.border_ids(t.embeddings))
q("vec_scan_query", "SELECT vec_id, label FROM embeddings WHERE vec_id >= 100 ORDER BY vec_id LIMIT 20")(lambda t: t.embeddings.where("vec_id >= 100").orderBy("vec_id").limit(20).select("vec_id", "label"))
q("vec_delete", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (1, 2, 3)")(lambda t: t.embeddings.where(~c("vec_id").isin(1, 2, 3)).select("vec_id"))
q("vec_count", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")(lambda t: t.embeddings.groupBy("label").agg(F.count("*").alias("n")))
q("vec_join_label", f"SELECT vec_id, doc_id, lang FROM (SELECT vec_id FROM embeddings ORDER BY {L2}, vec_id LIMIT 20) JOIN documents ON vec_id = doc_id")(lambda t: vector.vector_search(t.embeddings, "embedding", QUERY, 20).join(t.documents, c("vec_id") == c("doc_id")).select("vec_id", "doc_id", "lang"))


@q("vec_batch_topk", f"WITH qs AS (SELECT vec_id AS query_id, {X} AS v FROM embeddings WHERE vec_id < 5), d AS (SELECT query_id, vec_id, round(list_sum(list_transform(list_zip({X}, v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 4) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(list_sum(list_transform(list_zip({X}, v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9), vec_id) AS rank FROM qs, embeddings) SELECT query_id, vec_id, distance, CAST(rank AS INT) AS rank FROM d WHERE rank <= 5")
def _(t):
    ship(t.spark)
    queries = [(r.vec_id, r.embedding) for r in t.embeddings.where("vec_id < 5").select("vec_id", "embedding").collect()]  # the stated queries
    return vector.batch_search(t.embeddings, "embedding", queries, 5).withColumn("distance", F.round("distance", 4) + 0.0)


@q("vec_batch_topk_whole", f"WITH qs AS (SELECT vec_id AS query_id, {X} AS v FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT query_id, vec_id, round(list_sum(list_transform(list_zip({X}, v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 4) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(list_sum(list_transform(list_zip({X}, v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9), vec_id) AS rank FROM qs, embeddings) SELECT query_id, vec_id, distance, CAST(rank AS INT) AS rank FROM d WHERE rank <= 5")
def _(t):
    ship(t.spark)
    return vector.batch_join(t.embeddings, "embedding", t.embeddings.where("vec_id % 50 = 0"), 5).withColumn("distance", F.round("distance", 4) + 0.0)


#: The parameters of the index and its search in vec_ivf_topn.
IVF, IVF_SEARCH = {"lists": 8}, {"n": 10, "probes": 6}


@q("vec_ivf_topn")
def _(t):
    ship(t.spark)
    return vector.IvfIndex(t.embeddings, "embedding", **IVF).search(QUERY, **IVF_SEARCH).select("vec_id", F.round("distance", 4).alias("distance"))


q("vec_txt2vec")(lambda t: t.documents.select("doc_id", vector.hash_embedding(c("text"), 8).alias("embedding")))

TOK = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


def bm25_sql(terms: list[str], where: str = "true") -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{x}')) AS f{i}" for i, x in enumerate(terms))
    df = ", ".join(f"sum((f{i} > 0)::INT) AS d{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * l / a))" for i in range(len(terms)))
    some = " + ".join(f"f{i}" for i in range(len(terms)))
    return f"(WITH w AS (SELECT doc_id, {TOK} AS w FROM documents WHERE {where}), f AS (SELECT doc_id, len(w) AS l, {tf} FROM w), s AS (SELECT count(*) AS n, avg(l) AS a, {df} FROM f) SELECT doc_id, CAST({score} AS DOUBLE) AS r FROM f, s WHERE {some} > 0)"


def ranked(t, query: str, n: int, **options):
    return text_search(t.documents, "doc_id", query, n, **options)


q("text_bm25_topn", f"SELECT doc_id, round(r, 6) AS rank FROM {bm25_sql(['license', 'released'])} ORDER BY r DESC, doc_id LIMIT 10")(lambda t: ranked(t, "License released", 10).select("doc_id", F.round("rank_bm25", 6).alias("rank")))
q("text_field_query", f"SELECT doc_id, round(r, 6) AS rank FROM {bm25_sql(['reserved'])} ORDER BY r DESC, doc_id LIMIT 10")(lambda t: ranked(t, "TEXT:reserved", 10).select("doc_id", F.round("rank_bm25", 6).alias("rank")))
q("text_prefilter", f"SELECT doc_id, round(r, 6) AS rank FROM {bm25_sql(['license'], 'doc_id < 500')} ORDER BY r DESC, doc_id LIMIT 10")(lambda t: ranked(t, "license", 10, prefilter=c("doc_id") < 500).select("doc_id", F.round("rank_bm25", 6).alias("rank")))
q("text_postfilter", f"SELECT doc_id FROM (SELECT doc_id FROM {bm25_sql(['license'])} ORDER BY r DESC, doc_id LIMIT 10) WHERE doc_id < 500")(lambda t: ranked(t, "license", 10, postfilter=c("doc_id") < 500).select("doc_id"))
q("text_join", f"SELECT doc_id, quality FROM (SELECT doc_id FROM {bm25_sql(['rights'])} ORDER BY r DESC, doc_id LIMIT 30) JOIN labels USING (doc_id)")(lambda t: ranked(t, "rights", 30).join(t.labels, "doc_id").select("doc_id", "quality"))


def hybrid_sql(vw: float, tw: float) -> str:
    return f"""WITH v0 AS (SELECT vec_id AS id, {L2} AS d FROM embeddings ORDER BY d, vec_id LIMIT 20), v AS (SELECT id, CASE WHEN max(d) OVER () = min(d) OVER () THEN 0 ELSE (d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()) END AS v FROM v0),
t AS (SELECT doc_id AS id, r AS t FROM {bm25_sql(['license'])} ORDER BY r DESC, doc_id LIMIT 20)
SELECT id, round(coalesce(v, 0) * {vw} + coalesce(t, 0) * {tw}, 5) AS rank_hybrid FROM v FULL JOIN t USING (id)"""


def hybrid(t, **weights):
    found = hybrid_search(vector.vector_search(t.embeddings, "embedding", QUERY, 20), ranked(t, "license", 20), **weights)
    return found.select("id", F.round("rank_hybrid", 5).alias("rank_hybrid"))


q("hybrid_default", hybrid_sql(0.5, 0.5))(lambda t: hybrid(t))
q("hybrid_weighted", hybrid_sql(0.8, 0.2))(lambda t: hybrid(t, vector_weight=0.8, text_weight=0.2))
