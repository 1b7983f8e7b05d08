"""Hybrid ranking: a full outer join of a vector search and a text search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def min_max(df: DataFrame, column: str, name: str) -> DataFrame:
    """Scales a column to 0..1 over the rows; to 0 if all are equal."""
    facts = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled = F.when(F.col("_lo") == F.col("_hi"), F.lit(0.0)).otherwise((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return df.join(F.broadcast(facts)).withColumn(name, scaled).drop("_lo", "_hi")


def hybrid_search(vectors: DataFrame, texts: DataFrame, vector_id: str = "vec_id", text_id: str = "doc_id", distance: str = "distance", rank: str = "rank_bm25", vector_weight: float = 0.5, text_weight: float = 0.5, invert: bool = False) -> DataFrame:
    """(id, rank_hybrid), best first: the scaled distance and the text rank, weighted and added; what one side lacks counts 0.

    The distance goes in as it is, nearer being less, unless ``invert``.
    """
    v = min_max(vectors.select(F.col(vector_id).alias("id"), F.col(distance).cast("double").alias("d")), "d", "v")
    v = v.select("id", (F.lit(1.0) - F.col("v") if invert else F.col("v")).alias("v"))
    t = texts.select(F.col(text_id).alias("id"), F.col(rank).alias("t"))
    score = F.coalesce("v", F.lit(0.0)) * vector_weight + F.coalesce("t", F.lit(0.0)) * text_weight
    return v.join(t, "id", "full").select("id", score.alias("rank_hybrid")).orderBy(F.col("rank_hybrid").desc(), "id")
