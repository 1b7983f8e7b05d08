"""Mixing sources to target weights by systematic sampling: DataFrame operations only.

Each document's expected copies are its source's target over its size. The documents of a source stand in one fixed
order (size class, then a hash, then size and id); the expected copies are summed along it, one random offset is added,
and a document is taken once for each integer boundary its step crosses. Sizes vary little between neighbours of that
order, so the words taken stay close to the target. The order is dealt into many buckets of a source, counted first, so
that a source with a third of all rows is ranked by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, checkpoint

#: Size classes per doubling of the size, and hash buckets in each class of a source.
CLASSES, BUCKETS = 64, 64


def source_targets(sizes: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """From (source, source_size), a row per source: adds weight and target.

    Sources in code-point order, null last, take the weights in turn and share ``share`` of all sizes by weight; no
    target passes ``cap`` times its source's size, and what is over goes to the others by weight. That is one water
    level: with the sources in the order of size over weight, those before the level are full.
    """
    line, every = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last()), Window.partitionBy(F.lit(1))
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("most") / F.col("weight"))
    left = F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    return ranked.withColumn("level", level).withColumn("target", F.least("most", F.max("level").over(every) * F.col("weight"))).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """The documents with four more columns: mix_size (words), mix_source_size, mix_target and mix_copies.

    Null texts have size 0; a null source is a source of its own. Repeated rows are sampled each by itself. Every row
    of the input is in the result, with 0 copies if it isn't taken; the same input gives the same copies. Columns whose
    names begin with mix_ are replaced. The texts are read twice: for the counts, which go through the shared folder, and
    for the ranks.
    """
    own = [c for c in docs.columns if not c.lower().startswith("mix_")]
    docs = docs.select(*own)
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("null"))
    sized = docs.withColumns({"mix_size": F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long"), "mix_key": key, "mix_tie": F.xxhash64(text_col)})
    sized = sized.withColumns({"mix_class": F.floor(F.log2(F.col("mix_size") + 1) * CLASSES).cast("int"), "mix_bucket": F.pmod(F.xxhash64(F.col(id_col), "mix_tie"), F.lit(BUCKETS)).cast("int")})
    place = ["mix_key", "mix_class", "mix_bucket"]
    counts = checkpoint(sized.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.sum("mix_size").alias("words"), F.first(source_col).alias("source")))
    along = Window.partitionBy("mix_key").orderBy("mix_class", "mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*place, F.coalesce(F.sum("n").over(along), F.lit(0)).alias("mix_start"))
    targets = source_targets(counts.groupBy("mix_key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")).drop("mix_key"), weights, share, cap)
    targets = targets.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("mix_key"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    offset = F.pmod(F.xxhash64(F.lit(seed), "mix_key"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    known = starts.join(targets, "mix_key").withColumn("mix_offset", offset)
    ranked = sized.withColumn("mix_rank", F.row_number().over(Window.partitionBy(*place).orderBy("mix_size", id_col, "mix_tie")))
    step = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    at = F.col("mix_start") + F.col("mix_rank")
    copies = F.floor(at * step + F.col("mix_offset")) - F.floor((at - 1) * step + F.col("mix_offset"))
    out = ranked.join(known, place).withColumn("mix_copies", copies.cast("int"))
    return out.select(*own, "mix_size", "mix_source_size", "mix_target", "mix_copies")


def emit(mixed: DataFrame) -> DataFrame:
    """Each taken document once per copy, with the columns it had before the mix."""
    own = [c for c in mixed.columns if not c.startswith("mix_")]
    return mixed.where("mix_copies > 0").select(*own, F.explode(F.array_repeat(F.lit(0), F.col("mix_copies"))).alias("mix_copy")).drop("mix_copy")
