"""Documents to packed training sequences in five stages; each is written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import mixing, toxicity
from tidewater.llm.line_dedup import line_dedup
from tidewater.llm.near_copies import near_copy_groups
from tidewater.llm.packing import pack
from tidewater.llm.queries import TOXIC, vocabulary
from tidewater.llm.shared import remove, shared_path
from tidewater.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold. Rows with null or empty texts score like texts without toxic words, and stay."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model, keep=True).where(F.col("score") < TOXIC).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that come earlier in the corpus; n_chars follows the text. A null text stays null."""
    kept = line_dedup(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard similarity of five-word shingles 0.8 or more, in chains): that with
    the least id, nulls last. Of rows with one id and text one stays; null and empty texts are copies of each other."""
    rows = docs.select(*COLUMNS, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("_row"))
    groups = near_copy_groups(rows, id_col="_row").join(rows.select("_row", "doc_id"), "_row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    keep = groups.groupBy("component_id").agg(first.alias("first")).select("first._row")
    kept, twice = rows.join(keep, "_row", "left_semi"), rows.groupBy("_row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_row")
    return kept.join(twice, "_row", "left_anti").unionByName(kept.join(twice, "_row", "left_semi").dropDuplicates(["_row"])).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, a row for each copy taken. A null source is a source of its own; texts without words are taken as often as others."""
    return mixing.emit(mixing.mix(docs.select(*COLUMNS)))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed windows. A null or empty text is its end id."""
    return pack(docs, vocabulary("byte_bpe_50k.json"), 1)


def _shipped(stage):
    """The stage, on executors that have the package."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, _shipped(f)) for name, f in (("toxicity", reject_toxic), ("line_dedup", drop_lines), ("simhash", drop_near_copies), ("mixing", mix_sources), ("packing", pack_windows))]

#: Trained scores, edit joins and tokenizers are beyond SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each through Parquet in the shared folder, where only the last one's input stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
