"""Exact dedup by deterministic block naming: DataFrame operations only.

A text, without its ASCII white space, is cut into blocks of ``block`` code points. The distinct blocks are sorted (by
hash, then by content where hashes meet) and numbered, so equal blocks and no others share an integer name; then the
names of adjacent pairs are sorted and numbered in turn until each document has a single name. Texts are equal exactly
if their block counts and last names are: no hash decides it, and rows are told apart by number. Only the first level moves text, once and combined before
the shuffle, so a block with a third of all occurrences travels once per map task; the pair levels move integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACES, checkpoint

#: Names lie in ranges by hash, RANGES * 2**48 < 2**63, so that sorting runs in parallel.
RANGES, RANGE_BITS = 1 << 14, 48
#: Blocks of different content with one 64-bit hash, n**2 / 2**65 expected of n: so many are broadcast, more are joined.
MOST_BROADCAST = 10_000


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACES}+", "")


def _numbered(df: DataFrame, by: list, width, bits) -> DataFrame:
    """``name``: the place of each row, ``width`` places wide, when the rows of its range are sorted."""
    slot = F.pmod(bits, F.lit(RANGES)).cast("long")
    before = Window.partitionBy("slot").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("slot", slot).withColumn("name", F.shiftleft("slot", RANGE_BITS) + F.coalesce(F.sum(width).over(before), F.lit(0))).drop("slot")


def block_names(docs: DataFrame, id_col: str, text_col: str, block: int) -> DataFrame:
    """A row per document and block: row (its number), id, k, name, blocks, sha, chars."""
    norm = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"), F.char_length(F.coalesce(text_col, F.lit(""))).alias("chars"))
    cut = F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))
    cut = norm.select("row", "id", F.sha2("norm", 256).alias("sha"), "chars", cut.alias("cut"))
    each = cut.select("row", "id", "sha", "chars", F.size("cut").alias("blocks"), F.posexplode("cut").alias("k", "text")).withColumn("h", F.xxhash64("text"))
    distinct = each.groupBy("h").agg(F.sort_array(F.collect_set("text")).alias("texts"))
    slots = distinct.select("h", F.size("texts").cast("long").alias("n"), F.when(F.size("texts") > 1, F.col("texts")).alias("texts"))
    slots = checkpoint(_numbered(slots, ["h"], F.col("n"), F.shiftright("h", 20)))
    met = slots.where("n > 1").select("h", F.posexplode("texts").alias("place", "text"))
    many = met.count()
    if many:
        each = each.join(F.broadcast(met) if many <= MOST_BROADCAST else met, ["h", "text"], "left")
    else:
        each = each.withColumn("place", F.lit(0))
    named = each.drop("text").join(slots.select("h", "name"), "h")
    return checkpoint(named.select("row", "id", "sha", "chars", "blocks", "k", (F.col("name") + F.coalesce("place", F.lit(0))).alias("name")))


def identities(nodes: DataFrame) -> DataFrame | None:
    """(row, name) of the documents of several blocks, by naming pairs until one name is left; None if there are none."""
    most = nodes.agg(F.max("blocks")).first()[0] or 0
    level, ended = nodes.where("blocks > 1").select("row", F.col("blocks").alias("left"), "k", "name"), None
    while most > 1:
        half = F.shiftright("k", 1)
        pairs = level.groupBy("row", "left", half.alias("half")).agg(F.max(F.when(F.col("k") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("k") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        names = _numbered(pairs.select("a", "b").distinct(), ["a", "b"], F.lit(1), F.xxhash64("a", "b"))
        level = pairs.join(names, ["a", "b"]).select("row", F.floor((F.col("left") + 1) / 2).cast("int").alias("left"), F.col("half").alias("k"), "name")
        level, most = checkpoint(level), -(-most // 2)
        one = level.where("`left` = 1").select("row", "name")
        ended = one if ended is None else ended.unionByName(one)
        level = level.where("`left` > 1")
    return ended


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 4096) -> DataFrame:
    """Groups of equal texts (white space aside), one result row per input row.

    Columns: the id, keep_id, group_size (rows), kept, text_sha256. One row of a group stays: of those with the most code
    points the one with the smallest id (nulls last), and of rows that repeat it any one. Null texts are empty texts.
    Other columns are ignored; an empty table gives an empty result.
    """
    nodes = block_names(docs, id_col, text_col, block)
    first = nodes.where("k = 0").drop("k")
    rows = first.where("blocks = 1")
    longer = identities(nodes)
    if longer is not None:
        rows = rows.unionByName(first.where("blocks > 1").drop("name").join(longer, "row").select(*rows.columns))
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("row").alias("row")))
    # Copies are combined before the shuffle; what is left is a table of its own, so that adaptive execution can split the join.
    groups = checkpoint(rows.groupBy("blocks", "name").agg(F.count(F.lit(1)).alias("n"), best.alias("best")).where("n > 1"))
    one = F.col("n").isNull()
    return rows.join(groups, ["blocks", "name"], "left").select(
        F.col("id").alias(id_col),
        F.when(one, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (one | (F.col("row") == F.col("best.row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
