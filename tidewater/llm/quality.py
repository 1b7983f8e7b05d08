"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps its measurements and, in one integer, a bit for each rule
that failed. A policy is a version and the mask of the rules it enforces, so policies are applied, compared and ablated
by integer arithmetic on the ledger, without the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import HASH_B, SPACE, Items, Texts, covered, mix, row_of, slices, windows

#: The rules, by bit: what a failing document has.
RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
    "letters": "10 * n_letters < 5 * word_chars",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: Policies by version: the mask of the rules that they enforce. Old versions stay, so their verdicts can be had again.
POLICIES = {1: BASE, 2: BASE | BIT["symbols"] | BIT["repeated_lines"], 3: (1 << len(RULES)) - 1}

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]] = True
_CODE_POINT = np.ones(256, dtype=bool)  # bytes that begin one
_CODE_POINT[0x80:0xC0] = False
_LINE = np.ones(256, dtype=bool)
_LINE[10] = False

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters"]


def _twice(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def _again(keys: np.ndarray) -> np.ndarray:
    """Which keys occurred before."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][keys[order][1:] == keys[order][:-1]]] = True
    return out


def measure(column: pa.Array, window: int = 5) -> dict[str, np.ndarray]:
    t = Texts(column)
    starts, ends, at = t.words()
    lines, line_ends, line_at = t.runs(_LINE)
    n = np.diff(at)
    spaces = np.zeros(len(t.data) + 1, dtype=np.int64)
    np.cumsum(~SPACE[t.data], out=spaces[1:])
    full = spaces[line_ends] > spaces[lines] if len(lines) else np.zeros(0, dtype=bool)
    rows = row_of(line_at)[full]
    again = _again(Items(t.data, lines).hashes(line_ends)[full] ^ mix(rows.astype(np.uint64)))
    words = Items(t.data, starts).hashes(ends)
    where, seen = windows(words, at, window, HASH_B)
    word_row = row_of(at)
    twice = _twice(seen ^ mix(word_row[where].astype(np.uint64))) if len(where) else np.zeros(0, dtype=bool)
    repeat = covered(where[twice], window, len(words))
    return {
        "n_words": n,
        "word_chars": t.count(_CODE_POINT & ~SPACE),
        "n_symbols": t.count(_SYMBOL),
        "n_lines": np.bincount(rows, minlength=t.rows),
        "n_dup_lines": np.bincount(rows[again], minlength=t.rows),
        "n_repeat_words": np.bincount(word_row[repeat], minlength=t.rows),
        "n_letters": t.count(_LETTER),
    }


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: the id, the measurements, and fail_bits.

    Words are runs of anything but ASCII white space; null and empty texts have none, and fail few_words. Lines are
    compared within their text, words in windows of five likewise. One pass, no shuffle; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = measure(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(found[m].astype(np.int64)) for m in MEASURES)], names=["id", *MEASURES])

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = sum((F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()), F.lit(0))
    return found.withColumn("fail_bits", bits.cast("long")).withColumnRenamed("id", id_col)


def apply_policy(entries: DataFrame, version: int) -> DataFrame:
    """Adds ``kept``: no rule that the policy enforces has failed."""
    return entries.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablate(entries: DataFrame, version: int) -> DataFrame:
    """A row per rule of a policy: rule, failed (documents), only (those that no other enforced rule rejects), kept_without.

    Documents are first counted by their masked failure bits, at most 2**rules rows, so the texts, measurements and
    documents are not needed again; ``every`` and ``ever`` are the AND and OR of the bits of all rejected documents.
    """
    mask = POLICIES[version]
    by = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = [n for n in RULES if BIT[n] & mask]
    sums = [
        F.struct(
            F.lit(name).alias("rule"),
            F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(BIT[name])) != 0, F.col("n"))), F.lit(0)).alias("failed"),
            F.coalesce(F.sum(F.when(F.col("bits") == BIT[name], F.col("n"))), F.lit(0)).alias("only"),
            F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(mask & ~BIT[name])) == 0, F.col("n"))), F.lit(0)).alias("kept_without"),
        )
        for name in rules
    ]
    rejected = F.when(F.col("bits") != 0, F.col("bits"))
    one = by.agg(F.array(*sums).alias("all"), F.bit_and(rejected).alias("every"), F.bit_or(rejected).alias("ever"))
    return one.select(F.explode("all").alias("r"), "every", "ever").select("r.*", "every", "ever")
