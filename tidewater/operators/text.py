"""Full-text search ranked by BM25."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The usual parameters; the reference leaves them to its store.
K1, B = 1.2, 0.75


def tokens(text: Column, tokenizer: str = "default", n: int = 3) -> Column:
    """Terms of a text: default and simple (letters and digits, lower case), whitespace, raw, ngram (of code points), stem (plural s off), chinese (single characters)."""
    if tokenizer == "raw":
        return F.array(text)
    if tokenizer == "whitespace":
        return F.array_remove(F.split(text, r"\s+"), "")
    if tokenizer in ("ngram", "chinese"):
        size = n if tokenizer == "ngram" else 1
        low = F.lower(text)
        return F.when(F.char_length(low) < size, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.char_length(low) - size + 1), lambda i: F.substr(low, i, F.lit(size))))
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.regexp_replace(w, "(?<=..)s$", "")) if tokenizer == "stem" else words


def parse_query(query: str, default: str) -> list[tuple[str, str]]:
    """(column, term) of a query such as ``TEXT:apple pear``; a term without a column is of the default one."""
    out = []
    for part in query.split():
        column, _, term = part.rpartition(":")
        out += [((column or default).lower(), t) for t in re.findall(r"[^\W_]+", term.lower())]
    return out


def _frequency(words: Column, term: str) -> Column:
    return F.coalesce(F.size(words) - F.size(F.array_remove(words, term)), F.lit(0))


def _may_hold(text: Column, term: str, tokenizer: str) -> Column:
    """False for most texts without the term, before they are cut into words."""
    return F.contains(text if tokenizer in ("raw", "whitespace") else F.lower(text), F.lit(term))


def bm25(docs: DataFrame, id_col: str, terms: list[tuple[str, str]], tokenizer: str = "default", k1: float = K1, b: float = B, name: str = "rank_bm25") -> DataFrame:
    """Scores of the documents that hold a term, with their columns.

    One scan counts documents, terms and words; its result is a row. Another cuts those texts only that may hold a term of
    the query, and keeps counts of these terms beside the documents' columns. The postings of other terms are never made.
    """
    terms = list(dict.fromkeys(terms))
    if not terms:
        return docs.limit(0).withColumn(name, F.lit(0.0))
    columns = sorted({c for c, _ in terms})
    own = "_"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"

    def cut(rows: DataFrame) -> DataFrame:
        words = [tokens(F.col(c), tokenizer).alias(f"{own}t_{c}") for c in columns]
        return rows.select("*", *words)

    lengths = [F.when(F.col(c).isNotNull(), F.size(f"{own}t_{c}")).otherwise(F.lit(0)).alias(f"{own}l_{c}") for c in columns]
    held = [F.sum(F.coalesce(F.array_contains(f"{own}t_{c}", t), F.lit(False)).cast("int")).alias(f"{own}d{i}") for i, (c, t) in enumerate(terms)]
    facts = cut(docs).agg(F.count(F.lit(1)).alias(f"{own}n"), *[F.avg(n).alias(f"{own}a_{c}") for c, n in zip(columns, lengths)], *held)
    reach = F.lit(False)
    for c, t in terms:
        reach = reach | F.coalesce(_may_hold(F.col(c), t, tokenizer), F.lit(False))
    counts = [_frequency(F.col(f"{own}t_{c}"), t).alias(f"{own}f{i}") for i, (c, t) in enumerate(terms)]
    rows = cut(docs.where(reach)).select(*docs.columns, *counts, *lengths)
    score = F.lit(0.0)
    for i, (c, _) in enumerate(terms):
        f, d = F.col(f"{own}f{i}"), F.col(f"{own}d{i}")
        idf = F.log(F.lit(1.0) + (F.col(f"{own}n") - d + 0.5) / (d + 0.5))
        score = score + idf * f * (k1 + 1) / (f + k1 * (F.lit(1 - b) + b * F.col(f"{own}l_{c}") / F.col(f"{own}a_{c}")))
    # every score of a document that holds a term is above 0; as a condition of the join it stays above the cutting
    return rows.join(F.broadcast(facts), score > 0).select(*docs.columns, score.alias(name))


def text_search(docs: DataFrame, id_col: str, query: str, n: int, default: str = "text", tokenizer: str = "default", prefilter: Column | None = None, postfilter: Column | None = None, name: str = "rank_bm25") -> DataFrame:
    """The n best documents by score, then id. With a prefilter only documents that pass it are ranked and counted."""
    rows = docs.where(prefilter) if prefilter is not None else docs
    found = bm25(rows, id_col, parse_query(query, default), tokenizer, name=name).orderBy(F.col(name).desc(), id_col).limit(n)
    return found.where(postfilter) if postfilter is not None else found
