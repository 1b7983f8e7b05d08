"""Vectors of texts against a plain version, each text cut into words once."""

import re

import numpy as np
import pytest
import xxhash
from compare import SF
from pyspark.sql import functions as F

from tidewater.operators.vector import hash_embedding
from tidewater.sources.tables import table

ODD = ["", " ", "--", "a", "a A a", " lead and trail ", "snake_case 9 _", "Straße café 北京 mots", "İstanbul K", "x\x00y\nz\tw v", "😀 smile 😀", "word " * 30_000]


def plain(text, dimension):
    """By Java's \\W, for which letters are a-z only."""
    raw = np.zeros(dimension)
    for w in re.split(r"[^A-Za-z0-9_]+", text.lower()):
        if w:
            h = xxhash.xxh64_intdigest(w.encode(), seed=42)
            raw[(h - (1 << 64) if h >> 63 else h) % dimension] += 1
    return (raw / (np.sqrt((raw * raw).sum()) + 1e-30)).astype(np.float32).tolist()


@pytest.mark.parametrize("dimension", [1, 7, 8, 16])
def test_vectors_agree_with_a_plain_version(spark, dimension):
    docs = table(spark, SF, "documents").select("text").union(spark.createDataFrame([(t,) for t in ODD], "text string"))
    got = docs.select("text", hash_embedding(F.col("text"), dimension).alias("v")).collect()
    assert len(got) == table(spark, SF, "documents").count() + len(ODD)
    for r in got:
        assert r.v == ([None] * dimension if r.text is None else plain(r.text, dimension)), r.text


def test_a_text_is_made_once(spark):
    """Of a text that differs each time it is made, all slots and the norm are of one text."""
    for r in spark.range(40).select(hash_embedding(F.uuid(), 8).alias("v")).collect():
        assert abs(sum(x * x for x in r.v) - 1) < 1e-6


def test_null_text(spark):
    r = spark.createDataFrame([(None,)], "text string").select(hash_embedding(F.col("text"), 8).alias("v")).first()
    assert r.v == [None] * 8
