"""The near-copy stage against all pairs by Python sets, with copies planted at similarity 0.8 to 0.95 and below."""

import random

import corpus_pipeline as pipeline
from tidewater.llm import near_copies


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def planted():
    """(texts, planted pairs of similarity 0.8 to 0.95, pairs of 0.6 to 0.8)."""
    r = random.Random(8)
    texts, near, under = [None, "", "two words", "two  Words"], [], []
    for n in range(40):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice([60, 200, 600]))]
        while True:
            other = list(words)
            for _ in range(r.randrange(1, 2 + len(words) // 20)):
                other[r.randrange(len(other))] = f"x{r.randrange(10**6)}"
            s = similarity(shingles(" ".join(words)), shingles(" ".join(other)))
            if (0.8 <= s <= 0.95) if n < 30 else (0.6 <= s < 0.8):
                break
        (near if n < 30 else under).append((len(texts), len(texts) + 1))
        texts += [" ".join(words), " ".join(other)]
    return texts, near, under


def test_stage_drops_planted_near_copies(spark):
    texts, near, under = planted()
    sets = [shingles((t or "").lower()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, texts[5], "en", "s", 1)] + [(4, texts[4], "en", "s", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = [r.doc_id for r in pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(left, key=str) == sorted(set(root), key=str)  # the row without an id is a copy of text 5
    assert all(j not in left for _, j in near) and all(i in left and j in left for i, j in under)


def test_bundles_in_pieces(spark):
    chain = [" ".join(f"c{i + k}" for k in range(100)) for i in range(0, 300, 5)]  # each is near the next one only
    docs = spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")
    got = near_copies.near_copy_groups(docs, most=7).collect()
    assert {r.component_id for r in got} == {0} and len(got) == len(chain)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_copies.near_copy_groups(none).count() == 0
