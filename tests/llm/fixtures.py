"""Small documents with every odd case: nulls, empty and long texts, copies, repeated rows, clashing columns."""

import random

WORDS = "the of and thion erst anble inere shion ation hewh tised onre leaux queté über straße".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bundle string, tag string, id string, h string, size string, kept string"


def prose(r, n):
    out = []
    for _ in range(n):
        out.append(r.choice(WORDS) + r.choice(WORDS) if r.random() < 0.7 else r.choice(WORDS))
        out.append(r.choice([" ", " ", " ", ". ", "\n", "  ", "\t"]))
    return "".join(out)


def documents(seed=1, n=60):
    r = random.Random(seed)
    passage = " ".join(r.choice(WORDS) + str(i) for i in range(70))
    texts = []
    for i in range(n):
        t = prose(r, r.choice([0, 1, 3, 12, 60, 200]))
        if i % 7 == 0:
            t += " " + passage + " " + prose(r, 5)
        if i % 11 == 0 and texts:
            t = texts[0] if r.random() < 0.5 else (texts[-1] or "") + " "
        if i % 13 == 5:
            t += "\nLicensed under the Apache License, Version 2.0. All rights reserved."
        texts.append(t)
    texts[3], texts[4], texts[5] = None, "", " \n\t"
    texts[9] = "same " * 300
    texts[10] = prose(r, 9000)
    rows = [(100 + i if i != 20 else None, t, "en", f"src{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[30])  # a row twice
    rows.append((130, "another text of a repeated id " + passage, "de", "src1", 9))
    return [(*x, "b", "t", "i", "h", "s", "k") for x in rows]


def frame(spark, rows=None):
    rows = documents() if rows is None else rows
    return spark.createDataFrame(rows, SCHEMA)
