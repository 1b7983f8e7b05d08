"""Each operator against a brute-force version on documents with every odd case."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from fixtures import SCHEMA, documents, frame
from pyspark.sql import functions as F

from tidewater.llm import license_scan, mixing, packing, quality, toxicity
from tidewater.llm.exact_dedup import exact_dedup
from tidewater.llm.line_dedup import keys, line_dedup, reach, within
from tidewater.llm.queries import vocabulary
from tidewater.llm.shared import shared_path
from tidewater.llm.simhash import linked, links, simhash_groups
from tidewater.llm.substring_dedup import substring_dedup
from tidewater.llm.token_orc import read_tokens, token_index, write_tokens
from tidewater.llm.tokens import Encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = documents()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def counted(rows):
    return collections.Counter(rows)


def test_quality(docs, none):
    def brute(x):
        w = WORD.findall(x or "")
        g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        c = collections.Counter(g)
        cover = {j for i, k in enumerate(g) if c[k] > 1 for j in range(i, i + 5)}
        lines = [v for v in (x or "").split("\n") if WORD.search(v)]
        return len(w), sum(map(len, w)), sum(a in "#*$%&|<>" for a in x or ""), len(lines) - len(set(lines)), len(cover)

    got = quality.ledger(docs).collect()
    assert counted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == counted((d[0], *brute(d[1])) for d in DOCS)
    for r in got:
        assert bool(r.fail_bits & 1) == (r.n_words < 10)
        assert bool(r.fail_bits & 2) == (100 * r.n_repeat_words > 20 * r.n_words)
    assert quality.ledger(none).count() == 0


def test_policies_and_ablation(docs):
    entries = quality.ledger(docs).cache()
    bits = [r.fail_bits for r in entries.collect()]
    for version, mask in quality.POLICIES.items():
        assert quality.apply_policy(entries, version).where("kept").count() == sum(b & mask == 0 for b in bits)
        for r in quality.ablate(entries, version).collect():
            own = quality.BIT[r.rule]
            assert r.failed == sum(bool(b & own) for b in bits)
            assert r.only == sum(b & mask == own for b in bits)
            assert r.kept_without == sum(b & mask & ~own == 0 for b in bits)


def ids_of(name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids + [end]


def test_cached_encoder_agrees_with_whole_texts():
    r = random.Random(3)
    parts = ["the", "Über", "it's", "a.b,c", " ", "  ", "\n", "\t ", " ", "　", "123", "é", "́", "x<|endoftext|>y", "\x1c", "don't", "😀"]
    texts = ["".join(r.choice(parts) + r.choice(["", " ", " "]) for _ in range(r.randint(0, 30))) for _ in range(300)]
    for name, drops in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        whole = ids_of(name, 0)
        for text, got in zip(texts, Encoder(vocabulary(name), drops).encode(texts)):
            assert np.frombuffer(got, "<u4").tolist() == whole(text)[:-1], text


def test_encoder_keeps_each_word_once(monkeypatch):
    """All that an encoder keeps is within its bound, and ids stay right when it starts anew."""
    from tidewater.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_PIECES", 50)
    words = [f"{a}{b}{c}" for a in "bdfgé" for b in "aeioó" for c in ("l", "n", "r", "st")]
    text = " ".join(x for w in words for x in (w, w + ",", w.capitalize(), "(" + w + ")"))
    for name, drops in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        code = Encoder(vocabulary(name), drops)
        assert np.frombuffer(code.encode([text])[0], "<u4").tolist() == ids_of(name, 0)(text)[:-1]
        assert sum(len(x) for x in vars(code).values() if isinstance(x, dict)) <= 50


def test_token_files(spark, docs, none):
    path = write_tokens(docs, shared_path(spark, "t"), vocabulary("word_bpe_49k.json"), 2, files=5)
    code = ids_of("word_bpe_49k.json", 2)
    want = {(d[0], tuple(code(d[1]))) for d in DOCS}
    rows = read_tokens(spark, path)
    assert {(r.doc_id, tuple(r.ids)) for r in rows.collect()} == want
    index = sorted(token_index(spark, path).collect(), key=lambda r: r.start)
    assert len(index) == len(DOCS)
    at = 0
    order = [(r.doc_id is not None, r.doc_id) for r in index]
    assert order == sorted(order, key=lambda x: (x[0], x[1] or 0))
    for r in index:
        assert r.start == at
        at += r.n_tokens
    sums = counted((d[0], zlib.crc32(np.array(code(d[1]), "<u4").tobytes())) for d in DOCS)
    assert counted((r.doc_id, r.ids_crc32) for r in index) == sums
    assert rows.where("doc_id = 110").count() == 1
    assert token_index(spark, write_tokens(none, shared_path(spark, "t"), vocabulary("word_bpe_49k.json"), 2)).count() == 0


def test_token_files_are_cheap_to_write_and_read(spark, docs):
    """Runs of integers gain little from zstd."""
    path = write_tokens(docs, shared_path(spark, "t"), vocabulary("word_bpe_49k.json"), 2, files=2)
    assert all(x.endswith(".lz4.orc") for x in read_tokens(spark, path).inputFiles())


def test_toxicity_on_held_out(spark):
    r = random.Random(5)
    clean = "the of and thion erst anble inere shion ation hewh".split()
    bad = ["idiot", "scum", "vexlar", "vexlon", "vexmite", "vexor"]
    rows, labels = [], []
    for i in range(900):
        w = [r.choice(clean) + r.choice(clean) for _ in range(r.randint(0, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(r.randint(2, 6)):
                w.insert(r.randint(0, len(w)), r.choice(bad[:2]) if r.random() < 0.5 else "vex" + r.choice(["lar", "lon", "mite", "or"]) + r.choice(clean))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, "")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).withColumn("held", toxicity.held_out("doc_id")).join(labels, "doc_id", "left").collect()
    for r_ in got:
        assert 0 <= r_.score <= 1
        assert r_.held == (zlib.crc32(str(r_.doc_id).encode()) % 3 == 1)
        if r_.toxic is None:
            assert r_.score < 0.5
    held = [x for x in got if x.held and x.toxic is not None]
    assert sum((x.score >= 0.7) == bool(x.toxic) for x in held) / len(held) > 0.97
    text = dict(rows)
    spans = [text[x.doc_id][s["from"] : s["to"]] for x in got if x.toxic for s in x.spans]
    assert sum(any(s.startswith(("idiot", "scum", "vex")) for s in [v]) for v in spans) / len(spans) > 0.9


def test_chain_against_enumeration():
    r = np.random.default_rng(0)
    emit, first = r.normal(size=9), np.zeros(9, dtype=bool)
    first[[0, 4]] = True
    start, moves = 0.3, r.normal(size=(2, 2))
    total, toxic, pairs = 0.0, np.zeros(9), np.zeros((2, 2))
    for code in range(1 << 9):
        y = [code >> i & 1 for i in range(9)]
        s = sum(emit[i] * y[i] + (start * y[i] if first[i] else moves[y[i - 1], y[i]]) for i in range(9))
        total += np.exp(s)
        toxic += np.exp(s) * np.array(y)
        for i in range(9):
            if not first[i]:
                pairs[y[i - 1], y[i]] += np.exp(s)
    p, e = toxicity.chain(emit, first, start, moves, pairs=True)
    assert np.allclose(p, toxic / total) and np.allclose(e, pairs / total)
    long_, where = r.normal(size=1000), np.zeros(1000, dtype=bool)
    where[[0, 1, 500, 511, 512, 640]] = True
    whole = toxicity.chain(long_, where, start, moves)
    cuts = [*np.flatnonzero(where), 1000]
    assert np.allclose(whole, np.concatenate([toxicity.chain(long_[i:j], where[i:j], start, moves) for i, j in zip(cuts, cuts[1:])]))


def test_regression_on_separable_labels():
    x = np.array([[1.0, 0, 0, 0]] * 4000 + [[1.0, 2, 1, 0.05]] * 400)
    y = np.array([0] * 4000 + [1] * 400)
    w = toxicity._logistic(x, y)
    p = 1 / (1 + np.exp(-(x @ w)))
    assert np.abs(w).max() < 100 and p[:4000].max() < 0.1 and p[4000:].min() > 0.9


def test_training_without_labels(spark, docs):
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).where("score >= 0.7").count() == 0


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert got == mixing.mix(docs).collect() or counted(map(tuple, got)) == counted(map(tuple, mixing.mix(docs).collect()))
    size = collections.Counter()
    for d in DOCS:
        size[d[3]] += len(WORD.findall(d[1] or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(size.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * size[s] < unit * weight[s]}
        if not full:
            target.update({s: unit * weight[s] for s in open_})
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= 2 * size[s]
        open_ -= full
    taken = collections.Counter()
    for r in got:
        assert r.mix_size == len(WORD.findall(r.text or "")) and 0 <= r.mix_copies <= 2
        assert r.mix_source_size == size[r.source]
        assert r.mix_target == pytest.approx(target[r.source])
        taken[r.source] += r.mix_copies * r.mix_size
    most = max(len(WORD.findall(d[1] or "")) for d in DOCS)
    for s in order:
        assert abs(taken[s] - target[s]) <= 2 * most
    assert mixing.emit(mixing.mix(docs)).count() == sum(r.mix_copies for r in got)
    assert mixing.mix(none).count() == 0


@pytest.mark.parametrize("block", [3, 64, 4096])
def test_exact_dedup(docs, none, block):
    groups = collections.defaultdict(list)
    for d in DOCS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", d[1] or "")].append(d)
    want = []
    for norm, rows in groups.items():
        keep = min(rows, key=lambda d: (-len(d[1] or ""), d[0] is None, d[0] or 0))
        kept = False
        for d in rows:
            stays = not kept and d[0] == keep[0] and len(d[1] or "") == len(keep[1] or "")
            kept |= stays
            want.append((d[0], keep[0], len(rows), stays, hashlib.sha256(norm.encode()).hexdigest()))
    got = exact_dedup(docs, block=block).collect()
    assert counted(map(tuple, got)) == counted(want)
    assert exact_dedup(none, block=block).count() == 0


def test_packing(docs, none):
    code = ids_of("byte_bpe_50k.json", 1)
    got = packing.pack(docs.repartition(3), vocabulary("byte_bpe_50k.json"), 1, size=256, group=16, with_ids=True).collect()
    whole = counted((d[0], tuple(code(d[1]))) for d in DOCS)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length > 0
    for doc, rows in by.items():
        tokens = counted(t for (d, ids), k in whole.items() if d == doc for i in ids for t in [i] * k)
        assert counted(i for r in rows for i in np.frombuffer(r.ids, "<u4").tolist()) == tokens
        if sum(k for (d, _), k in whole.items() if d == doc) == 1:
            rows.sort(key=lambda r: r.start)
            assert np.frombuffer(b"".join(r.ids for r in rows), "<u4").tolist() == code(next(d[1] for d in DOCS if d[0] == doc))
    seq = collections.defaultdict(list)
    for r in got:
        seq[r.sequence_id].append((r.offset, r.length))
    for pieces in seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert all(r.length == r.doc_tokens for r in got if r.doc_tokens <= 256)  # documents that fit are whole
    assert sum(r.length for r in got) >= 0.95 * 256 * len(seq)
    assert packing.pack(none, vocabulary("byte_bpe_50k.json"), 1).count() == 0


def test_packing_fill():
    r = random.Random(4)
    for most, least in ((2000, 0.97), (2048, 0.97), (6000, 0.995)):
        short, long, windows, n = [], collections.deque(), [], 0
        for i in range(3000):
            size = r.randint(1, most) if r.random() < 0.9 else r.randint(1, 200)
            long.append((i, 0, size)) if size > 2048 else short.append((i, size))
            n += size
            if len(short) >= 128:
                full, short = packing.pack_group(short, long, 2048, False)
                windows += full
                assert len(short) < 110
        windows += packing.pack_group(short, long, 2048, True)[0]
        assert sum(x[2] for w in windows for x in w) == n and max(sum(x[2] for x in w) for w in windows) <= 2048
        assert n >= least * 2048 * len(windows)


def test_differencing_is_near_equal():
    r = random.Random(2)
    for k in (1, 2, 7, 20):
        sizes = [r.randint(1, 100) for _ in range(20 * k)]
        parts = packing.differencing(sizes, k)
        assert sorted(i for p in parts for i in p) == list(range(len(sizes))) and len(parts) == k
        sums = [sum(sizes[i] for i in p) for p in parts]
        assert max(sums) - min(sums) <= 12
    assert packing.differencing([], 3) == [[], [], []]


def test_substring_dedup(docs, none):
    first = {}
    rows = [(d[0], (d[1] or "").encode().split()) for d in DOCS]
    for i, w in rows:
        if i is not None:
            for k in range(len(w) - 49):
                g = tuple(w[k : k + 50])
                first[g] = min(first.get(g, i), i)
    want = []
    for i, w in rows:
        gone = set()
        if i is not None:
            for k in range(len(w) - 49):
                if first[tuple(w[k : k + 50])] < i:
                    gone.update(range(k, k + 50))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        want.append((i, len(w), len(gone), kept))
    assert counted(map(tuple, substring_dedup(docs).collect())) == counted(want)
    assert substring_dedup(none).count() == 0


def test_license_rules(spark, docs, none):
    text = "Some words. LICENSED under the  Apache License, Version 2.0! You may not use this file except in compliance with the License.\nAll rights reserved."
    odd = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "Released under the MIT License today.")], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(odd).collect()}
    assert got[1].license == "Apache-2.0" and got[1].sentence_ids == "4,5,12" and got[1].licenses == "Apache-2.0|All-Rights-Reserved"
    assert got[2].license is None and got[3].n_license_sentences == 0 and got[4].license is None
    assert license_scan.scan_licenses(docs).count() == len(DOCS) and license_scan.scan_licenses(none).count() == 0


def test_simhash(docs, none):
    def print_of(x):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), x or "").encode().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    rows = [(d[0], print_of(d[1])) for d in DOCS]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(rows[i][1] ^ rows[j][1]).count("1") <= 3])
    least = {}
    for (i, _), c in zip(rows, root):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    got = simhash_groups(docs).select("doc_id", "print", "component_id").collect()
    assert counted((r.doc_id, r.print & (1 << 64) - 1, r.component_id) for r in got) == counted((i, p, least.get(c)) for (i, p), c in zip(rows, root))
    assert simhash_groups(none).count() == 0


def test_bit_sliced_links(spark):
    r = random.Random(4)
    prints = set()
    for _ in range(30):
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 30)):
            for _ in range(r.randint(0, 2)):
                x ^= 1 << r.randrange(64)
            prints.add(x)
    p = np.array(sorted(prints), dtype=np.uint64)
    want = roots(len(p), [(i, j) for i in range(len(p)) for j in range(i) if bin(int(p[i] ^ p[j])).count("1") <= 3])
    assert roots(len(p), linked(p, np.array([0, len(p)]))) == want
    df, at = spark.createDataFrame([(int(x),) for x in p.view(np.int64)], "print long"), {int(x): i for i, x in enumerate(p.view(np.int64))}
    for most in (4096, 20):  # the second splits groups into pieces
        assert roots(len(p), [(at[e.a], at[e.b]) for e in links(df, most=most).collect()]) == want


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_banded_distance():
    r = random.Random(1)
    for _ in range(2000):
        a = "".join(r.choice("abc") for _ in range(r.randint(0, 12)))
        b = list(a)
        for _ in range(r.randint(0, 4)):
            k, at = r.randint(0, 2), r.randint(0, len(b))
            if k == 0:
                b.insert(at, r.choice("abc"))
            elif at < len(b):
                b[at : at + 1] = [] if k == 1 else [r.choice("abc")]
        b = "".join(b)
        for radius in range(4):
            assert within(a, b, radius) == (distance(a, b) <= radius), (a, b, radius)


def test_lines_in_reach_share_a_key():
    r = random.Random(6)
    for _ in range(1500):
        a = [r.choice("abé") for _ in range(r.randint(8, 45))]
        b = list(a)
        for _ in range(r.randint(1, 2)):
            k, at = r.randint(0, 2), r.randrange(len(b))
            b[at : at + 1] = [r.choice("abé"), b[at]] if k == 0 else [] if k == 1 else [r.choice("abé")]
        a, b = sorted(("".join(a), "".join(b)), key=len)
        if a != b and distance(a, b) <= reach(len(a)):
            assert {k for k, own in keys(a, 2) if own} & {k for k, _ in keys(b, 2)}, (a, b)


def test_lines_of_templates(spark):
    """Groups that hold one template, a counter of few digits, or a mixture."""
    r = random.Random(9)
    lines = [f"user {r.randrange(10**7)} has opened door number {r.randrange(10**3)} of the house" for _ in range(150)]
    lines += [f"page {i:03d} of the whole book" for i in range(0, 1000, 23)] + [f"aaaaaaaaaa{'ab' * (i % 7)}{i % 5}aaaaaaaaaa" for i in range(60)]
    lines += [x[:9] + "7" + x[10:] for x in lines[:40]] + [x.replace("opened", "open") for x in lines[:30]]
    known = sorted(set(lines))
    root = roots(len(known), [(i, j) for i, a in enumerate(known) for j, b in enumerate(known[:i]) if abs(len(a) - len(b)) <= 2 and distance(a, b) <= reach(min(len(a), len(b)))])
    where, seen, want = dict(zip(known, root)), set(), {}
    for i in range(0, len(lines), 20):
        want[i] = "\n".join(x for x in lines[i : i + 20] if not (where[x] in seen or seen.add(where[x])))
    docs = spark.createDataFrame([(str(i).zfill(4), "\n".join(lines[i : i + 20])) for i in want], "doc_id string, text string")
    for most in (1024, 16, 2):
        assert {int(x.doc_id): x.text for x in line_dedup(docs, most=most).collect()} == want


@pytest.mark.parametrize("most", [256, 3])  # the second splits nearly all groups again
def test_line_dedup(spark, none, most):
    r = random.Random(1)
    lines = []
    for _ in range(100):
        base = "".join(r.choice("abcde é") for _ in range(r.randint(4, 60)))
        for _ in range(r.randint(1, 4)):
            b = list(base)
            for _ in range(r.randint(0, 3)):
                at, k = r.randrange(len(b)), r.randint(0, 2)
                b[at : at + 1] = ["x", b[at]] if k == 0 else [] if k == 1 else ["y"]
            lines.append("".join(b))
    rows = [(i if i != 7 else None, "\n".join(r.choice([*lines, "", " "]) for _ in range(r.randint(0, 12))) if i != 3 else None) for i in range(70)]
    known = sorted({v for _, x in rows if x for v in x.split("\n") if v.strip(" \t\n\v\f\r")})
    root = roots(len(known), [(i, j) for i, a in enumerate(known) for j, b in enumerate(known[:i]) if abs(len(a) - len(b)) <= 2 and distance(a, b) <= reach(min(len(a), len(b)))])
    where, seen, want = dict(zip(known, root)), set(), []
    for i, x in sorted(rows, key=lambda d: (d[0] is None, d[0] or 0)):
        kept, n, m = [], 0, 0
        for v in (x or "").split("\n"):
            if v in where:
                n += 1
                if where[v] in seen:
                    m += 1
                    continue
                seen.add(where[v])
            kept.append(v)
        want.append((i, None if x is None else "\n".join(kept), n, m))
    full = frame(spark, [(i, x, "en", "s", 1, "b", "t", "i", "h", "s", "k") for i, x in rows])
    got = line_dedup(full, most=most)
    assert got.columns == [*(f.split()[0] for f in SCHEMA.split(", ")), "n_lines", "n_removed"]
    assert counted((r_.doc_id, r_.text, r_.n_lines, r_.n_removed) for r_ in got.collect()) == counted(want)
    assert line_dedup(none).count() == 0
