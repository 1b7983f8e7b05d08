"""Each stage of the pipeline against a plain version of what it promises."""

import collections

import pytest
from fixtures import documents, frame
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for _, f in pipeline.STAGES:
        out.append(f(spark, out[-1], SMALL).cache())
    return out


def test_stages_keep_the_columns(stages):
    for df in stages[:-1]:
        assert df.columns == pipeline.COLUMNS


def test_each_stage_has_effect(stages):
    docs, toxic, lines, near, mixed, packed = (df.collect() for df in stages)
    assert len(toxic) < len(docs) and {r.doc_id for r in lines} == {r.doc_id for r in toxic}
    assert sum(len(r.text) for r in lines) < sum(len(r.text) for r in toxic)
    assert all(r.n_chars == len(r.text) for r in lines)
    assert {r.doc_id for r in near} <= {r.doc_id for r in lines}
    copies = collections.Counter(r.doc_id for r in mixed)
    assert set(copies) <= {r.doc_id for r in near} and max(copies.values()) <= 2
    assert {r.doc_id for r in packed} == set(copies)
    tokens = collections.Counter()
    for r in packed:
        tokens[r.doc_id] += r.length
    whole = {r.doc_id: r.doc_tokens for r in packed}
    assert all(tokens[d] == copies[d] * whole[d] for d in copies)


def test_lines_are_those_of_the_operator(spark, stages):
    """No line that stays is in reach of an earlier one that stays, and lines that go have one: by a plain scan of lines of like length."""
    from tidewater.llm.line_dedup import reach, within

    docs = sorted(stages[1].collect(), key=lambda r: r.doc_id)
    kept = {r.doc_id: r.text for r in stages[2].collect()}
    first, order = {}, []
    for r in docs:
        for line in (r.text or "").split("\n"):
            if line.strip(" \t\n\v\f\r") and line not in first:
                first[line] = r.doc_id
                order.append(line)
    root = {x: x for x in order}
    by = collections.defaultdict(list)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in order:
        for n in range(len(x) - 2, len(x) + 3):
            for y in by[n]:
                if abs(len(x) - len(y)) <= reach(min(len(x), len(y))) and close(x, y) and within(x, y, reach(min(len(x), len(y)))):
                    a, b = find(x), find(y)
                    root[max(a, b, key=order.index)] = min(a, b, key=order.index)
        by[len(x)].append(x)
    seen = set()
    for r in docs:
        out = []
        for line in (r.text or "").split("\n"):
            if line.strip(" \t\n\v\f\r"):
                if find(line) in seen:
                    continue
                seen.add(find(line))
            out.append(line)
        assert kept[r.doc_id] == (None if r.text is None else "\n".join(out))


def close(x, y):
    """Of two edits at most one is before the middle third of the shorter line, in it, or behind it, so one third is there unchanged, or nearly in place."""
    n = min(len(x), len(y)) // 3
    return n < 4 or x[:n] == y[:n] or x[-n:] == y[-n:] or any(x[n : 2 * n - 1] in z for z in (y[n - 2 : 2 * n + 2],))


def test_near_copies_leave_one_of_each_group(stages):
    def shingles(text):
        w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    docs = sorted(stages[2].collect(), key=lambda r: r.doc_id)
    sets = {r.doc_id: shingles(r.text) for r in docs}
    holds = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s or [None]:
            holds[x].append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        for e in {e for x in (s or [None]) for e in holds[x] if e < d}:
            if s == sets[e] or len(s & sets[e]) >= 0.8 * len(s | sets[e]):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    assert {r.doc_id for r in stages[3].collect()} == {find(d) for d in sets}


def test_mix_and_packing_of_the_stages(spark, stages):
    from tidewater.llm import mixing

    near, mixed, packed = stages[3:]
    copies = {r.doc_id: r.mix_copies for r in mixing.mix(near).collect()}
    assert collections.Counter(r.doc_id for r in mixed.collect()) == {d: n for d, n in copies.items() if n}
    windows = collections.defaultdict(list)
    for r in packed.collect():
        windows[r.sequence_id].append(r)
    for pieces in windows.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and (r.doc_tokens > 2048 or r.length == r.doc_tokens)
            at += r.length
        assert at <= 2048


def test_odd_documents(spark):
    """Null and empty texts, null ids and sources, repeated rows, an empty table and columns of clashing names go through all stages."""
    rows = documents()
    frame_ = frame(spark, rows)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    out = frame_
    for _, f in pipeline.STAGES:
        out = f(spark, out, SMALL)
    assert labels.count() and {r.doc_id for r in out.collect()} <= {r[0] for r in rows} and out.count()
    out = frame(spark, [])
    for _, f in pipeline.STAGES:
        out = f(spark, out, SMALL)
    assert out.count() == 0


def test_run_agrees_with_the_stages(spark, stages):
    got = pipeline.run(spark, SMALL)
    assert got.agg(F.sum("length")).first()[0] == stages[-1].agg(F.sum("length")).first()[0]


def test_steps_of_components_write_few_files(spark, monkeypatch):
    """Where adaptive execution joins no partitions, files of a step follow its edges, not the shuffle's partitions."""
    from tidewater.llm import components as module

    made, keep = [], module.checkpoint
    monkeypatch.setattr(module, "checkpoint", lambda df: made.append(keep(df)) or made[-1])
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)], "a long, b long")
        got = {r.node: r.component for r in module.components(edges).collect()}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert len(made) > 2 and all(df.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism for df in made[1:])


def test_lines_of_large_groups_take_one_worker(spark, monkeypatch):
    """No task of the groups that are split again has two Python steps without an exchange between them."""
    from tidewater.llm import line_dedup as module

    plans, keep = [], module.checkpoint
    monkeypatch.setattr(module, "checkpoint", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    docs = spark.createDataFrame([(i, "\n".join(f"page {i * 20 + k:04d} of the whole book" for k in range(20))) for i in range(10)], "doc_id long, text string")
    module.line_dedup(docs, most=4).collect()
    again = [p for p in plans if "split(" in p]
    assert again
    for plan in again:
        steps = [x for x in plan.split("== Initial Plan ==")[-1].splitlines() if "Arrow" in x or "Exchange" in x]
        assert not any("MapInArrow" in x and "Arrow" in y for x, y in zip(steps, steps[1:])), plan
