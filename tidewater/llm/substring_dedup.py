"""Substring dedup by fixed-block anchors.

Each document's words are cut into blocks of ``window // 2``; the blocks are the index. Every rolling window of that
many words probes it, so a repeat of ``window`` words in two documents always has an anchor: it holds a whole block of
either. Probes travel as packed 32-bit hashes, each once per bundle, dealt by the hash's other bits, in one row per
bundle and part; what comes back are the hashes that hit. Around the hits the repeats are extended: the windows of
``window`` words that hold an anchor are compared by two 64-bit hashes, polynomials of the words' hashes in two bases,
and runs of equal windows are the maximal repeats. A window that also starts in a document with a smaller id is removed
with all its words.

Hot passages: of equal windows in a bundle one row travels, the smallest id's; those of larger ids are settled there.
Copies of a whole text are found first, by two hashes of it, and settled without any windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bundles import Bundles, pieces_of
from .shared import checkpoint
from .textkernel import HASH_A, HASH_B, SLICE_BYTES, Items, Texts, covered, mix, row_of, windows

#: Bytes of packed probes that one matching task holds, about.
PART_BYTES = 8 << 20
_ROW = 32


def _words(t: pa.Table, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a bundle and the word offsets of its rows."""
    hashes, counts = [], []
    for _, texts in pieces_of(t, text, SLICE_BYTES):
        x = Texts(texts)
        starts, ends, at = x.words()
        hashes.append(Items(x.data, starts).hashes(ends))
        counts.append(np.diff(at))
    at = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64) if counts else np.zeros(1, dtype=np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)), at


def _probes(words: np.ndarray, at: np.ndarray, block: int, parts: int):
    """Places of the rolling windows, and for each its number among the different (part, 32-bit hash); of these the hashes,
    whether any place is an index block, whether there are several, and the offsets of the parts."""
    where, h = windows(words, at, block)
    part = (h >> np.uint64(32)) % np.uint64(parts)
    one, number, count = np.unique((part << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)), return_inverse=True, return_counts=True)
    begin = at[:-1][row_of(at)[where]] if len(where) else where
    index = np.zeros(len(one), dtype=bool)
    index[number[(where - begin) % block == 0]] = True
    bounds = np.searchsorted(one, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))
    return where, number, (one & np.uint64(0xFFFFFFFF)).astype("<u4"), index, count > 1, bounds


def _copies(docs: DataFrame, b: Bundles, text_col: str) -> DataFrame:
    """(_bundle, id, tag) of the rows whose whole text also is that of a row with a smaller id."""
    rows = docs.where(F.col(b.id).isNotNull()).select(F.col(b.id).alias("id"), F.xxhash64(text_col).alias("tag"), F.xxhash64(F.lit(3), text_col).alias("tag2"))
    least = rows.groupBy("tag", "tag2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most")
    # A table of its own, so that adaptive execution can split the join of a hot text.
    return rows.join(checkpoint(least), ["tag", "tag2"]).where("id > least").select(b.number(F.col("id"), F.col("tag")).alias("_bundle"), "id", "tag")


def _copied(t: pa.Table, id_col: str, ids: list, tags: list) -> np.ndarray:
    known = set(zip(ids, tags))
    return np.array([x in known for x in zip(t.column(id_col).to_pylist(), t.column("_tag").to_pylist())], dtype=bool) if known else np.zeros(t.num_rows, dtype=bool)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """A row per input row: the id, n_words, n_removed, kept_text (the kept words, joined by one space).

    Words are runs of anything but ASCII white space, unchanged. Null and empty texts have none. Windows of the same
    document don't count as repeats, nor do those of rows that repeat its id; rows with null ids neither lose words nor
    serve as the smaller id. Other columns are ignored; ids are of any type that sorts.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(id_col, text_col)
    b = Bundles(docs, id_col, text_col)
    block = window // 2
    parts = int(max(b.parts, -(-b.bytes * 4 // (6 * PART_BYTES))))
    copies = checkpoint(_copies(docs, b, text_col))

    def probe(number, t):
        words, at = _words(t, text_col)
        _, _, h, index, twice, bounds = _probes(words, at, block, parts)
        rows = [(p, h[i:j].tobytes(), h[i:j][index[i:j]].tobytes(), h[i:j][twice[i:j]].tobytes()) for p, (i, j) in enumerate(zip(bounds[:-1], bounds[1:])) if j > i]
        cols = {c: pa.array([r[k] for r in rows], pa.binary()) for k, c in enumerate(("probes", "blocks", "twice"), 1)}
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "_bundle": pa.array([number] * len(rows), pa.int32())} | cols)

    def match(key, t):
        raw = t.column("probes").to_pylist()
        probes = np.frombuffer(b"".join(raw), dtype="<u4")
        index = np.unique(np.frombuffer(b"".join(t.column("blocks").to_pylist()), dtype="<u4"))
        out_b, out_p = [], []
        if len(index):
            at = np.searchsorted(index, probes)
            at[at == len(index)] = 0
            hit = index[at] == probes
            again = np.frombuffer(b"".join(t.column("twice").to_pylist()), dtype="<u4")
            again = again[np.isin(again, index)]
            places = np.bincount(at[hit], minlength=len(index)) + np.bincount(np.searchsorted(index, again), minlength=len(index))
            live = hit & (places > 1)[at]
            ends = np.cumsum([len(r) // 4 for r in raw])
            for number, r, end in zip(t.column("_bundle").to_pylist(), raw, ends):
                found = np.flatnonzero(live[end - len(r) // 4 : end])
                if len(found):
                    out_b.append(number)
                    out_p.append(found.astype("<u4").tobytes())
        part = t.column("part")[0].as_py()
        return pa.table({"_bundle": pa.array(out_b, pa.int32()), "part": pa.array([part] * len(out_b), pa.int32()), "hits": pa.array(out_p, pa.binary())})

    probes = b.apply(probe, "part int, _bundle int, probes binary, blocks binary, twice binary")
    hits = probes.groupBy("part").applyInArrow(match, "_bundle int, part int, hits binary")
    nothing = {"part": F.lit(None).cast("int"), "hits": F.lit(None).cast("binary")}
    found = hits.withColumns({"id": F.lit(None).cast(kind), "tag": F.lit(None).cast("long")}).unionByName(copies.withColumns(nothing))

    def extend(number, t, found):
        part, payload = found.column("part").to_pylist(), found.column("hits").to_pylist()
        words, at = _words(t, text_col)
        where, which, hashes, _, _, bounds = _probes(words, at, block, parts)
        hit = np.zeros(len(hashes), dtype=bool)
        for p, x in zip(part, payload):
            if x is not None:
                hit[bounds[p] + np.frombuffer(x, dtype="<u4")] = True
        live = np.zeros(len(words) + 1, dtype=np.int64)
        live[where[hit[which]]] = 1
        rows = row_of(at)
        ids = t.column(id_col).combine_chunks()
        ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
        out = ~np.asarray(ids.is_null().to_numpy(zero_copy_only=False), dtype=bool) & ~_copied(t, id_col, *([v for v in found.column(c).to_pylist()] for c in ("id", "tag")))
        sums = np.concatenate([[0], np.cumsum(live[:-1])])
        ends = np.repeat(at[1:], np.diff(at))
        s = np.flatnonzero((np.arange(len(words)) + window <= ends) & out[rows]) if len(words) else np.zeros(0, dtype=np.int64)
        s = s[sums[s + window - block + 1] > sums[s]]
        if not len(s):
            return pa.table({c: pa.array([], k) for c, k in zip(("a", "b", "id", "_bundle", "place", "run", "more"), (pa.int64(), pa.int64(), ids.type, pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64())))})
        h1, h2 = HASH_A.ranges(words, s, s + window), HASH_B.ranges(words, s, s + window)
        # Rows are in the order of their ids; rows with one id have one number.
        same = pc.fill_null(pc.equal(ids.slice(1), ids.slice(0, len(ids) - 1)), False).to_numpy(zero_copy_only=False).astype(bool)
        doc = np.concatenate([[0], np.cumsum(~same)])[rows[s]]
        order = np.lexsort((s, h2, h1))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        group = np.cumsum(new) - 1
        settled = np.empty(len(order), dtype=bool)
        settled[order] = doc[order] > doc[order][np.flatnonzero(new)][group]
        place = (rows[s].astype(np.int64) << _ROW) | (s - at[rows[s]])
        done = np.flatnonzero(settled)
        breaks = np.ones(len(done), dtype=bool)
        breaks[1:] = np.diff(place[done]) != 1
        first = done[breaks]
        run = np.diff(np.append(np.flatnonzero(breaks), len(done))) if len(done) else np.zeros(0, dtype=np.int64)
        # Of the others, equal windows of one document go as one row with the places of the rest.
        left = ~settled[order]
        open_, group = order[left], group[left]
        lead = np.ones(len(open_), dtype=bool)
        lead[1:] = group[1:] != group[:-1]
        sizes = np.diff(np.append(np.flatnonzero(lead), len(open_))) - 1
        ends_of = np.concatenate([[0], np.cumsum(np.concatenate([sizes, np.zeros(len(first), dtype=np.int64)]))]).astype(np.int32)
        none = np.concatenate([sizes == 0, np.ones(len(first), dtype=bool)])
        more = pa.ListArray.from_arrays(pa.array(ends_of), pa.array(place[open_[~lead]]), mask=pa.array(none))
        open_ = open_[lead]
        spread = mix(place[first].astype(np.uint64) ^ np.uint64(number + 1))
        return pa.table(
            {
                "a": pa.array(np.concatenate([h1[open_], spread]).view(np.int64)),
                "b": pa.array(np.concatenate([h2[open_], mix(spread)]).view(np.int64)),
                "id": ids.take(pa.array(rows[s[np.concatenate([open_, first])]])),
                "_bundle": pa.array(np.full(len(none), number, dtype=np.int32)),
                "place": pa.array(np.concatenate([place[open_], place[first]])),
                "run": pa.array(np.concatenate([np.zeros(len(open_), dtype=np.int64), run]).astype(np.int32)),
                "more": more,
            }
        )

    seen = b.apply_with(found, extend, f"a long, b long, id {kind}, _bundle int, place long, run int, more array<long>")
    least = F.min(F.when(F.col("run") == 0, F.col("id"))).over(Window.partitionBy("a", "b"))
    gone = seen.withColumn("least", least).where("run > 0 or id > least").select("_bundle", "place", F.greatest("run", F.lit(1)).alias("run"), "more")
    nothing = {"place": F.lit(None).cast("long"), "run": F.lit(None).cast("int"), "more": F.lit(None).cast("array<long>")}
    gone = gone.withColumns({"id": F.lit(None).cast(kind), "tag": F.lit(None).cast("long")}).unionByName(copies.withColumns(nothing))

    def cut(number, t, gone):
        copied = _copied(t, id_col, *([v for v in gone.column(c).to_pylist()] for c in ("id", "tag")))
        some = gone.filter(gone.column("place").is_valid())
        more = pc.list_flatten(some.column("more")).to_numpy()
        place = np.concatenate([some.column("place").to_numpy(), more])
        run = np.concatenate([some.column("run").to_numpy(), np.ones(len(more), dtype=np.int64)])
        row, at = place >> _ROW, place & ((1 << _ROW) - 1)
        order = np.argsort(row, kind="stable")
        row, at, run = row[order], at[order], run[order]
        n_words, n_removed, kept = [], [], []
        first = 0
        for first, texts in pieces_of(t, text_col, SLICE_BYTES):
            x = Texts(texts)
            data, edges = x.data.tobytes(), x.offsets
            for i in range(x.rows):
                words = data[edges[i] : edges[i + 1]].split()
                n, r = len(words), first + i
                lo, hi = np.searchsorted(row, [r, r + 1])
                if copied[r] and n >= window:
                    drop = np.ones(n, dtype=bool)
                elif hi > lo:
                    starts = np.concatenate([np.arange(p, p + k) for p, k in zip(at[lo:hi], run[lo:hi])])
                    drop = covered(starts, window, n)
                else:
                    drop = None
                if drop is not None:
                    words = [w for w, d in zip(words, drop.tolist()) if not d]
                n_words.append(n)
                n_removed.append(n - len(words))
                kept.append(b" ".join(words))
        return pa.table({id_col: t.column(id_col), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    return b.apply_with(gone, cut, f"`{id_col}` {kind}, n_words long, n_removed long, kept_text string")
