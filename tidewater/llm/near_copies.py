"""SimHash near copies at a wide radius: for texts of a given similarity of word shingles, verified by exact Jaccard.

At the threshold 0.8 two texts' fingerprints differ in 10 bits on average and in over 22 with a chance of one in 10,000,
too many for groups by pairs of the fingerprint's bands. So the groups come from the least shingle hashes: sets of
similarity s share a given band of ``ROWS`` minima with probability s ** ROWS, and of pairs at 0.8 one in 300,000 shares
none of ``BANDS`` bands. Sets that share bands, in chains, form a bundle; a text travels once, to its bundle, where the
sets and fingerprints are made again. The fingerprints of a band's group are compared bit-sliced, with carry-save
counters, and the sets of those within the radius in full. What links join after that are the near copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Forest, pieces, streamed
from .components import components
from .shared import checkpoint
from .simhash import majority, near_lanes
from .textkernel import HASH_B, Items, Texts, mix, signed, slices, windows

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, RADIUS = 24, 4, 22
#: Texts of a bundle that are compared in one piece.
MOST = 1024

_U = np.uint64
_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], dtype=np.uint8)
_XOR = mix(np.arange(BANDS * ROWS, dtype=np.uint64) + _U(7001))
_ODD = mix(np.arange(BANDS * ROWS, dtype=np.uint64) + _U(9001)) | _U(1)


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's shingles, and the offsets of the texts.

    Words are ASCII lower case, between ASCII white space; a text of fewer words than a shingle is one shingle.
    """
    t = Texts(column)
    starts, ends, at = t.words()
    words = Items(_LOWER[t.data], starts).hashes(ends)
    n = np.diff(at)
    where, hashes = windows(words, at, shingle, HASH_B)
    short = np.flatnonzero((n > 0) & (n < shingle))
    rows = np.concatenate([np.searchsorted(at, where, side="right") - 1, short])
    hashes = np.concatenate([hashes, HASH_B.ranges(words, at[short], at[short + 1])])
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[first], np.searchsorted(rows[first], np.arange(t.rows + 1))


def names(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, zero for the empty one."""
    out = np.zeros(len(offsets) - 1, dtype=np.uint64)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = mix(np.add.reduceat(mix(hashes ^ _U(77)), offsets[some]) + np.diff(offsets)[some].astype(np.uint64))
    return signed(out)


def bands(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a set that isn't empty, and their band keys."""
    some = np.flatnonzero(np.diff(offsets))
    keys = np.zeros((len(some), BANDS), dtype=np.uint64)
    if len(some):
        for k in range(BANDS * ROWS):
            least = np.minimum.reduceat((hashes ^ _XOR[k]) * _ODD[k], offsets[some])
            keys[:, k // ROWS] = mix(keys[:, k // ROWS] + least + _U(k))
    return some, keys


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return both / (len(a) + len(b) - both)


def linked(sets: list[np.ndarray], prints: np.ndarray, keys: np.ndarray, similarity: float = SIMILARITY, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Spanning links between sets that share a band key, have fingerprints within the radius, and are similar."""
    forest, size = Forest(len(sets)), np.array([len(s) for s in sets])
    tried: set[tuple[int, int]] = set()
    for band in keys.T:
        order = np.argsort(band, kind="stable")
        new = np.append(True, band[order][1:] != band[order][:-1])
        group, widest = np.cumsum(new), int(np.diff(np.append(np.flatnonzero(new), len(order))).max(initial=1))
        for x, y in near_lanes(prints[order], group, widest, radius):
            x, y = order[x], order[y]
            ok = (forest.label[x] != forest.label[y]) & (np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]))
            for i, j in zip(x[ok].tolist(), y[ok].tolist()):
                pair = (i, j) if i < j else (j, i)
                if pair in tried or forest.label[i] == forest.label[j]:
                    continue
                tried.add(pair)
                if jaccard(sets[i], sets[j]) >= similarity:
                    forest.add(np.array([i]), np.array([j]))
            if len(forest.links) == len(sets) - 1:
                return forest.links
    return forest.links


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, most: int = MOST) -> DataFrame:
    """A row per input row with an id: the id, node (long, the name of its set), component_id (the least id among the texts that links reach).

    Texts without words (null ones too) are equal to each other. Repeated rows share their component. Rows without an
    id, and other columns, are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            hashes, at = shingle_sets(b.column(1), shingle)
            some, keys = bands(hashes, at)
            ends = np.zeros(b.num_rows + 1, dtype=np.int32)
            ends[some + 1] = BANDS
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(signed(keys.reshape(-1))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names(hashes, at)), lists], names=["id", "node", "bands"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(b: pa.RecordBatch, at: np.ndarray) -> Iterator[pa.RecordBatch]:
            column = lambda name: b.column(b.schema.get_field_index(name))
            node, text, keys = column("node").to_numpy(zero_copy_only=False), column("text"), column("bands")
            out: list[tuple[int, int]] = []
            for begin, end in zip(at[:-1].tolist(), at[1:].tolist()):
                hashes, of = shingle_sets(text.slice(begin, end - begin), shingle)
                # An id may have several texts; the one that was named stays.
                own = np.flatnonzero(names(hashes, of) == node[begin:end])
                key = keys.slice(begin, end - begin).flatten().to_numpy(zero_copy_only=False).reshape(end - begin, -1)[own]
                for i, j in linked([hashes[of[r] : of[r + 1]] for r in own.tolist()], majority(hashes, of)[own], key, similarity):
                    out.append((int(node[begin + own[i]]), int(node[begin + own[j]])))
            if out:
                a, c = np.array(out, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], names=["a", "b"])

        yield from streamed(batches, ["component", "piece"], work)

    marks = checkpoint(texts.mapInArrow(mark, f"id {kind}, node long, bands array<long>"))
    classes = checkpoint(marks.groupBy("node").agg(F.min("id").alias("least"), F.first("bands").alias("bands")))
    meet = classes.select("node", F.explode("bands").alias("key")).withColumn("first", F.min("node").over(Window.partitionBy("key")))
    bundle = components(meet.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")))
    members = classes.join(bundle, "node").select("component", "node", "bands", F.col("least").alias("id"))
    rows = checkpoint(texts.join(members, "id").select("component", "node", "bands", "text"))
    found = components(pieces(rows, ["component"], "node", most).mapInArrow(compare, "a long, b long"))
    named = classes.select("node", "least").join(found, "node", "left").withColumn("root", F.coalesce("component", "node"))
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = named.join(best, "root").select("node", "component_id")
    return marks.select("id", "node").join(known, "node").select(F.col("id").alias(id_col), "node", "component_id")
