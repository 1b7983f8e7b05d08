"""Packing token sequences by Karmarkar-Karp multiway differencing.

Each task packs the documents that it reads: no shuffle. The documents that fit a window are gathered in groups and stay
whole. A group is divided over as few windows as its tokens need by multiway differencing: partial partitions, each with
a part for every window, start with one document each; the two with the largest spreads are merged with the largest
parts of one on the smallest of the other, until one partition with near-equal windows is left. While windows are over
capacity their count rises by one, and their documents are divided again. Only documents longer than a window are cut: pieces of them fill
the room that is left, and what remains makes full windows. Windows that still have room wait for the next group with
their documents, the better half of a group's excepted, and go out at the task's end.
"""

from __future__ import annotations

import heapq
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import slices
from .tokens import encoder

#: The room of a window, as a share, that is padded at once; windows' worth of long documents that wait to fill room.
SLACK, RESERVE = 0.01, 16
SCHEMA = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Item numbers of k parts with near-equal sums, by Karmarkar-Karp differencing."""
    if k <= 1 or len(sizes) <= k:
        return [[i for i in range(len(sizes))]] if k <= 1 else [[i] for i in range(len(sizes))] + [[] for _ in range(k - len(sizes))]
    # A partition: its sums above its least, in falling order, with the items of each part.
    heap, parts = [], {}
    for i, size in enumerate(sizes):
        heap.append((-size, i))
        parts[i] = (np.array([size], dtype=np.int64), [[i]])  # the other k - 1 parts are empty
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (x, xs), (y, ys) = parts.pop(a), parts.pop(b)
        if len(x) + len(y) <= k:  # nothing meets
            sums, items = np.concatenate([x, y]), xs + ys
        else:
            sums = np.zeros(k, dtype=np.int64)
            sums[: len(x)] = x
            sums[k - len(y) :] += y[::-1]
            items = [xs[i] if i < len(xs) else [] for i in range(k)]
            for i in range(len(ys)):
                at = k - 1 - i
                items[at] = items[at] + ys[i] if items[at] else ys[i]
        order = np.argsort(-sums, kind="stable")
        sums, items = sums[order], [items[i] for i in order]
        if len(sums) == k:
            sums = sums - sums[-1]
        parts[made] = (sums, items)
        heapq.heappush(heap, (-int(sums[0]), made))
        made += 1
    items = parts[heap[0][1]][1]
    return items + [[] for _ in range(k - len(items))]


def whole_windows(sizes: list[int], size: int) -> list[list[int]]:
    """Item numbers of windows of at most ``size``: the fewest to begin with; those that are over are divided again over one more."""
    out, items, k = [], list(range(len(sizes))), -(-sum(sizes) // size)
    while items:
        parts = [[items[i] for i in p] for p in differencing([sizes[i] for i in items], k)]
        over = [p for p in parts if sum(sizes[i] for i in p) > size]
        out += [p for p in parts if p and sum(sizes[i] for i in p) <= size]
        items, k = sorted(i for p in over for i in p), len(over) + 1
    return out


def pack_group(short: list[tuple[int, int]], long: deque, size: int, last: bool) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int]]]:
    """Windows of (document, start, length), and the short documents left for the next group (none if ``last``).

    ``short``: (document, length); ``long``: (document, start, length) of what is left of long documents, taken from its front."""
    reserve = sum(x[2] for x in long)

    def take(room: int) -> list[tuple[int, int, int]]:
        nonlocal reserve
        out = []
        while room and long:
            doc, start, length = long.popleft()
            n = min(length, room)
            out.append((doc, start, n))
            if n < length:
                long.appendleft((doc, start + n, length - n))
            room, reserve = room - n, reserve - n
        return out

    windows = []
    for part in whole_windows([n for _, n in short], size):
        window = [(short[i][0], 0, short[i][1]) for i in part]
        windows.append((size - sum(x[2] for x in window), window))
    windows.sort(key=lambda w: w[0])
    full, left = [], []
    for i, (room, window) in enumerate(windows):
        if not last and room > reserve and room > size * SLACK and 2 * i >= len(windows):
            left += [(doc, n) for doc, _, n in window]
        else:
            full.append(window + take(room))
    while reserve >= (size if last else size * (RESERVE + 1)):
        full.append(take(size))
    if last and reserve:
        full.append(take(size))
    return full, left


def pack(docs: DataFrame, vocabulary: str, end_id: int, size: int = 2048, lower: bool = False, group: int = 128, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    A document is its whole text's ids and the end id; null and empty texts are the end id alone. Every id lies in one
    piece, and a document of at most ``size`` ids is one piece. Repeated rows are packed each by itself; an empty table
    has no pieces. Other columns are ignored. Sequence numbers are unique: the task's number times 2**32, and a count.
    Memory holds one group of documents, what waits of long ones, and one slice.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, sequence = encoder(vocabulary, lower), TaskContext.get().partitionId() << 32
        known: dict[int, tuple] = {}  # document number: its id, its ids
        short: list[tuple[int, int]] = []
        long: deque = deque()
        out: list[tuple] = []
        n = 0

        def flush(last: bool):
            nonlocal short, sequence
            full, short = pack_group(short, long, size, last)
            for window in full:
                at = 0
                for i, start, length in window:
                    doc, ids = known[i]
                    piece = ids[4 * start : 4 * (start + length)]
                    out.append((doc, start, length, zlib.crc32(piece), len(ids) // 4, sequence, at, *([piece] if with_ids else [])))
                    at += length
                sequence += 1
            left = {x[0] for x in short} | {x[0] for x in long}
            for i in [i for i in known if i not in left]:
                del known[i]

        def table() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[] for _ in range(len(names) + with_ids)]
            arrays = [pa.array(cols[0], type=id_type), *(pa.array(c, pa.int64()) for c in cols[1:7]), *([pa.array(cols[7], pa.binary())] if with_ids else [])]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names + ["ids"] * with_ids)

        for b in slices(batches, "text"):
            id_type = b.column(0).type
            for doc, ids in zip(b.column(0).to_pylist(), code.encode([t or "" for t in b.column(1).to_pylist()])):
                ids += end
                total = len(ids) // 4
                known[n] = doc, ids
                if total > size:
                    long.append((n, 0, total))
                else:
                    short.append((n, total))
                n += 1
                if len(short) >= group or sum(x[2] for x in long) > 4 * RESERVE * size:
                    flush(False)
            if out:
                yield table()
        if short or long:
            flush(True)
            yield table()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA.format(kind=kind) + ", ids binary" * with_ids)
