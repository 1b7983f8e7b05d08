"""Groups of rows for pairwise work, in pieces of bounded size.

A group with at most ``most`` rows is one piece. A larger one is split into parts by a hash, and each pair of parts is a
piece of its own, so that every pair of rows meets in some piece, pieces of one group run on many tasks, and no task
holds more than two parts (about 2 * most rows) at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pieces(rows: DataFrame, key: list[str], member: str, most: int) -> DataFrame:
    """Rows of groups of two or more, with a column ``piece``; sorted by key and piece within partitions."""
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return dealt(rows.join(counts, key), key, member, most)


def dealt(rows: DataFrame, key: list[str], member: str, most: int) -> DataFrame:
    """The same for rows that have their group's size in ``_n``."""
    parts = F.ceil(F.col("_n") / F.lit(most)).cast("int")
    known = rows.withColumn("_parts", parts).withColumn("_own", F.pmod(F.xxhash64(F.lit(5), member), "_parts").cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda j: F.least("_own", j).cast("long") * F.lit(1 << 31) + F.greatest("_own", j))
    others = F.when(F.col("_parts") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array_except(others, F.array(F.col("_own").cast("long") * F.lit((1 << 31) + 1))))
    out = known.withColumn("piece", F.explode(others)).drop("_n", "_own", "_parts")
    return out.repartition(*key, "piece").sortWithinPartitions(*key, "piece")


def streamed(batches: Iterator[pa.RecordBatch], key: list[str], work: Callable[[pa.RecordBatch, np.ndarray], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Calls ``work`` with sorted rows that hold whole groups only, and the offsets of the groups; a batch's last group waits for the next."""
    wait: list[pa.RecordBatch] = []

    def bounds(b: pa.RecordBatch) -> np.ndarray:
        change = np.zeros(b.num_rows, dtype=bool)
        change[0] = True
        for k in key:
            v = b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    def whole() -> pa.RecordBatch:
        return wait[0] if len(wait) == 1 else pa.Table.from_batches(wait).combine_chunks().to_batches()[0]

    for b in batches:
        if not b.num_rows:
            continue
        at = bounds(b)
        if wait:
            last, same = wait[-1].slice(wait[-1].num_rows - 1, 1), True
            for k in key:
                i = b.schema.get_field_index(k)
                same &= last.column(i)[0].as_py() == b.column(i)[0].as_py()
            cut = (int(at[1]) if len(at) > 1 else b.num_rows) if same else 0
            if cut:
                wait.append(b.slice(0, cut))
            if cut == b.num_rows:
                continue
            got = whole()
            wait = []
            yield from work(got, np.append(bounds(got), got.num_rows))
            b, at = b.slice(cut), at[at >= cut] - cut
        if at[-1]:
            yield from work(b.slice(0, int(at[-1])), at)
        wait = [b.slice(int(at[-1]))]
    if wait:
        got = whole()
        yield from work(got, np.append(bounds(got), got.num_rows))


class Forest:
    """Union-find over n items; ``label`` is kept flat, so that many pairs are tested at once."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins the pairs (a[i], b[i]); only those that join two trees are kept as links."""
        apart = self.label[a] != self.label[b]
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while x in up:
                if up[x] in up:
                    up[x] = up[up[x]]
                x = up[x]
            return x

        for i, j, x, y in zip(a.tolist(), b.tolist(), self.label[a].tolist(), self.label[b].tolist()):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                self.links.append((i, j))
        if up:
            old = np.array(list(up))
            new = np.array([find(x) for x in up])
            table = np.arange(len(self.label))
            table[old] = new
            self.label = table[self.label]
