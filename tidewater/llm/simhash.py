"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint bit is the majority of that bit over the hashes of a text's shingles. Fingerprints within ``radius`` bits
agree on at least two of radius + 2 bands, so they meet in a group keyed by a pair of bands. Inside a group the
fingerprints are stored vertically, as 64 bit planes; for each distance in the sorted group the planes are compared with
themselves shifted, the differing bits of all pairs at once are added into carry-save counters of bit planes, and words of
64 pairs are abandoned once every pair in them is over the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Forest, pieces, streamed
from .components import components
from .shared import checkpoint
from .textkernel import Texts, slices

RADIUS, SEED = 3, 42
#: Rows of a group that are compared in one piece.
MOST = 4096
#: Groups up to this size are compared together, as one block.
SMALL = 16
#: Hashes whose bits are counted side by side.
MOST_BITS = 1 << 16

_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def fingerprints(column: pa.Array, shingle: int = 3, seed: int = SEED) -> np.ndarray:
    """Fingerprints of texts: ASCII lower case, words between ASCII white space, shingles joined by one space, XXH64."""
    t = Texts(column)
    data, at = t.data.tobytes().translate(_LOWER), t.offsets
    hashes: list[int] = []
    ends = np.zeros(t.rows + 1, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for r in range(t.rows):
        words = data[at[r] : at[r + 1]].split()
        n = len(words)
        if n > shingle:
            line, stops = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
            stop = (stops[shingle - 1 :] - 1).tolist()
            begin = [0, *stops[: n - shingle].tolist()]
            hashes.extend([digest(line[i:j], seed) for i, j in zip(begin, stop)])
        elif n:
            hashes.append(digest(b" ".join(words), seed))
        ends[r + 1] = len(hashes)
    return majority(np.array(hashes, dtype=np.uint64), ends)


def majority(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each range of hashes the bits set in over half of them; zero for an empty one."""
    out, count = np.zeros(len(offsets) - 1, dtype=np.uint64), np.diff(offsets)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    if len(hashes) <= MOST_BITS:
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, offsets[some], axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * ones > count[some, None], axis=1).reshape(-1).view(">u8")
    else:  # bit by bit, in little memory
        for b in range(64):
            ones = np.add.reduceat((hashes >> np.uint64(b)) & np.uint64(1), offsets[some])
            out[some] |= (2 * ones.astype(np.int64) > count[some]).astype(np.uint64) << np.uint64(b)
    return out


def planes(prints: np.ndarray) -> np.ndarray:
    """64 rows of packed bits, one lane per fingerprint, with a word of room at the end."""
    bits = np.unpackbits(prints.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    lanes = -(-len(prints) // 64) * 64 + 64
    wide = np.zeros((64, lanes), dtype=np.uint8)
    wide[:, : len(prints)] = bits.T
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


def close_pairs(sliced: np.ndarray, n: int, step: int, allowed: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Lanes i for which i and i + step are allowed and differ in at most ``radius`` bits."""
    words, bits = divmod(step, 64)
    count = (n - step + 63) // 64
    low = sliced[:, words : words + count]
    if bits:
        low = (low >> np.uint64(bits)) | (sliced[:, words + 1 : words + 1 + count] << np.uint64(64 - bits))
    differ = sliced[:, :count] ^ low
    # The counters hold as many bit planes as radius + 1 takes, and start so that the one after ``radius`` carries out of them.
    size = (radius + 1).bit_length()
    start = (1 << size) - 1 - radius
    plane = [np.full(count, 0xFFFFFFFFFFFFFFFF if start >> k & 1 else 0, dtype=np.uint64) for k in range(size)]
    over, at = np.zeros(count, dtype=np.uint64), np.arange(count)
    for b in range(64):
        carry = differ[b]
        for k in range(size):
            plane[k], carry = plane[k] ^ carry, plane[k] & carry
        over |= carry
        if b % 8 == 7:  # words of 64 lanes that are all over are left
            live = np.flatnonzero(allowed[at] & ~over)
            if not len(live):
                return live
            if 2 * len(live) <= len(at):
                at, over, differ, plane = at[live], over[live], differ[:, live], [x[live] for x in plane]
    found = np.zeros(count, dtype=np.uint64)
    found[at] = allowed[at] & ~over
    return np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little", count=n - step))


def near_lanes(prints: np.ndarray, group: np.ndarray, widest: int, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the close fingerprints within runs of one group, distance by distance; ``widest``: the rows of the largest run."""
    n, sliced = len(prints), planes(prints)
    for step in range(1, widest):
        same = group[:-step] == group[step:]
        if not same.any():
            break
        room = np.zeros(-(-(n - step) // 64) * 64, dtype=np.uint8)
        room[: n - step] = same
        hit = close_pairs(sliced, n, step, np.packbits(room, bitorder="little").view("<u8"), radius)
        if len(hit):
            yield hit, hit + step


def linked(prints: np.ndarray, offsets: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Spanning links within the groups of fingerprints: enough of the close pairs to join all that they join."""
    out: list[tuple[int, int]] = []
    sizes = np.diff(offsets)

    def block(who: np.ndarray, group: np.ndarray, widest: int):
        forest, trees = Forest(len(who)), int((group[1:] != group[:-1]).sum()) + 1
        for i, j in near_lanes(prints[who], group, widest, radius):
            forest.add(i, j)
            if len(forest.links) == len(who) - trees:  # each group is one tree already
                break
        out.extend((int(who[i]), int(who[j])) for i, j in forest.links)

    groups = np.repeat(np.arange(len(sizes)), sizes)
    small = sizes[groups] <= SMALL
    if small.any():
        block(np.flatnonzero(small), groups[small], SMALL)
    for g in np.flatnonzero(sizes > SMALL):
        who = np.arange(offsets[g], offsets[g + 1])
        block(who, np.zeros(len(who), dtype=np.int64), len(who))
    return out


def links(distinct: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``print``) within the radius, enough to span their components."""
    bands = radius + 2
    edges = [64 * i // bands for i in range(bands + 1)]
    mask = [((1 << edges[i + 1]) - 1) & ~((1 << edges[i]) - 1) for i in range(bands)]
    long = lambda x: F.lit(x - (1 << 64) if x >> 63 else x)
    keys = [F.struct(F.lit(k).alias("table"), F.col("print").bitwiseAND(long(mask[i] | mask[j])).alias("band")) for k, (i, j) in enumerate(combinations(range(bands), 2))]
    rows = distinct.select("print", F.explode(F.array(*keys)).alias("key")).select("key.table", "key.band", "print")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(b: pa.RecordBatch, at: np.ndarray) -> Iterator[pa.RecordBatch]:
            prints = b.column(b.schema.get_field_index("print")).to_numpy(zero_copy_only=False).view(np.uint64)
            found = linked(prints, at, radius)
            if found:
                i, j = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(prints[i].view(np.int64)), pa.array(prints[j].view(np.int64))], names=["a", "b"])

        yield from streamed(batches, ["table", "band", "piece"], work)

    return pieces(rows, ["table", "band"], "print", most).mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """A row per input row: the id, print (long), component_id (the least id among the texts that links reach).

    Null and empty texts have the fingerprint zero and link like any other. Null ids are passed over for the least id; a
    component of null ids alone has a null component_id. Repeated rows share their component. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(b.column(1), shingle).view(np.int64))], names=["id", "print"])

    prints = checkpoint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, print long"))
    least = prints.groupBy("print").agg(F.min("id").alias("least"))
    classes = checkpoint(least)
    found = components(links(classes.select("print"), radius))
    named = classes.join(found.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("component", "print"))
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = named.join(best, "root").select("print", "component_id")
    return prints.join(known, "print").select(F.col("id").alias(id_col), "print", "component_id")


def hexadecimal(col: str):
    """16 lower-case hex digits of a long."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))
