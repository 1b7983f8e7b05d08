"""Line dedup with a segment-partition edit join.

Lines within reach of each other are one class, and so are lines that such links join; of a class only the first line of
the corpus, by document id and place, stays. In reach are lines with at most ``radius`` edits between them, and at most
one for each ``POINTS`` code points of the shorter one. A line is split into as many segments as the edits in its reach
and one more, so any line in reach holds one of them unchanged, at a place that the lengths bound: segments are indexed
under (line length, segment number, segment), and lines probe the indexes of their own and the shorter lengths with the
few substrings that the bounds allow. Lines that meet are verified with a banded bit-parallel edit distance.

Many lines may hold one segment (a template's), and few of them be in reach. In such a group the segment is taken out of
the lines, and so is what all that is left begins and ends with; edits can only be in the rest, which is split as the
lines were, until groups are small. Equal lines are settled by two hashes first: one bundle of documents owns a line,
and only there it is split.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Forest, dealt, streamed
from .bundles import Bundles
from .components import components
from .shared import checkpoint

#: Edits at most, and the code points of the shorter line for each of them.
RADIUS, POINTS = 2, 10
#: Lines of a group that are verified in one piece; larger groups are split again, so many times.
MOST, AGAIN = 256, 16
_BLANK = " \t\n\v\f\r"
_ROW, _MASK = 32, (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_key(line: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(line)
    return _signed(h >> 64), _signed(h & ((1 << 64) - 1))


def reach(length: int, radius: int = RADIUS) -> int:
    """Edits that a line of a length may have to a line that isn't shorter."""
    return min(radius, length // POINTS)


def segments(length: int, n: int) -> list[tuple[int, int]]:
    """(start, size) of the n segments of a line, the longer ones last."""
    short, extra = divmod(length, n)
    out, at = [], 0
    for i in range(n):
        size = short + (i >= n - extra)
        out.append((at, size))
        at += size
    return out


@lru_cache(maxsize=8192)
def places(n: int, radius: int, points: int) -> list[tuple[int, int, int, bool]]:
    """(seed, start, end, whether it is an index entry) of the segments of a line of n code points, its own and those that
    it probes for, of its length and the shorter ones: where a segment can be if those before it have its number of edits
    at most. A line of m has ``radius`` edits in reach, and at most one for each ``points`` of m (0: any)."""
    out = []
    for shift in range(min(radius, n) + 1):
        m = n - shift
        r = min(radius, m // points) if points else radius
        if r < max(shift, 1):  # lines within no edits are equal
            continue
        for i, (start, size) in enumerate(segments(m, r + 1)):
            low = max(0, start - i, start + shift - (r - i))
            high = min(n - size, start + i, start + shift + (r - i))
            out += [(m * 16 + i, at, at + size, shift == 0 and at == start) for at in range(low, high + 1)]
    return out


def keys(line: str, radius: int, points: int = POINTS, salt: int = 0) -> Iterator[tuple[int, bool]]:
    """(key, whether it is an index entry) of a line, for each of its places."""
    raw = line.encode()
    plain, salt = len(raw) == len(line), salt & _MASK
    for seed, i, j, own in places(len(line), radius, points):
        yield _signed(xxhash.xxh64_intdigest(raw[i:j] if plain else line[i:j].encode(), seed ^ salt)), own


def _same(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def within(a: str, b: str, radius: int) -> bool:
    """Whether at most ``radius`` edits lead from a to b; a bit for each of the 2 * radius + 1 diagonals, a vector for each number of edits."""
    if abs(len(a) - len(b)) > radius:
        return False
    k = _same(a, b)
    a, b = a[k:], b[k:]
    k = _same(a[::-1], b[::-1])
    if k:
        a, b = a[:-k], b[:-k]
    if not a or not b:
        return max(len(a), len(b)) <= radius
    width = 2 * radius + 1
    full = (1 << width) - 1
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << (i + radius)  # bit t of the shifted mask stands for a[j - radius + t]
    reach = [((1 << (e + 1)) - 1) << radius for e in range(radius + 1)]  # bit t: prefix of a of length j - radius + t
    for j, c in enumerate(b):
        match = (places.get(c, 0) >> j) & full
        new = [reach[0] & match]
        for e in range(1, radius + 1):
            new.append(((reach[e] & match) | reach[e - 1] | reach[e - 1] >> 1 | new[e - 1] << 1) & full)
        reach = new
        if not any(reach):
            return False
    return bool(reach[radius] >> (len(a) - len(b) + radius) & 1)


def verify(lines: list[str], index: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Spanning links among lines that share a key: pairs with an index entry on one side, in reach of each other."""
    n = len(lines)
    forest, size = Forest(n), np.fromiter(map(len, lines), np.int64, n)
    reaches = np.minimum(radius, size // POINTS)
    counts = np.zeros((n, 32), dtype=np.int32)
    if n > 8:  # each edit changes two letter counts at most
        for i, line in enumerate(lines):
            counts[i] = np.bincount(np.fromiter(map(ord, line), np.int64, len(line)) & 31, minlength=32)
    for i in range(n - 1):
        rest = np.arange(i + 1, n)
        near = np.minimum(reaches[rest], reaches[i])
        ok = (index[i] | index[rest]) & (np.abs(size[rest] - size[i]) <= near) & (forest.label[rest] != forest.label[i])
        rest, near = rest[ok], near[ok]
        if n > 8:
            ok = np.abs(counts[rest] - counts[i]).sum(axis=1) <= 2 * near
            rest, near = rest[ok], near[ok]
        for j, r in zip(rest.tolist(), near.tolist()):
            if forest.label[i] != forest.label[j] and within(lines[i], lines[j], r):
                forest.add(np.array([i]), np.array([j]))
        if len(forest.links) == n - 1:
            break
    return forest.links


def _rows(t: pa.Table, text: str) -> Iterator[tuple[int, int, str]]:
    """(row, line number, line) of the lines that are not blank."""
    for r, x in enumerate(t.column(text).to_pylist()):
        for k, line in enumerate((x or "").split("\n")):
            if line.strip(_BLANK):
                yield r, k, line


def _firsts(t: pa.Table, text: str) -> dict[tuple[int, int], tuple[int, int, str]]:
    """The first place in a bundle of each different line."""
    out: dict[tuple[int, int], tuple[int, int, str]] = {}
    for r, k, line in _rows(t, text):
        out.setdefault(line_key(line.encode()), (r, k, line))
    return out


def _meetings(rows: DataFrame) -> DataFrame:
    """(key, h, own, _bundle, _n) of the lines that meet others under a key with an index entry, of the rows (key, h, mark)."""
    same = Window.partitionBy("key")
    met = rows.withColumns({"lo": F.min("h").over(same), "hi": F.max("h").over(same), "some": F.max(F.col("mark") % 2).over(same)}).where("lo <> hi and some = 1")
    met = met.groupBy("key", "h").agg(F.max(F.col("mark") % 2).alias("own"), F.min(F.shiftright("mark", 1)).cast("int").alias("_bundle"))
    return checkpoint(met.withColumn("_n", F.count(F.lit(1)).over(same)))


def _without(rest: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """The ranges without those that hold their positions start to end, counted along them."""
    out, at = [], 0
    for i, j in rest:
        low, high = i + min(max(start - at, 0), j - i), i + min(max(end - at, 0), j - i)
        out += [x for x in ((i, low), (high, j)) if x[0] < x[1]]
        at += j - i
    return out


def _flat(ranges: list[tuple[int, int]]) -> list[int]:
    return [x for i, j in ranges for x in (i, j)]


def _ranges(flat: list[int]) -> list[tuple[int, int]]:
    return list(zip(flat[::2], flat[1::2]))


def _text(line: str, ranges: list[tuple[int, int]]) -> str:
    return "".join([line[i:j] for i, j in ranges])


#: A line in a group: ``rest``, the ranges of it that edits can be in; ``r``, the edits in reach (0: by its length); ``salt``, of the keys.
_HOT = "key long, h long, own long, line string, rest array<int>, r int, salt long"
#: A line without what its group's key is made of: ``text`` is what is left.
_LEFT = "key long, h long, line string, rest array<int>, r int, text string"


def _left(rows: Iterable[tuple], radius: int) -> list[tuple]:
    """Rows of _LEFT, of (key, h, line, rest, r, salt)."""
    out = []
    for key, h, line, rest, r, salt in rows:
        rest = _ranges(rest)
        text, points = _text(line, rest), 0 if r else POINTS
        for (seed, i, j, _), (k, _) in zip(places(len(text), r or radius, points), keys(text, r or radius, points, salt)):
            if k == key:
                left = _without(rest, i, j)
                out.append((key, h, line, _flat(left), r or reach(seed // 16, radius), _text(line, left)))
    return out


def _finer(left: DataFrame, radius: int) -> DataFrame:
    """The lines of large groups again, under the keys of what is left of them. ``own`` is 2 where all is in reach."""

    def columns(t: pa.RecordBatch, *names: str):
        return zip(*[t.column(t.schema.get_field_index(c)).to_pylist() for c in names])

    def batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    hot_schema = pa.schema([("key", pa.int64()), ("h", pa.int64()), ("own", pa.int64()), ("line", pa.string()), ("rest", pa.list_(pa.int32())), ("r", pa.int32()), ("salt", pa.int64())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, line, rest, r, text, lo, hi, back_lo, back_hi, least in columns(b, "h", "line", "rest", "r", "text", "lo", "hi", "back_lo", "back_hi", "least"):
                begin = _same(lo, hi)
                end = len(text) - min(_same(back_lo, back_hi), least - begin)
                rest = _without(_without(_ranges(rest), end, len(text)), 0, begin)
                text, at, fixed = text[begin:end], 0, []
                for i, j in [*rest, (len(line), len(line))]:
                    fixed.append(line[at:i])
                    at = j
                salt = _signed(xxhash.xxh64_intdigest("".join(fixed).encode(), r))
                row = line, _flat(rest), r, salt
                out += [(k, h, int(own), *row) for k, own in keys(text, r, 0, salt)]
                if len(text) <= r:
                    out.append((salt, h, 2, *row))
            yield batch(out, hot_schema)

    edges = left.groupBy("key").agg(F.min("text").alias("lo"), F.max("text").alias("hi"), F.min(F.reverse("text")).alias("back_lo"), F.max(F.reverse("text")).alias("back_hi"), F.min(F.char_length("text")).alias("least"))
    rows = left.join(edges, "key").mapInArrow(split, _HOT)
    rows = rows.groupBy("key", "h", "rest").agg(F.max("own").alias("own"), F.first("line").alias("line"), F.first("r").alias("r"), F.first("salt").alias("salt"))
    facts = rows.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.max("own").alias("some"), F.count(F.lit(1)).alias("_n")).where("lo <> hi and some > 0")
    return checkpoint(rows.join(facts, "key").select("key", "h", "own", "line", "rest", "r", "salt", "_n", "lo", "some"))


def line_links(b: Bundles, owners: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """(a, b): links between the hashes of different lines in reach, enough to span their classes. ``owners``: (h, _bundle)."""
    text = b.text
    left_schema = pa.schema([("key", pa.int64()), ("h", pa.int64()), ("line", pa.string()), ("rest", pa.list_(pa.int32())), ("r", pa.int32()), ("text", pa.string())])

    def entries(number, t, wanted):
        want, key, h, mark = set(wanted.column("h").to_pylist()), [], [], []
        for (x, _), (_, _, line) in _firsts(t, text).items():
            if x in want:
                for k, own in keys(line, radius):
                    key.append(k)
                    h.append(x)
                    mark.append(2 * number + own)
        return pa.table({"key": pa.array(key, pa.int64()), "h": pa.array(h, pa.int64()), "mark": pa.array(mark, pa.int64())})

    def fetch(number, t, wanted):
        h = wanted.column("h").to_pylist()
        want = set(h)
        found = {x: line for (x, _), (_, _, line) in _firsts(t, text).items() if x in want} if want else {}
        return pa.table({c: wanted.column(c) for c in ("key", "h", "own", "_n")} | {"line": pa.array([found[x] for x in h], pa.string())})

    def left_of(rows: Iterable[tuple]) -> pa.Table:
        out = _left(rows, radius)
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(left_schema), left_schema)], schema=left_schema)

    def fetch_left(number, t, wanted):
        # One Python worker does both: each further one of a task stays with the executor, with all it has imported.
        got = fetch(number, t, wanted)
        return left_of((key, h, line, [0, len(line)], 0, 0) for key, h, line in zip(*(got.column(c).to_pylist() for c in ("key", "h", "line"))))

    def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            yield from left_of(zip(*(t.column(t.schema.get_field_index(c)).to_pylist() for c in ("key", "h", "line", "rest", "r", "salt")))).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(batch: pa.RecordBatch, at: np.ndarray) -> Iterator[pa.RecordBatch]:
            col = lambda c: batch.column(batch.schema.get_field_index(c))
            h, own, found = col("h").to_pylist(), col("own").to_numpy().astype(bool), []
            texts = col("line").to_pylist()
            for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                if j - i > 1:
                    found += [(h[i + x], h[i + y]) for x, y in verify(texts[i:j], own[i:j], radius)]
            if found:
                x, y = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

        yield from streamed(batches, ["key", "piece"], work)

    def verified(rows: DataFrame) -> DataFrame:
        return dealt(rows.select("key", "h", "own", "_n", "line"), ["key"], "h", most).mapInArrow(run, "a long, b long")

    met = _meetings(b.apply_with(owners, entries, "key long, h long, mark long"))
    fetched = "key long, h long, own long, _n long, line string"
    out = verified(b.apply_with(met.where(F.col("_n") <= most), fetch, fetched))
    large = met.where(F.col("_n") > most)
    if large.isEmpty():
        return out
    left = b.apply_with(large, fetch_left, _LEFT)
    for step in range(AGAIN):
        found = _finer(left, radius)
        out = out.unionByName(found.where("own = 2 and h <> lo").select(F.col("h").alias("a"), F.col("lo").alias("b")))
        found = found.where("some = 1")
        last = step == AGAIN - 1
        out = out.unionByName(verified(found if last else found.where(F.col("_n") <= most)))
        hot = found.where(F.col("_n") > most)
        if last or hot.isEmpty():
            break
        left = hot.mapInArrow(take_out, _LEFT)
    return out


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """The rows again, their texts without the lines that are not the first of their class, and n_lines, n_removed (long).

    Lines are separated by line feeds; lines of white space are not lines here and stay. First means by id (nulls last;
    ids of any type that sorts), then by bundle and a hash of the text, then by place. A null text stays null, and a text
    that loses all its lines is empty. All columns are kept, but for those named n_lines, n_removed, _tag or _bundle.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("n_lines", "n_removed", "_tag", "_bundle")])
    b = Bundles(docs, id_col, text_col)
    names, kind = docs.columns, docs.schema[id_col].dataType.simpleString()

    def occur(number, t):
        ids = t.column(id_col).to_pylist()
        firsts = _firsts(t, text_col)
        return pa.table(
            {
                "h": pa.array([h for h, _ in firsts], pa.int64()),
                "g": pa.array([g for _, g in firsts], pa.int64()),
                "id": pa.array([ids[r] for r, _, _ in firsts.values()], t.schema.field(id_col).type),
                "_bundle": pa.array([number] * len(firsts), pa.int32()),
                "place": pa.array([r << _ROW | k for r, k, _ in firsts.values()], pa.int64()),
            }
        )

    occurs = checkpoint(b.apply(occur, f"h long, g long, id {kind}, _bundle int, place long"))
    classes = components(line_links(b, occurs.groupBy("h").agg(F.min("_bundle").alias("_bundle")), radius, most))
    lines = occurs.join(classes.withColumnRenamed("node", "h"), "h", "left")
    lines = lines.select("id", "_bundle", "place", F.coalesce("component", "h").alias("class"), F.when(F.col("component").isNull(), F.col("g")).otherwise(F.lit(0)).alias("part"))
    where = F.struct(F.col("id").isNull().alias("n"), "id", "_bundle", "place")
    first = lines.groupBy("class", "part").agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    gone = lines.join(first, ["class", "part"]).where(where != F.col("first")).select("_bundle", "place")

    def cut(number, t, gone):
        drop = set(gone.column("place").to_pylist())
        seen: set = set()
        texts, n_lines, n_removed = [], [], []
        for r, x in enumerate(t.column(text_col).to_pylist()):
            kept, n, m = [], 0, 0
            for k, line in enumerate((x or "").split("\n")):
                if line.strip(_BLANK):
                    n += 1
                    key = line_key(line.encode())
                    if key in seen or (r << _ROW | k) in drop:
                        seen.add(key)
                        m += 1
                        continue
                    seen.add(key)
                kept.append(line)
            texts.append(x if x is None else "\n".join(kept))
            n_lines.append(n)
            n_removed.append(m)
        cols = {c: t.column(c) for c in names} | {text_col: pa.array(texts, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
        return pa.table(cols)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_lines long, n_removed long"
    return b.apply_with(gone, cut, schema)
