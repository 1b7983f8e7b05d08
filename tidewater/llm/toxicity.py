"""Toxic spans by a linear-chain conditional random field.

Labels are of documents; tokens get theirs first: a word, or the beginning of one, that stands in labelled toxic
documents far more often than chance allows (the likelihood-ratio statistic) marks its tokens as toxic there. A chain
with the states clean and toxic is then fitted to the labelled tokens by gradient ascent. Its forward-backward marginals
tag the tokens of every text; their sum, largest value and share are aggregated to a document's score by a logistic
regression on the labels. The chain of all texts in a slice is run at once, in blocks, as products of 2 x 2 matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bundles import pieces_of
from .textkernel import SLICE_BYTES, Items, Texts, mix, row_of, slices

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LEAD = np.ones(256, dtype=bool)
_LEAD[0x80:0xC0] = False

#: Features of a token: itself, and its first bytes (so many) if it is longer.
PREFIXES = (4, 5, 6, 7)
BLOCK = 64


@dataclass
class Model:
    features: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))  # sorted hashes
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -5.0
    start: float = 0.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    score: np.ndarray = field(default_factory=lambda: np.zeros(4))  # of the constant, log sum, largest, share


def tokens(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Starts, ends, row offsets, and for each kind of feature the tokens' hashes (0: none)."""
    starts, ends, at = t.runs(_LETTER)
    items, kinds = Items(_LOWER[t.data], starts), []
    for i, n in enumerate((None, *PREFIXES)):
        h = mix(items.hashes(ends if n is None else np.minimum(ends, starts + n)) + np.uint64(i))
        kinds.append(h if n is None else np.where(ends - starts > n, h, np.uint64(0)))
    return starts, ends, at, kinds


def active(model_features: np.ndarray, kinds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(token, feature number) of the known features that occur."""
    if not len(model_features):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    who, what = [], []
    for h in kinds:
        at = np.searchsorted(model_features, h)
        at[at == len(model_features)] = 0
        hit = np.flatnonzero(model_features[at] == h)
        who.append(hit)
        what.append(at[hit])
    return np.concatenate(who), np.concatenate(what)


def chain(emit: np.ndarray, first: np.ndarray, start: float, moves: np.ndarray, pairs: bool = False):
    """Marginals of the toxic state for one long chain that starts anew at each ``first``; with ``pairs``, the expected moves too.

    Forward and backward vectors come from products over blocks of BLOCK steps, then from a replay inside all blocks at once.
    """
    n = len(emit)
    if not n:
        return (np.zeros(0), np.zeros((2, 2))) if pairs else np.zeros(0)
    c = -(-n // BLOCK)
    e = np.exp(np.clip(emit, -30, 30))
    m = np.empty((2, 2, c * BLOCK))
    m[0, 0], m[0, 1], m[1, 0], m[1, 1] = 1.0, 0.0, 0.0, 1.0
    a = np.exp(moves)
    for i in (0, 1):
        m[i, 0, :n] = np.where(first, 1.0, a[i, 0])
        m[i, 1, :n] = np.where(first, np.exp(start), a[i, 1]) * e
    m = m.reshape(2, 2, c, BLOCK)

    def times(x, y):
        z = np.einsum("ijc,jkc->ikc", x, y)
        return z / z.sum(axis=(0, 1))

    whole = m[..., 0]
    for s in range(1, BLOCK):
        whole = times(whole, m[..., s])
    ahead, behind = np.empty((c, 2)), np.empty((c, 2))
    p, q, w = 1.0, 0.0, whole.transpose(2, 0, 1).tolist()
    for i, ((a00, a01), (a10, a11)) in enumerate(w):
        ahead[i] = p, q
        p, q = p * a00 + q * a10, p * a01 + q * a11
        t = p + q
        p, q = p / t, q / t
    p = q = 0.5
    for i in range(c - 1, -1, -1):
        (a00, a01), (a10, a11) = w[i]
        behind[i] = p, q
        p, q = a00 * p + a01 * q, a10 * p + a11 * q
        t = p + q
        p, q = p / t, q / t
    alpha, beta = np.empty((2, c, BLOCK)), np.empty((2, c, BLOCK))
    v = ahead.T
    for s in range(BLOCK):
        v = np.stack([v[0] * m[0, 0, :, s] + v[1] * m[1, 0, :, s], v[0] * m[0, 1, :, s] + v[1] * m[1, 1, :, s]])
        v = v / v.sum(axis=0)
        alpha[:, :, s] = v
    v = behind.T
    for s in range(BLOCK - 1, -1, -1):
        beta[:, :, s] = v
        v = np.stack([m[0, 0, :, s] * v[0] + m[0, 1, :, s] * v[1], m[1, 0, :, s] * v[0] + m[1, 1, :, s] * v[1]])
        v = v / v.sum(axis=0)
    both = (alpha * beta).reshape(2, -1)[:, :n]
    toxic = both[1] / both.sum(axis=0)
    if not pairs:
        return toxic
    al, be, mm = alpha.reshape(2, -1)[:, : n - 1], beta.reshape(2, -1)[:, 1:n], m.reshape(2, 2, -1)[:, :, 1:n]
    x = al[:, None, :] * mm * be[None, :, :]
    x /= x.sum(axis=(0, 1))
    return toxic, x[:, :, ~first[1:]].sum(axis=2)


def _emissions(model: Model, n: int, who: np.ndarray, what: np.ndarray) -> np.ndarray:
    return model.bias + np.bincount(who, weights=model.weights[what], minlength=n)[:n]


def _first(at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=bool)
    out[at[:-1][np.diff(at) > 0]] = True
    return out


def _gathered(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per row: constant, log of 1 + sum, largest, share of the marginals."""
    n = np.diff(at)
    sums = np.concatenate([[0.0], np.cumsum(p)])
    total = np.maximum(0, sums[at[1:]] - sums[at[:-1]])
    top = np.zeros(len(n))
    if len(p):
        np.maximum.at(top, row_of(at), p)
    return np.stack([np.ones(len(n)), np.log1p(total), top, total / np.maximum(n, 1)], axis=1)


def _features(texts: pa.Array):
    """For each kind of feature, the different (row, hash) pairs."""
    _, _, at, kinds = tokens(Texts(texts))
    rows = row_of(at)
    for h in kinds:
        order = np.lexsort((h, rows))
        r, f = rows[order], h[order]
        keep = f != 0
        keep[1:] &= (r[1:] != r[:-1]) | (f[1:] != f[:-1])
        yield r[keep], f[keep]


def fit(texts: pa.Array, toxic: np.ndarray, most_features: int = 4096, least_ratio: float = 20.0, rounds: int = 40) -> Model:
    """The model of labelled texts (0/1). Without texts of both labels nothing is toxic but by the base rate."""
    model, rate = Model(), (toxic.sum() + 0.5) / (len(toxic) + 1.0)
    model.score[0] = np.log(rate / (1 - rate))
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    if not n1 or not n0:
        return model
    cut = pieces_of(pa.table({"t": texts}), "t", SLICE_BYTES)  # bounds the driver's memory
    found = []
    for i, texts_ in cut:
        hot = np.flatnonzero(toxic[i : i + len(texts_)] == 1)
        found += [f for _, f in _features(texts_.take(pa.array(hot)))]
    feats, df1 = np.unique(np.concatenate(found), return_counts=True)
    feats, df1 = feats[df1 > 2], df1[df1 > 2]
    if not len(feats):
        return model
    df0 = np.zeros(len(feats), dtype=np.int64)
    for i, texts_ in cut:
        for _, f in _features(texts_.take(pa.array(np.flatnonzero(toxic[i : i + len(texts_)] == 0)))):
            at = np.minimum(np.searchsorted(feats, f), len(feats) - 1)
            df0 += np.bincount(at[feats[at] == f], minlength=len(feats))
    del found

    def part(k, e):
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / e), 0.0)

    share = (df1 + df0) / (n1 + n0)
    ratio = 2 * (part(df1, n1 * share) + part(df0, n0 * share) + part(n1 - df1, n1 * (1 - share) + 1e-12) + part(n0 - df0, n0 * (1 - share) + 1e-12))
    good = (df1 / n1 > 4 * df0 / n0) & (df1 >= 9 * df0) & (ratio >= least_ratio)
    best = np.flatnonzero(good)[np.argsort(-ratio[good], kind="stable")[:most_features]]
    model.features = np.sort(feats[best])
    if not len(model.features):
        return model
    model.weights = np.zeros(len(model.features))
    slices_ = []  # of whole documents: the chain starts anew at each
    seen_moves, n_gold, n_first = np.zeros((2, 2)), 0, 0
    gold_features = np.zeros(len(model.weights))
    for i, texts_ in cut:
        _, _, at, kinds = tokens(Texts(texts_))
        who, what = active(model.features, kinds)
        n = int(at[-1])
        first, gold = _first(at, n), np.zeros(n, dtype=np.int64)
        gold[who] = 1
        gold *= toxic[i + row_of(at)] if n else 1
        inner = np.flatnonzero(~first)
        np.add.at(seen_moves, (gold[inner - 1], gold[inner]), 1)
        gold_features += np.bincount(what, weights=gold[who], minlength=len(model.weights))
        n_gold, n_first = n_gold + gold.sum(), n_first + gold[first].sum()
        slices_.append((n, at, who, what, first))
    moments = None
    for r in range(rounds):  # Adam on the penalised log-likelihood: what the labels have, less what the model expects
        grad = np.concatenate([gold_features - 0.1 * model.weights, [n_gold, n_first - 0.1 * model.start], (seen_moves - 0.1 * model.moves).ravel()])
        for n, at, who, what, first in slices_:
            if n:
                p, moved = chain(_emissions(model, n, who, what), first, model.start, model.moves, pairs=True)
                grad -= np.concatenate([np.bincount(what, weights=p[who], minlength=len(model.weights)), [p.sum(), p[first].sum()], moved.ravel()])
        moments = (0.1 * grad, 0.01 * grad**2) if moments is None else (0.9 * moments[0] + 0.1 * grad, 0.99 * moments[1] + 0.01 * grad**2)
        step = 0.3 * (moments[0] / (1 - 0.9 ** (r + 1))) / (np.sqrt(moments[1] / (1 - 0.99 ** (r + 1))) + 1e-6)
        model.weights += step[:-6]
        model.bias += step[-6]
        model.start += step[-5]
        model.moves += step[-4:].reshape(2, 2)
    x = np.concatenate([_gathered(chain(_emissions(model, n, who, what), first, model.start, model.moves), at) for n, at, who, what, first in slices_])
    model.score = _logistic(x, toxic)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a penalised logistic regression, by Newton steps that are halved until they gain; separable labels are fine."""
    penalty = np.array([0.001, *[0.1] * (x.shape[1] - 1)])

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * penalty @ (w * w)

    w = np.zeros(x.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (mu * (1 - mu))[:, None]).T @ x + np.diag(penalty), x.T @ (y - mu) - penalty * w)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def tag(model: Model, column: pa.Array, least: float = 0.5) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Scores, and the toxic spans in code points: neighbouring tokens with marginals of ``least`` or more."""
    t = Texts(column)
    starts, ends, at, kinds = tokens(t)
    n = len(starts)
    p = chain(_emissions(model, n, *active(model.features, kinds)), _first(at, n), model.start, model.moves)
    x = _gathered(p, at) @ model.score
    spans: list[list[tuple[int, int]]] = [[] for _ in range(t.rows)]
    hot = np.flatnonzero(p >= least)
    if len(hot):
        points = np.concatenate([[0], np.cumsum(_LEAD[t.data])])
        rows, last = row_of(at)[hot], -2
        for i, r in zip(hot.tolist(), rows.tolist()):
            base = points[t.offsets[r]]
            one = int(points[starts[i]] - base), int(points[ends[i]] - base)
            if i == last + 1 and spans[r]:
                spans[r][-1] = spans[r][-1][0], one[1]
            else:
                spans[r].append(one)
            last = i
    return 1 / (1 + np.exp(-np.clip(x, -30, 30))), spans


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, most_docs: int = 5000, most_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on a bounded sample of labelled, not held-out documents, in the order of a hash of their ids: ``most_docs`` rows
    at most, whole texts, up to the one that reaches ``most_bytes`` in all. Rows without an id or a 0/1 label are passed
    over; rows that repeat an id are rows of their own, rows that repeat a text too are one. The rows' order is fixed, so
    the same tables give the same model."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("toxic"))
    some = known.orderBy(F.xxhash64("id"), "id").limit(most_docs)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    order = ["rank", "id", "tag"]
    found = rows.join(F.broadcast(some), "id").select(F.xxhash64("id").alias("rank"), "id", F.xxhash64("text").alias("tag"), F.octet_length("text").cast("long").alias("size"), "toxic")
    found = found.distinct().orderBy(*order).limit(most_docs)
    before = F.coalesce(F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = found.withColumn("before", before).where(F.col("before") < most_bytes).select("id", "tag", "rank", F.col("toxic").cast("long").alias("toxic"))
    got = rows.withColumn("tag", F.xxhash64("text")).join(F.broadcast(chosen), ["id", "tag"]).groupBy(*order, "toxic").agg(F.first("text").alias("text")).toArrow()
    got = got.sort_by([(c, "ascending") for c in order])
    texts = got.column("text").combine_chunks() if got.num_rows else pa.array([], pa.string())
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks)
    return fit(texts, got.column("toxic").to_numpy().astype(np.int64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """A row per input row: the id, score (0 to 1), spans (code-point offsets, end exclusive); all columns if
    ``keep``, of which these two replace any of their names.

    Null and empty texts have the score of a text without toxic tokens. One pass, no shuffle.
    """
    names = [c for c in docs.columns if c.lower() not in ("score", "spans")] if keep else [id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, SLICE_BYTES):
            scores, spans = tag(model, b.column(b.schema.get_field_index(text_col)))
            pairs = pa.array([[{"from": s, "to": e} for s, e in x] for x in spans], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(scores), pairs], names=[*names, "score", "spans"])

    frame = docs.select(*names) if keep else docs.select(id_col, text_col)
    return frame.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name in names) + ", score double, spans array<struct<`from`:long,`to`:long>>")
