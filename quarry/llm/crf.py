"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad.  Its features describe the line itself
and both neighbours; transitions tie adjacent lines together.  Forward and
backward passes give each line's probability of being good; a document's raw
quality is their mean, weighted by line length, and a logistic curve fitted
on the training documents turns it into the score.

Training uses labelled documents only as far as ``crc32(doc_id as text) mod 5``
is not 0, at most about ``MAX_TRAIN_DOCS`` of them (drawn by hash, so reruns
agree) and at most ``MAX_TRAIN_BYTES`` and ``MAX_TRAIN_LINES`` of text, taken in
hash order; a document above 1/16 of either bound doesn't train.  A document's
label is the label of all its lines.  Labels, language, source and doc_id are
never inputs of a score.  Scoring covers every text in full, each document
inside its task, with a model of a few kilobytes.

Features are made for ``PIECE`` bytes of lines at a time and summed into the
lines' potentials at once, so a line takes about 150 bytes of memory besides
its text.  Chains advance together; one of very many lines is cut into segments
of ``SEGMENT`` lines that advance like chains, and their 2 x 2 transfer matrices
carry both passes over the cuts, which changes no result.

Defined results: a null or empty text is one empty line and gets a score like
any other; a doc_id with several labels trains with the largest; without any
training rows every score is 0.5; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .textscan import Texts, range_hash, slices

MAX_TRAIN_DOCS = 3000
MAX_TRAIN_BYTES = 64 << 20
MAX_TRAIN_LINES = 400_000
PIECE = 1 << 18
SEGMENT = 512
FOLDS = 5
THRESHOLD = 0.3
STEPS = 150
RATE = 0.1
L2 = 1e-3
SYMBOLS = b"#*$%&|<>"
CLASSES = (
    bytes(int(b in SYMBOLS) for b in range(256)),
    bytes(int(0x41 <= b <= 0x5A) for b in range(256)),
    bytes(int(0x30 <= b <= 0x39) for b in range(256)),
    bytes(int(b in b"!?") for b in range(256)),
    bytes(int(b in b".,;:") for b in range(256)),
    bytes(int(b >= 0x80) for b in range(256)),
)
N_OWN = 3 * len(CLASSES) + 11


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0,
                      F.lit(False))


def _pieces(start: np.ndarray, end: np.ndarray):
    """(lo, hi): runs of whole lines of about ``PIECE`` bytes."""
    lo = 0
    while lo < len(start):
        hi = int(np.searchsorted(end, start[lo] + PIECE, side="right"))
        hi = min(max(hi, lo + 1), lo + PIECE)
        yield lo, hi
        lo = hi


def repeated_lines(t: Texts, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a line equals an earlier line of its text."""
    n = len(start)
    lh = np.empty(n, dtype=np.uint64)
    for lo, hi in _pieces(start, end):
        at = start[lo]
        lh[lo:hi] = range_hash(t.raw[at:end[hi - 1]], start[lo:hi] - at, end[lo:hi] - at, seed=3)
    owner = np.repeat(np.arange(t.n), np.diff(first))
    order = np.lexsort((lh, owner))        # stable: equal lines stay in text order
    dup = np.zeros(n, dtype=bool)
    dup[order[1:]] = (lh[order[1:]] == lh[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    return dup


def own_features(raw: bytes, start: np.ndarray, end: np.ndarray, dup: np.ndarray) -> np.ndarray:
    """(lines, features) of the lines raw[start:end], which cover ``raw``."""
    n = len(start)
    t = Texts.cut(raw, np.append(start, len(raw)))
    ws, we, _ = t.words()
    line_of = np.searchsorted(start, ws, side="right") - 1
    words = np.bincount(line_of, minlength=n).astype(np.float64)
    solid = np.bincount(line_of, weights=we - ws, minlength=n)
    h = range_hash(raw, ws, we)
    same = np.zeros(len(ws), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1])
    repeats = np.bincount(line_of[same], minlength=n)
    one = np.bincount(line_of[we - ws == 1], minlength=n)
    x = np.empty((n, N_OWN))
    per = np.maximum(solid, 1)
    for i, table in enumerate(CLASSES):
        cum = np.zeros(len(raw) + 1, dtype=np.int32)
        np.cumsum(np.frombuffer(raw.translate(table), dtype=np.uint8), out=cum[1:])
        share = (cum[end] - cum[start]) / per
        x[:, 3 * i], x[:, 3 * i + 1], x[:, 3 * i + 2] = share, np.sqrt(share), share > 0.08
    w = np.maximum(words, 1)
    for i, c in enumerate((
            repeats / w, repeats > 2, one / w, one / w > 0.3, dup & (words > 0), np.log1p(words) / 5,
            np.minimum(solid / w, 30) / 10, (solid / w) < 3, (solid / w) > 9, words == 0,
            (words > 0) & (words < 4))):
        x[:, 3 * len(CLASSES) + i] = c
    return x


def _own_by_piece(t: Texts, start: np.ndarray, end: np.ndarray, first: np.ndarray):
    dup = repeated_lines(t, start, end, first)
    for lo, hi in _pieces(start, end):
        at = start[lo]
        yield lo, hi, own_features(t.raw[at:end[hi - 1]], start[lo:hi] - at, end[lo:hi] - at, dup[lo:hi])


def line_features(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length in bytes, first line of each text): a line's own
    features, those of the line before and of the line after, whether it is a
    text's first or last, and a constant."""
    start, end, first = t.lines()
    n = len(start)
    x = np.zeros((n, 3 * N_OWN + 3))
    head, tail = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    head[first[:-1]], tail[first[1:] - 1] = True, True
    for lo, hi, own in _own_by_piece(t, start, end, first):
        x[lo:hi, :N_OWN] = own
    x[1:, N_OWN:2 * N_OWN] = np.where(head[1:, None], 0, x[:-1, :N_OWN])
    x[:-1, 2 * N_OWN:3 * N_OWN] = np.where(tail[:-1, None], 0, x[1:, :N_OWN])
    x[:, -3], x[:, -2], x[:, -1] = head, tail, 1
    return x, (end - start).astype(np.float64), first


def potentials(t: Texts, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line_features @ weights, length in bytes, first line of each text),
    without the table of features."""
    start, end, first = t.lines()
    n = len(start)
    e = np.tile(weights[-1], (n, 1))
    e[first[:-1]] += weights[-3]
    e[first[1:] - 1] += weights[-2]
    head = np.zeros(n + 1, dtype=bool)      # a text's first line, and the end
    head[first] = True
    own, before, after = weights[:3 * N_OWN].reshape(3, N_OWN, 2)
    for lo, hi, x in _own_by_piece(t, start, end, first):
        e[lo:hi] += x @ own
        last = min(hi, n - 1)               # lines lo + 1 .. last follow the piece's lines
        e[lo + 1:last + 1] += np.where(head[lo + 1:last + 1, None], 0, (x @ before)[:last - lo])
        skip = int(lo == 0)                 # lines lo - 1 + skip .. hi - 2 come before them
        e[lo - 1 + skip:hi - 1] += np.where(head[lo + skip:hi, None], 0, (x @ after)[skip:])
    return e, (end - start).astype(np.float64), first


class _Steps:
    """Indices by position in their chain: chains advance together.  ``order``
    sorts chains by falling length; those still running come first."""

    def __init__(self, first: np.ndarray):
        sizes = np.diff(first)
        self.order = np.argsort(-sizes, kind="stable")
        self.heads = first[:-1][self.order]
        longest = int(sizes.max()) if len(sizes) else 0
        self.live = np.searchsorted(-sizes[self.order], -np.arange(longest), side="left")

    def later(self, backward: bool = False):
        """Positions 1, 2, ... of the chains, or from the last one down to 1."""
        ks = range(1, len(self.live))
        for k in reversed(ks) if backward else ks:
            yield self.heads[:self.live[k]] + k


def _add(p: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp(p.take(0, axis), p.take(1, axis))


def forward_backward(e: np.ndarray, first: np.ndarray, trans: np.ndarray):
    """(alpha, beta, log Z of each line's chain): e[line, label] and
    trans[from, to] are log potentials."""
    sizes = np.diff(first)
    per = -(-sizes // SEGMENT)
    chain = np.concatenate(([0], np.cumsum(per)))      # segments of each chain
    nth = np.arange(chain[-1]) - np.repeat(chain[:-1], per)
    seg = np.append(np.repeat(first[:-1], per) + nth * SEGMENT, first[-1])
    steps, inner = _Steps(seg), np.flatnonzero(nth)
    a, b = e.copy(), np.zeros_like(e)
    if len(inner):
        # m[segment, label before, label of its last line]
        m = e[seg[:-1]][:, None] + np.where((nth > 0)[:, None, None], trans, 0)
        run = m[steps.order]
        for at in steps.later():
            n = len(at)
            run[:n] = _add(run[:n, :, :, None] + trans, 2) + e[at][:, None]
        m[steps.order] = run
        fore, back, hops = m[:, 0].copy(), np.zeros((len(m), 2)), _Steps(chain)
        for at in hops.later():
            fore[at] = _add(fore[at - 1][:, :, None] + m[at], 1)
        for at in hops.later(backward=True):
            back[at - 1] = _add(m[at] + back[at][:, None], 2)
        a[seg[inner]] += _add(fore[inner - 1][:, :, None] + trans, 1)
        b[seg[1:] - 1] = back
    for at in steps.later():
        a[at] += _add(a[at - 1][:, :, None] + trans, 1)
    for at in steps.later(backward=True):
        b[at - 1] = _add((e[at] + b[at])[:, None] + trans, 2)
    return a, b, _add(a + b, 1)


@dataclass
class Model:
    weights: np.ndarray      # features x 2
    trans: np.ndarray        # 2 x 2
    slope: float
    offset: float

    def good(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each line's probability of label good."""
        a, b, z = forward_backward(e, first, self.trans)
        return np.exp(a[:, 1] + b[:, 1] - z)

    def raw(self, t: Texts) -> np.ndarray:
        if not t.n:
            return np.zeros(0)
        e, size, first = potentials(t, self.weights)
        w = np.maximum(size, 1)
        p = self.good(e, first)
        return np.add.reduceat(p * w, first[:-1]) / np.add.reduceat(w, first[:-1])

    def score(self, t: Texts) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(t) + self.offset)))


def fit(texts: pa.Array, labels: np.ndarray) -> Model:
    """Gradient ascent on the conditional likelihood of the lines' labels,
    both classes with equal weight, then the logistic curve of documents."""
    t = Texts(texts)
    x, _, first = line_features(t)
    n_f = x.shape[1]
    if t.n == 0 or len(set(labels.tolist())) < 2:
        flat = 0.0 if t.n == 0 else (4.0 if labels[0] else -4.0)
        return Model(np.zeros((n_f, 2)), np.zeros((2, 2)), 0.0, flat)
    owner = np.repeat(np.arange(t.n), np.diff(first))
    y = labels.astype(np.int64)[owner]
    # documents weigh alike within a class, the classes alike
    share = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
    w = (share / np.diff(first))[owner]
    inner = np.flatnonzero(owner[1:] == owner[:-1]) + 1
    gold = np.eye(2)[y]
    params = np.zeros(n_f * 2 + 4)
    m1, m2 = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        weights, trans = params[:-4].reshape(n_f, 2), params[-4:].reshape(2, 2)
        e = x @ weights
        a, b, z = forward_backward(e, first, trans)
        node = np.exp(a + b - z[:, None])
        g_w = x.T @ ((gold - node) * w[:, None])
        pair = np.exp(a[inner - 1][:, :, None] + trans[None] + (e[inner] + b[inner])[:, None, :]
                      - z[inner][:, None, None])
        seen = np.zeros_like(pair)
        seen[np.arange(len(inner)), y[inner - 1], y[inner]] = 1
        g_t = ((seen - pair) * w[inner][:, None, None]).sum(axis=0)
        g = np.concatenate((g_w.ravel(), g_t.ravel())) - L2 * params
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        params = params + RATE * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
    model = Model(params[:-4].reshape(n_f, 2), params[-4:].reshape(2, 2), 1.0, 0.0)
    raw = model.raw(t)
    # Newton steps of a one-variable logistic regression
    d = np.stack((raw, np.ones_like(raw)), axis=1)
    c = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(d @ c, -30, 30)))
        h = (d * (p * (1 - p))[:, None]).T @ d + 1e-3 * np.eye(2)
        c = c + np.clip(np.linalg.solve(h, d.T @ (labels - p) - 1e-3 * c), -5, 5)
    model.slope, model.offset = float(c[0]), float(c[1])
    return model


def training_sample(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS,
                    max_bytes: int = MAX_TRAIN_BYTES, max_lines: int = MAX_TRAIN_LINES):
    """(texts, labels) of about ``max_docs`` labelled documents within the
    bounds, on the driver."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()
                          & ~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    limit = int((1 << 32) * min(1.0, max_docs / max(n, 1)))
    draw = F.xxhash64("doc_id", F.lit(5))
    drawn = known.filter(F.pmod(draw, F.lit(1 << 32)) < limit)
    rows = materialize(docs.select("doc_id", "text").join(F.broadcast(drawn.limit(2 * max_docs)), "doc_id")
                       .dropDuplicates(["doc_id"]), "crf_sample")
    text = F.coalesce("text", F.lit(""))
    size = rows.select("doc_id", draw.alias("draw"), F.octet_length(text).alias("bytes"), (
        F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("lines"))
    # at most 2 * max_docs short rows
    so_far = Window.orderBy("draw", "doc_id")
    fits = size.filter((F.col("bytes") <= max_bytes // 16) & (F.col("lines") <= max_lines // 16)) \
        .select("doc_id", F.sum("bytes").over(so_far).alias("bytes"), F.sum("lines").over(so_far).alias("lines")) \
        .filter((F.col("bytes") <= max_bytes) & (F.col("lines") <= max_lines)).select("doc_id")
    got = rows.join(F.broadcast(fits), "doc_id").orderBy("doc_id").select("text", "quality").toArrow()
    return got.column("text").combine_chunks(), got.column("quality").to_numpy()


def score_documents(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS,
                    threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = fit(*training_sample(docs, labels, max_docs))

    def scored(batches):
        for b in slices(batches, max_bytes=2 << 20):
            s = np.clip(np.nan_to_num(model.score(Texts(b.column("text"))), nan=0.5), 0, 1)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"])

    out = docs.select("doc_id", "text").mapInArrow(
        scored, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
