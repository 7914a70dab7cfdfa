"""Gradient-boosted symmetric trees for a few classes, in NumPy.

Softmax loss; each round adds one tree per class.  All nodes of a tree level
share one question (feature > threshold), chosen by the summed gain over the
level's leaves, so a tree is ``depth`` questions and a table of 2^depth
values, and scoring is a few comparisons per column.  Training is
deterministic; its input is a bounded sample that the caller draws."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 24
SHRINK = 2.0         # added to a leaf's weight


@dataclass
class Trees:
    feature: np.ndarray      # rounds x classes x depth
    above: np.ndarray        # thresholds, same shape
    value: np.ndarray        # rounds x classes x 2^depth

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities, classes x rows; ``x`` is features x rows."""
        rounds, classes, depth = self.feature.shape
        out = np.zeros((classes, x.shape[1]))
        for r in range(rounds):
            for c in range(classes):
                out[c] += self.value[r, c][_leaves(x, self.feature[r, c], self.above[r, c])]
        return _log_softmax(out)


def _leaves(x: np.ndarray, feature, above) -> np.ndarray:
    leaf = np.zeros(x.shape[1], dtype=np.int64)
    for f, t in zip(feature, above):
        leaf = leaf * 2 + (x[f] > t)
    return leaf


def _log_softmax(s: np.ndarray) -> np.ndarray:
    s = s - s.max(axis=0)
    return s - np.log(np.exp(s).sum(axis=0))


def _thresholds(row: np.ndarray) -> np.ndarray:
    """Midpoints between values at up to ``BINS`` quantiles."""
    v = np.unique(np.quantile(row, np.linspace(0, 1, BINS), method="nearest"))
    return ((v[1:] + v[:-1]) / 2).astype(row.dtype)


def train(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 30, depth: int = 4,
          rate: float = 0.3) -> Trees:
    """``x``: features x rows (float32); ``y``: classes of the rows."""
    cuts = [_thresholds(row) for row in x]
    bins = [np.searchsorted(t, row, side="left") for t, row in zip(cuts, x)]   # value > t[b-1]
    target = np.eye(classes)[:, y]
    score = np.zeros((classes, x.shape[1]))
    feature = np.zeros((rounds, classes, depth), dtype=np.int64)
    above = np.zeros((rounds, classes, depth), dtype=x.dtype)
    value = np.zeros((rounds, classes, 1 << depth))
    for r in range(rounds):
        p = np.exp(_log_softmax(score))
        for c in range(classes):
            g, h = target[c] - p[c], np.maximum(p[c] * (1 - p[c]), 1e-6)
            leaf = np.zeros(len(y), dtype=np.int64)
            for d in range(depth):
                best = (-np.inf, 0, np.inf)
                for f, (t, b) in enumerate(zip(cuts, bins)):
                    if not len(t):
                        continue
                    shape, at = (1 << d, len(t) + 1), leaf * (len(t) + 1) + b
                    gs, hs = (np.bincount(at, weights=w, minlength=shape[0] * shape[1]).reshape(shape)
                              .cumsum(axis=1) for w in (g, h))
                    left_g, left_h = gs[:, :-1], hs[:, :-1]
                    right_g, right_h = gs[:, -1:] - left_g, hs[:, -1:] - left_h
                    gain = (left_g ** 2 / (left_h + SHRINK) + right_g ** 2 / (right_h + SHRINK)).sum(axis=0)
                    k = int(gain.argmax())
                    if gain[k] > best[0] + 1e-9:
                        best = (gain[k], f, t[k])
                feature[r, c, d], above[r, c, d] = best[1:]
                leaf = leaf * 2 + (x[best[1]] > best[2])
            gs, hs = (np.bincount(leaf, weights=w, minlength=1 << depth) for w in (g, h))
            value[r, c] = rate * gs / (hs + SHRINK)
            score[c] += value[r, c][leaf]
    return Trees(feature, above, value)
