"""Histogram gradient-boosted trees for a binary label, kept as flat arrays.

A tree of depth d is three arrays in heap order: feature, threshold, leaf value. Scoring walks all
rows down one level at a time with numpy gathers; no Python loop over rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2**depth)
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - (2**self.depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, l2: float = 1.0, least: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss; splits are looked for on quantile bins.

    One class only, or no rows: a constant score (the class, or 0.5).
    """
    n, k = x.shape if x.ndim == 2 else (0, 1)
    rate_pos = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(rate_pos / (1 - rate_pos)))
    inner, leaves = 2**depth - 1, 2**depth
    fs, ts, ls = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if n == 0 or y.min() == y.max():
        return Trees(fs[:0], ts[:0], ls[:0], base, depth)
    edges = []
    code = np.zeros((n, k), np.int64)
    for j in range(k):
        e = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]))
        edges.append(e)
        code[:, j] = np.searchsorted(e, x[:, j], side="left")  # x <= e[i] falls at or below bin i
    flat = code + np.arange(k) * bins
    m = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-m))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            key = ((node - first)[:, None] * (k * bins) + flat).ravel()
            gs = np.bincount(key, np.repeat(g, k), width * k * bins).reshape(width, k, bins)
            hs = np.bincount(key, np.repeat(h, k), width * k * bins).reshape(width, k, bins)
            gl, hl = gs.cumsum(2), hs.cumsum(2)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least) | (ht - hl < least)] = -1
            for j in range(k):
                gain[:, j, len(edges[j]) :] = -1
            best = gain.reshape(width, -1).argmax(1)
            for w in range(width):
                j, b = divmod(int(best[w]), bins)
                if gain[w, j, b] > 1e-9:
                    fs[t, first + w], ts[t, first + w] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), fs[t, node]] > ts[t, node])
        at = node - inner
        gs, hs = np.bincount(at, g, leaves), np.bincount(at, h, leaves)
        ls[t] = -rate * gs / (hs + l2)
        m += ls[t, at]
    return Trees(fs, ts, ls, base, depth)
