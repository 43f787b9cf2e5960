"""Gradient-boosted trees for two classes, on histograms of quantile bins."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    edges: list[np.ndarray]  # of each feature's bins
    feature: np.ndarray  # trees x inner nodes, heap order
    cut: np.ndarray  # the largest bin that goes left
    leaf: np.ndarray  # trees x leaves
    bias: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)]).astype(np.int16)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b, rows, out = self.bins(x), np.arange(len(x)), np.full(len(x), self.bias)
        inner = self.feature.shape[1]
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (b[rows, f[at]] > c[at])
            out += v[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, n_bins: int = 16, ridge: float = 1.0) -> Forest:
    """Newton boosting on the logistic loss; a split needs a positive gain and is the first best one."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) for j in range(x.shape[1])]
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    forest = Forest(edges, np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), n_bins, np.int64), np.zeros((trees, 2**depth)), float(np.log(share / (1 - share))))
    b, score, cols = forest.bins(x).astype(np.int64), np.full(len(x), forest.bias), x.shape[1]
    size = cols * n_bins
    wide = np.arange(cols) * n_bins * 2**depth
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h, at = y - p, p * (1 - p), np.zeros(len(x), np.int64)
        for level in range(depth):
            n, first = 2**level, 2**level - 1
            key = ((at - first)[:, None] * n_bins + b + wide).ravel()
            gs = np.bincount(key, np.repeat(g, cols), size * 2**depth).reshape(cols, -1, n_bins)[:, :n].cumsum(axis=2)
            hs = np.bincount(key, np.repeat(h, cols), size * 2**depth).reshape(cols, -1, n_bins)[:, :n].cumsum(axis=2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[(hs < 1) | (ht - hs < 1)] = 0
            flat = gain.transpose(1, 0, 2).reshape(n, -1)
            k = flat.argmax(axis=1)
            better = flat[np.arange(n), k] > 1e-9
            forest.feature[t, first : first + n][better] = (k // n_bins)[better]
            forest.cut[t, first : first + n][better] = (k % n_bins)[better]
            at = 2 * at + 1 + (b[np.arange(len(x)), forest.feature[t, at]] > forest.cut[t, at])
        leaf = at - (2**depth - 1)
        forest.leaf[t] = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        score += forest.leaf[t][leaf]
    return forest
