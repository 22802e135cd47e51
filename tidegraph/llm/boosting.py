"""Histogram gradient-boosted trees in numpy, flattened into arrays.

Trees are complete to ``depth``: node n of a level has children 2n+1 and 2n+2, and a node that is not
worth splitting sends everything left. Traversal is one gather a level for all rows and trees.
"""

from __future__ import annotations

import numpy as np


class Trees:
    """feature, threshold: (trees, 2**depth - 1); leaf: (trees, 2**depth); base: log-odds to start from."""

    def __init__(self, feature, threshold, leaf, base: float):
        self.feature, self.threshold, self.leaf, self.base = feature, threshold, leaf, base

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros((len(x), len(self.feature)), np.int32)
        tree, row = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        inner = self.feature.shape[1]
        for _ in range(int(np.log2(inner + 1))):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        return self.base + self.leaf[tree, at - inner].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x))) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 8.0, ridge: float = 1.0) -> Trees:
    """Boosted trees for P(y = 1). With rows of one class only, or none, the model is the constant (n1 + 1) / (n + 2)."""
    inner, n = 2**depth - 1, len(y)
    ones = float(y.sum())
    base = float(np.log((ones + 1) / (n - ones + 1)))
    if ones in (0.0, float(n)):
        return Trees(np.zeros((1, inner), np.int32), np.full((1, inner), np.inf), np.zeros((1, inner + 1)), base)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    margin = np.full(n, base)
    feature, threshold, leaf = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = at - first
            best, split = np.full(width, 1e-9), np.full((width, 2), -1)
            for f in range(x.shape[1]):
                if not len(cuts[f]):
                    continue
                key = local * bins + binned[:, f]
                gl = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(axis=1)
                hl = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(axis=1)
                cl = np.bincount(key, None, width * bins).reshape(width, bins).cumsum(axis=1)
                gt, ht, ct = gl[:, -1:], hl[:, -1:], cl[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(cl < least) | (ct - cl < least)] = 0
                gain[:, len(cuts[f]) :] = 0
                where = gain.argmax(axis=1)
                top = gain[np.arange(width), where]
                better = top > best
                best[better] = top[better]
                split[better] = np.stack([np.full(width, f), where], axis=1)[better]
            for node in range(width):
                if split[node, 0] >= 0:
                    feature[t, first + node] = split[node, 0]
                    threshold[t, first + node] = cuts[split[node, 0]][split[node, 1]]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        at -= inner
        leaf[t] = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        margin += leaf[t][at]
    return Trees(feature, threshold, leaf, base)
