"""Gradient-boosted regression trees for two classes, in numpy: histogram splits, logistic loss, fixed depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    base: float
    feature: np.ndarray  # trees x inner nodes, heap order
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    rate: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1]))
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += self.rate * leaf[node - (leaf.size - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 32, shrink: float = 1.0) -> Forest:
    """Newton boosting. Deterministic: of equal gains the first feature and the lowest cut win."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
    codes = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)  # code <= k iff x <= cuts[k]
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    base = float(np.log(p / (1 - p)))
    margin = np.full(n, base)
    inner, leaves = (1 << depth) - 1, 1 << depth
    forest = Forest(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), rate)
    for t in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = y - q, np.maximum(q * (1 - q), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            for k in range((1 << level) - 1, (1 << level + 1) - 1):
                at = np.flatnonzero(node == k)
                if len(at) >= 2:
                    best, total_g, total_h = 1e-9, g[at].sum(), h[at].sum()
                    for j, c in enumerate(cuts):
                        if not len(c):
                            continue
                        gs = np.cumsum(np.bincount(codes[at, j], g[at], len(c) + 1))[:-1]
                        hs = np.cumsum(np.bincount(codes[at, j], h[at], len(c) + 1))[:-1]
                        gain = gs**2 / (hs + shrink) + (total_g - gs) ** 2 / (total_h - hs + shrink) - total_g**2 / (total_h + shrink)
                        i = int(np.argmax(gain))
                        if gain[i] > best + 1e-9:
                            best = gain[i]
                            forest.feature[t, k], forest.cut[t, k] = j, c[i]
                node[at] = 2 * k + 1 + (x[at, forest.feature[t, k]] > forest.cut[t, k])
        place = node - inner
        up, down = np.bincount(place, g, leaves), np.bincount(place, h, leaves)
        forest.leaf[t] = up / (down + shrink)
        margin += rate * forest.leaf[t][place]
    return forest
