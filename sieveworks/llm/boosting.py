"""A small gradient-boosted tree classifier (logistic loss) on numpy arrays, and threshold calibration."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of fixed depth stored as arrays; features are cut at up to `bins` quantiles."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 16, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2
        self.bias = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for at in range(2**self.depth - 1):
                rows = np.flatnonzero(node == at)
                best = 1e-6
                if len(rows) > 8:
                    g, h = grad[rows], hess[rows]
                    whole = g.sum() ** 2 / (h.sum() + self.l2)
                    for j, edges in enumerate(cuts):
                        for c in edges:
                            low = x[rows, j] <= c
                            gl, hl = g[low].sum(), h[low].sum()
                            gain = gl**2 / (hl + self.l2) + (g.sum() - gl) ** 2 / (h.sum() - hl + self.l2) - whole
                            if gain > best:
                                best, feature[at], cut[at] = gain, j, c
                node[rows] = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            leaf = node - (2**self.depth - 1)
            top = np.bincount(leaf, grad, 2**self.depth)
            value = self.rate * top / (np.bincount(leaf, hess, 2**self.depth) + self.l2)
            score += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.bias)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            score += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-score))


def threshold_for(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest threshold whose held-out precision is at least `precision`; above 1 where there is none."""
    order = np.argsort(-p)
    hit = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero((hit >= precision) & np.r_[p[order][1:] != p[order][:-1], True])
    return float(p[order][good[-1]]) if len(good) else 2.0
