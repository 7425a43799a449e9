"""Gradient-boosted trees for two classes, in NumPy: histogram splits, logistic loss, Newton leaves."""

from __future__ import annotations

import numpy as np


def platt(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Sigmoid (slope, offset) by Newton's method on smoothed targets."""
    if len(margin) == 0:
        return 2.0, 0.0
    pos, neg = good.sum(), (~good).sum()
    t = np.where(good, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - t) + 1e-3 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        d = np.linalg.solve(h, g)
        w -= np.clip(d, -5, 5)
        if np.abs(d).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


class Boosted:
    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: int = 8, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.l2 = trees, depth, rate, bins, least, l2
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.platt = (1.0, 0.0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T, strict=True)], 1)
        score = np.full(len(y), self.base)
        nodes = 2 ** (self.depth + 1) - 1
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            feature, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
            where = np.zeros(len(y), int)
            for node in range(nodes):
                rows = np.flatnonzero(where == node)
                if not len(rows):
                    continue
                sg, sh = g[rows].sum(), h[rows].sum()
                value[node] = -self.rate * sg / (sh + self.l2)
                if 2 * node + 2 >= nodes or len(rows) < 2 * self.least:
                    continue
                best = 1e-6
                for f, q in enumerate(cuts):
                    if not len(q):
                        continue
                    b = binned[rows, f]
                    cg = np.cumsum(np.bincount(b, g[rows], len(q) + 1))[:-1]
                    ch = np.cumsum(np.bincount(b, h[rows], len(q) + 1))[:-1]
                    n = np.cumsum(np.bincount(b, minlength=len(q) + 1))[:-1]
                    gain = cg**2 / (ch + self.l2) + (sg - cg) ** 2 / (sh - ch + self.l2) - sg**2 / (sh + self.l2)
                    gain[(n < self.least) | (len(rows) - n < self.least)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, feature[node], cut[node] = gain[k], f, q[k]
                if feature[node] >= 0:
                    where[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            tree = (feature, cut, value)
            self.model.append(tree)
            score = score + self._tree(tree, x)
        return self

    def _tree(self, tree, x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at = np.zeros(len(x), int)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            f = feature[at]
            at = np.where(f >= 0, 2 * at + 1 + (x[rows, np.maximum(f, 0)] > cut[at]), at)
        return value[at]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum(self._tree(t, x) for t in self.model)

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * self.margin(x) + b, -30, 30)))
