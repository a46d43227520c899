"""Gradient-boosted trees on binned features, and calibrated thresholds."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting of complete binary trees over labels 0 and 1; deterministic."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 48, least: float = 4.0, shrink: float = 2.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.shrink = trees, depth, rate, bins, least, shrink
        self.edges: list[np.ndarray] = []
        self.base = 0.0
        self.grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1) if len(self.edges) else np.zeros((len(x), 0), int)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        weight = np.ones(len(y)) if weight is None else weight
        self.edges = []
        for k in range(x.shape[1]):
            values = np.unique(x[:, k])
            middle = (values[1:] + values[:-1]) / 2
            self.edges.append(middle if len(middle) < self.bins else np.quantile(middle, np.linspace(0, 1, self.bins)))
        # rows alike in every bin and in label count as one with their weights together
        rows, of = np.unique(np.column_stack([self._binned(x), y > 0.5]), axis=0, return_inverse=True)
        b, y, weight = rows[:, :-1], rows[:, -1].astype(float), np.bincount(of.ravel(), weight, len(rows))
        wide, n_features = self.bins + 2, x.shape[1]
        mean = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.base)
        self.grown = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = (p - y) * weight, np.maximum(p * (1 - p), 1e-6) * weight
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, wide)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                best, gain = np.zeros(count, np.int64), np.zeros(count)
                where = np.full(count, wide)
                for k in range(n_features):
                    cell = node * wide + b[:, k]
                    g = np.cumsum(np.bincount(cell, grad, count * wide).reshape(count, wide), axis=1)
                    h = np.cumsum(np.bincount(cell, hess, count * wide).reshape(count, wide), axis=1)
                    all_g, all_h = g[:, -1:], h[:, -1:]
                    value = g**2 / (h + self.shrink) + (all_g - g) ** 2 / (all_h - h + self.shrink) - all_g**2 / (all_h + self.shrink)
                    value[(h < self.least / 4) | (all_h - h < self.least / 4)] = 0
                    at = value.argmax(axis=1)
                    top = value[np.arange(count), at]
                    better = top > gain + 1e-9
                    best[better], where[better], gain[better] = k, at[better], top[better]
                feature[first : first + count], cut[first : first + count] = best, where
                node = node * 2 + (b[np.arange(len(y)), best[node]] > where[node])
            g, h = np.bincount(node, grad, 2**self.depth), np.bincount(node, hess, 2**self.depth)
            leaf = -self.rate * g / (h + self.shrink)
            self.grown.append((feature, cut, leaf))
            score += leaf[node]
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in self.grown:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = node + 2**level - 1
                node = node * 2 + (b[rows, feature[at]] > cut[at])
            score += leaf[node]
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def best_threshold(p: np.ndarray, y: np.ndarray, slack: float = 0.02) -> float:
    """The lowest threshold on held-out rows whose F1 is within ``slack`` of the greatest, in the middle of the gap below
    it, between 0.15 and 0.5; 0.5 if there are no rows. Lowest, since to miss costs more than to find too much."""
    if not len(p) or not y.any():
        return 0.5
    order = np.argsort(-p)
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + y.sum())
    low = np.flatnonzero(f1 >= f1.max() - slack)[-1]
    return float(np.clip((p[order[low]] + p[order[min(low + 1, len(p) - 1)]]) / 2, 0.15, 0.5))
