"""Logistic regression over hashed features."""

from __future__ import annotations

import numpy as np
import xxhash


class HashedLogistic:
    """Weights of hashed binary features; fitted by Adagrad over shuffled blocks, always with the same result."""

    def __init__(self, bits: int = 15):
        self.size = 1 << bits
        self.weight = np.zeros(self.size)
        self.bias = 0.0
        self._slot: dict[str, int] = {}

    def slot(self, feature: str) -> int:
        found = self._slot.get(feature)
        if found is None:
            if len(self._slot) > 500_000:
                self._slot.clear()
            found = self._slot[feature] = xxhash.xxh32_intdigest(feature) & (self.size - 1)
        return found

    def __getstate__(self):
        return self.__dict__ | {"_slot": {}}

    def _score(self, rows: list[list[int]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        counts = np.array([len(r) for r in rows])
        flat = np.fromiter((i for r in rows for i in r), np.int64, counts.sum())
        owner = np.repeat(np.arange(len(rows)), counts)
        return np.bincount(owner, self.weight[flat], len(rows)) + self.bias

    def fit(self, features: list[list[str]], labels: np.ndarray, rounds: int = 12, rate: float = 0.2, shrink: float = 1e-5, seed: int = 3) -> HashedLogistic:
        rows = [[self.slot(f) for f in fs] for fs in features]
        rng = np.random.default_rng(seed)
        seen, seen_bias = np.full(self.size, 1e-6), 1e-6
        for _ in range(rounds):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), 64):
                block = order[at : at + 64]
                part = [rows[i] for i in block]
                error = 1 / (1 + np.exp(-np.clip(self._score(part), -30, 30))) - labels[block]
                counts = np.array([len(r) for r in part])
                flat = np.fromiter((i for r in part for i in r), np.int64, counts.sum())
                slots, back = np.unique(flat, return_inverse=True)
                step = np.bincount(back, np.repeat(error, counts), len(slots)) / len(block) + shrink * self.weight[slots]
                seen[slots] += step**2
                self.weight[slots] -= rate * step / np.sqrt(seen[slots])
                seen_bias += error.mean() ** 2
                self.bias -= rate * error.mean() / np.sqrt(seen_bias)
        return self

    def logit(self, features: list[list[str]]) -> np.ndarray:
        return np.clip(self._score([[self.slot(f) for f in fs] for fs in features]), -30, 30)

    def probability(self, features: list[list[str]]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(features)))
