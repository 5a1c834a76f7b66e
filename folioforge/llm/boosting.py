"""Gradient-boosted trees for two classes, small enough to train on the driver."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic-loss boosting of shallow trees on cut points taken from the quantiles of each feature."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, cuts: int = 16, least: float = 2.0):
        self.trees, self.depth, self.rate, self.cuts, self.least = trees, depth, rate, cuts, least
        self.base, self.model = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, float), np.asarray(y, float)
        mean = np.clip(y.mean(), 0.01, 0.99)
        self.base = float(np.log(mean / (1 - mean)))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.cuts + 1)[1:-1])) for c in x.T]
        codes = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)])
        raw = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(codes, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.model.append(tree)
            raw += self._walk(tree, x)
        return self

    def _grow(self, codes: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> tuple | float:
        sg, sh = g[rows].sum(), h[rows].sum()
        leaf = self.rate * float(sg / (sh + 1))
        if not depth or len(rows) < 8:
            return leaf
        best = (1e-6, -1, 0)
        for j, edges in enumerate(self.edges):
            if not len(edges):
                continue
            left_g = np.bincount(codes[rows, j], g[rows], len(edges) + 1).cumsum()[:-1]
            left_h = np.bincount(codes[rows, j], h[rows], len(edges) + 1).cumsum()[:-1]
            gain = left_g**2 / (left_h + 1) + (sg - left_g) ** 2 / (sh - left_h + 1) - sg**2 / (sh + 1)
            gain[(left_h < self.least / 4) | (sh - left_h < self.least / 4)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
        _, j, k = best
        if j < 0:
            return leaf
        low = codes[rows, j] <= k
        return j, float(self.edges[j][k]), self._grow(codes, g, h, rows[low], depth - 1), self._grow(codes, g, h, rows[~low], depth - 1)

    def _walk(self, tree: tuple | float, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, cut, low, high = tree
        return np.where(x[:, j] <= cut, self._walk(low, x), self._walk(high, x))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the second class."""
        x = np.asarray(x, float)
        raw = np.full(len(x), self.base)
        for tree in self.model:
            raw += self._walk(tree, x)
        return 1 / (1 + np.exp(-raw))
