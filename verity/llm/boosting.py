"""Gradient-boosted trees for two classes, by histograms, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of equal depth as flat arrays: node ``i`` has children ``2i + 1``
    (value at most the threshold) and ``2i + 2``."""

    def __init__(self, trees: int = 70, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 2.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge
        self.base = 0.0
        self.feature = np.zeros((0, 2**depth - 1), np.int64)
        self.threshold = np.zeros((0, 2**depth - 1), np.float32)
        self.leaf = np.zeros((0, 2**depth))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        n, f = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1], method="nearest")) for j in range(f)]
        binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
        cell = binned + np.arange(f) * self.bins
        share = float((weight * y).sum() / weight.sum())
        self.base = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        margin = np.full(n, self.base)
        features, thresholds, leaves = [], [], []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = weight * (y - p), weight * p * (1 - p)
            at = np.zeros(n, np.int64)
            feature, threshold = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf, np.float32)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                flat = ((at - first)[:, None] * (f * self.bins) + cell).ravel()
                shape = (width, f, self.bins)
                gs = np.bincount(flat, np.repeat(g, f), width * f * self.bins).reshape(shape).cumsum(2)
                hs = np.bincount(flat, np.repeat(h, f), width * f * self.bins).reshape(shape).cumsum(2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                score = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                score[(hs < 1e-3) | (ht - hs < 1e-3)] = 0
                best = score.reshape(width, -1).argmax(1)
                for k in range(width):
                    j, b = divmod(int(best[k]), self.bins)
                    if score[k, j, b] > 1e-9 and b < len(edges[j]):
                        feature[first + k], threshold[first + k] = j, edges[j][b]
                at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
            at -= 2**self.depth - 1
            leaf = self.rate * np.bincount(at, g, 2**self.depth) / (np.bincount(at, h, 2**self.depth) + self.ridge)
            margin += leaf[at]
            features.append(feature)
            thresholds.append(threshold)
            leaves.append(leaf)
        self.feature, self.threshold, self.leaf = np.array(features), np.array(thresholds), np.array(leaves)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1."""
        if not len(self.feature):
            return np.full(len(x), self.base)
        at = np.zeros((len(x), len(self.feature)), np.int64)  # every tree at once
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        return self.base + self.leaf[trees, at - (2**self.depth - 1)].sum(1)
