"""Gradient-boosted trees for two classes on small dense tables, by binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Sum of trees; a tree is (feature, cut, left, right, value) by node, a leaf has feature -1."""

    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, left, right, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                goes = x[rows, np.maximum(f, 0)] <= cut[node]
                node = np.where(inner, np.where(goes, left[node], right[node]), node)
            total += value[node]
        return total


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0, least: float = 2.0) -> Boosted:
    """Newton boosting on logistic loss; cuts are at quantiles of each feature. One class only gives a constant."""
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    model = Boosted(float(np.log(mean / (1 - mean))), [])
    if len(y) == 0 or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for k in range(x.shape[1])]
    binned = [np.searchsorted(c, x[:, k], side="left").astype(np.int16) for k, c in enumerate(cuts)]
    wide = bins + 1
    margin = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut, left, right, value = [], [], [], [], []

        def grow(rows: np.ndarray, level: int, g: np.ndarray = g, h: np.ndarray = h) -> int:
            at = len(feature)
            gs, hs = g[rows].sum(), h[rows].sum()
            for column, v in ((feature, -1), (cut, 0.0), (left, at), (right, at), (value, -rate * gs / (hs + ridge))):
                column.append(v)
            if level == depth or len(rows) < 2:
                return at
            gr, hr = g[rows], h[rows]
            sums_g = np.stack([np.bincount(column[rows], gr, wide) for column in binned]).cumsum(1)
            sums_h = np.stack([np.bincount(column[rows], hr, wide) for column in binned]).cumsum(1)
            gain = sums_g**2 / (sums_h + ridge) + (gs - sums_g) ** 2 / (hs - sums_h + ridge) - gs**2 / (hs + ridge)
            gain[(sums_h < least * 0.05) | (hs - sums_h < least * 0.05)] = -1
            for k, c in enumerate(cuts):
                gain[k, len(c) :] = -1
            best = int(gain.argmax())
            k, b = divmod(best, wide)
            if gain[k, b] <= 1e-6:
                return at
            goes = binned[k][rows] <= b
            feature[at], cut[at] = k, float(cuts[k][b])
            left[at] = grow(rows[goes], level + 1)
            right[at] = grow(rows[~goes], level + 1)
            return at

        grow(np.arange(len(y)), 0)
        tree = (np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value))
        model.trees.append(tree)
        margin += Boosted(0.0, [tree]).margin(x)
    return model
