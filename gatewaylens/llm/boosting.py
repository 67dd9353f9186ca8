"""Gradient-boosted trees for a few thousand rows of small numeric features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: per inner node a feature and a limit (above it: right), per leaf a value."""

    bias: float
    features: np.ndarray
    limits: np.ndarray
    leaves: np.ndarray

    def probability(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.bias)
        inner = self.features.shape[1]
        for feature, limit, leaf in zip(self.features, self.limits, self.leaves):
            node = np.zeros(len(rows), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (rows[np.arange(len(rows)), feature[node]] > limit[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(rows: np.ndarray, target: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss; ties between splits go to the first feature and lowest limit."""
    rate_of = np.clip(target.mean() if len(target) else 0.5, 1e-6, 1 - 1e-6)
    bias = float(np.log(rate_of / (1 - rate_of)))
    inner = 2 ** depth - 1
    cuts = [np.unique(column)[:-1] if len(column) else np.empty(0) for column in rows.T]
    margin = np.full(len(rows), bias)
    features, limits, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = target - p, p * (1 - p)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(rows), np.int64)
        for n in range(inner):
            here = node == n
            best = 1e-9
            g, h = slope[here].sum(), curve[here].sum()
            for f, options in enumerate(cuts):
                column = rows[here, f]
                for cut in options[:: max(1, len(options) // 16)]:
                    right = column > cut
                    gr, hr = slope[here][right].sum(), curve[here][right].sum()
                    gain = (g - gr) ** 2 / (h - hr + ridge) + gr ** 2 / (hr + ridge) - g ** 2 / (h + ridge)
                    if gain > best + 1e-9:
                        best, feature[n], limit[n] = gain, f, cut
            node[here] = 2 * n + 1 + (rows[here, feature[n]] > limit[n])
        place = node - inner
        size = 2 ** depth
        value = rate * np.bincount(place, slope, size) / (np.bincount(place, curve, size) + ridge)
        margin += value[place]
        features.append(feature)
        limits.append(limit)
        leaves.append(value)
    return Trees(bias, np.array(features), np.array(limits), np.array(leaves))
