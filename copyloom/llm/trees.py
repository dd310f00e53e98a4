"""Gradient-boosted trees for two classes, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: inner nodes level by level, then leaves."""

    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray  # trees x inner nodes; larger values go right
    value: np.ndarray  # trees x leaves
    base: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rows of features."""
        inner = self.feature.shape[1]
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < inner:  # all rows are on one level
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += value[node - inner]
        return out


def fit_trees(
    x: np.ndarray,
    y: np.ndarray,
    count: int = 120,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    smooth: float = 2.0,
) -> Trees:
    """Boosting on the logistic loss, with splits between feature quantiles."""
    n, width = x.shape
    limits = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(limits[f], x[:, f], side="left") for f in range(width)], axis=1)
    share = np.clip(y.mean() if n else 0.5, 1e-4, 1 - 1e-4)
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    inner = (1 << depth) - 1
    features, cuts, values = [], [], []
    for _ in range(count):
        p = 1 / (1 + np.exp(-margin))
        grad, curve = y - p, p * (1 - p)
        feature = np.zeros(inner, np.int64)
        cut = np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            start, nodes = (1 << level) - 1, 1 << level
            place = node - start
            total_g = np.bincount(place, grad, nodes)
            total_h = np.bincount(place, curve, nodes)
            best = np.full(nodes, 1e-6)
            for f in range(width):
                if not len(limits[f]):
                    continue
                size = len(limits[f]) + 1
                at = place * size + binned[:, f]
                g = np.bincount(at, grad, nodes * size).reshape(nodes, size).cumsum(axis=1)[:, :-1]
                h = np.bincount(at, curve, nodes * size).reshape(nodes, size).cumsum(axis=1)[:, :-1]
                rest_g, rest_h = total_g[:, None] - g, total_h[:, None] - h
                gain = g**2 / (h + smooth) + rest_g**2 / (rest_h + smooth)
                gain -= (total_g**2 / (total_h + smooth))[:, None]
                gain[(h < 1) | (rest_h < 1)] = 0
                top = gain.argmax(axis=1)
                better = np.flatnonzero(gain[np.arange(nodes), top] > best)
                best[better] = gain[better, top[better]]
                feature[start + better] = f
                cut[start + better] = limits[f][top[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        g = np.bincount(leaf, grad, inner + 1)
        h = np.bincount(leaf, curve, inner + 1)
        value = rate * g / (h + smooth)
        margin += value[leaf]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Trees(np.array(features), np.array(cuts), np.array(values), base)


def fit_isotonic(
    score: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators: points between which a calibrated score is read off.

    `weights` (above 0) say how many rows each one stands for.
    """
    weights = np.ones(len(y)) if weights is None else weights
    at, place = np.unique(score, return_inverse=True)
    weight = np.bincount(place, weights)
    mean = np.bincount(place, y * weights) / weight
    pools: list[list[float]] = []  # mean, weight, first, last
    for m, w, s in zip(mean, weight, at):
        pools.append([m, w, s, s])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m2, w2, _, last = pools.pop()
            m1, w1, first, _ = pools.pop()
            pools.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, first, last])
    points = [(s, m) for m, _, first, last in pools for s in ((first, last) if first < last else (first,))]
    return np.array([p[0] for p in points]), np.array([p[1] for p in points])
