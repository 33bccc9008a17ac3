"""Gradient-boosted trees for a 0/1 target and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth; edges hold each feature's bin limits."""

    edges: list[np.ndarray]
    base: float
    depth: int
    features: list[np.ndarray] = field(default_factory=list)
    limits: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = self.bins(x)
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for f, t, leaf in zip(self.features, self.limits, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for d in range(self.depth):
                at = (1 << d) - 1 + node
                node = 2 * node + (binned[rows, f[at]] > t[at])
            out += leaf[node]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss over feature histograms."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    mean = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(edges, float(np.log(mean / (1 - mean))), depth)
    binned = model.bins(x)
    width = bins + 1
    margin = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        feats, limits = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, width, np.int64)
        for d in range(depth):
            n = 1 << d
            best = np.full(n, 1e-6)
            for j in range(x.shape[1]):
                key = node * width + binned[:, j]
                g = np.bincount(key, grad, n * width).reshape(n, width).cumsum(axis=1)
                h = np.bincount(key, hess, n * width).reshape(n, width).cumsum(axis=1)
                score = lambda a, b: a * a / (b + ridge)
                gain = score(g, h) + score(g[:, -1:] - g, h[:, -1:] - h) - score(g[:, -1:], h[:, -1:])
                at = gain.argmax(axis=1)
                value = gain[np.arange(n), at]
                better = np.flatnonzero(value > best)
                best[better] = value[better]
                feats[n - 1 + better], limits[n - 1 + better] = j, at[better]
            at = n - 1 + node
            node = 2 * node + (binned[np.arange(len(y)), feats[at]] > limits[at])
        g, h = np.bincount(node, grad, 1 << depth), np.bincount(node, hess, 1 << depth)
        leaf = -rate * g / (h + ridge)
        model.features.append(feats)
        model.limits.append(limits)
        model.leaves.append(leaf)
        margin += leaf[node]
    return model


@dataclass
class Isotonic:
    at: np.ndarray
    value: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.at, self.value)


def isotonic(margin: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; between the pools' means the map is linear."""
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []
    for m, t in zip(margin[order], y[order], strict=True):
        pools.append([float(t), 1.0, float(m)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], a, strict=True)]
    at = np.array([m / n for _, n, m in pools])
    # half a case of either kind keeps scores off 0 and 1
    value = np.maximum.accumulate([(s + 0.5 * (i == len(pools) - 1)) / (n + 1) for i, (s, n, _) in enumerate(pools)])
    return Isotonic(at, value)
