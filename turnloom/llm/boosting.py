"""Gradient-boosted trees on binned features, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth; raw scores are log-odds."""

    base: float
    depth: int
    feature: np.ndarray  # (trees, 2**depth - 1)
    cut: np.ndarray  # go right where value > cut
    leaf: np.ndarray  # (trees, 2**depth)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (2**self.depth - 1)]
        return out


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="lower"))
    return (values[:-1] + values[1:]) / 2


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, smooth: float = 5.0, least: int = 10) -> Trees:
    """Second-order boosting of the logistic loss; the same rows give the same trees."""
    n, width = x.shape
    edges = [_edges(x[:, j], bins) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    size = max((len(e) for e in edges), default=0) + 1
    mean = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(mean / (1 - mean)))
    score = np.full(n, base)
    inner = 2**depth - 1
    features, cuts, leaves = [], [], []
    offset = np.arange(width) * size
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                own = np.flatnonzero(at == node)
                if len(own) < 2 * least:
                    continue
                slot = (binned[own] + offset).ravel()
                sums = [np.bincount(slot, np.repeat(w, width), width * size).reshape(width, size).cumsum(1) for w in (g[own], h[own], np.ones(len(own)))]
                left = [s[:, :-1] for s in sums]
                right = [s[:, -1:] - s[:, :-1] for s in sums]
                gain = left[0] ** 2 / (left[1] + smooth) + right[0] ** 2 / (right[1] + smooth)
                gain[(left[2] < least) | (right[2] < least)] = -np.inf
                best = int(np.argmax(gain))
                j, b = divmod(best, size - 1)
                total = g[own].sum() ** 2 / (h[own].sum() + smooth)
                if gain.flat[best] > total + 1e-9 and b < len(edges[j]):
                    feature[node], cut[node] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        at -= inner
        leaf = -rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + smooth)
        score += leaf[at]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Trees(base, depth, np.array(features), np.array(cuts), np.array(leaves))


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y to raw, by pooling adjacent violators.

    A score is read between the middles of the pools, so that it still grows inside a pool's reach.
    """
    order = np.argsort(raw, kind="stable")
    levels, first = np.unique(raw[order], return_index=True)
    weight = np.diff(first, append=len(raw)).astype(float)
    total = np.add.reduceat(y[order].astype(float), first)
    pools: list[list[float]] = []  # mean, weight, sum of weight * raw
    for v, w, t in zip(levels, weight, total, strict=True):
        pools.append([t / w, w, v * w])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m, w1, r = pools.pop()
            a = pools[-1]
            a[0] = (a[0] * a[1] + m * w1) / (a[1] + w1)
            a[1] += w1
            a[2] += r
    return np.array([r / w for _, w, r in pools]), np.array([m for m, _, _ in pools])


def calibrated(raw: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Interpolated, with a rank-keeping share so that no two raw scores tie."""
    fitted = np.interp(raw, *knots)
    return np.clip(0.995 * fitted + 0.005 / (1 + np.exp(-raw)), 0.0, 1.0)
