"""Gradient-boosted trees for two classes: Newton steps on histograms of binned features.

Training sees a bounded sample as a matrix; what comes out is a few small arrays, so scoring needs nothing but them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ROUNDS, DEPTH, BINS, RATE, RIDGE, LEAST = 80, 4, 32, 0.2, 1.0, 5.0


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: node i of a tree asks whether a feature is above a limit and goes on to 2 i + 1 or 2 i + 2."""

    start: float
    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += leaf[node - inner]
        return out


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Limits between the bins of each feature: of distinct values at evenly spaced ranks."""
    out = []
    for column in x.T:
        values = np.unique(column)
        between = (values[1:] + values[:-1]) / 2
        if len(between) >= bins:
            ranks = np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])
            between = np.unique(between[np.clip(np.searchsorted(between, ranks), 0, len(between) - 1)])
        out.append(between)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, ridge: float = RIDGE, least: float = LEAST) -> Trees:
    """``y``: 1 or 0. Without rows of both classes the trees are empty and only the share of ones counts."""
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    start, inner = float(np.log(share / (1 - share))), 2**depth - 1
    if len(np.unique(y)) < 2:
        return Trees(start, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = _edges(x, bins)
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], 1)
    wide, columns = bins + 1, x.shape[1]
    cells = binned + wide * np.arange(columns)
    odds, features, limits, leaves = np.full(len(y), start), [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-odds))
        slope, bend = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            spot = ((node - first)[:, None] * (columns * wide) + cells).ravel()
            size = count * columns * wide
            g, h = (np.bincount(spot, np.repeat(v, columns), size).reshape(count, columns, wide).cumsum(2) for v in (slope, bend))
            total_g, total_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
            gain[(h < least) | (total_h - h < least)] = 0
            best = gain.reshape(count, -1).argmax(1)
            for k in np.nonzero(gain.reshape(count, -1)[np.arange(count), best] > 1e-9)[0]:
                f, b = divmod(int(best[k]), wide)
                feature[first + k], limit[first + k] = f, edges[f][b] if b < len(edges[f]) else np.inf
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > limit[node])
        at = node - inner
        leaf = rate * np.bincount(at, slope, inner + 1) / (np.bincount(at, bend, inner + 1) + ridge)
        odds += leaf[at]
        features.append(feature)
        limits.append(limit)
        leaves.append(leaf)
    return Trees(start, np.array(features), np.array(limits), np.array(leaves))
