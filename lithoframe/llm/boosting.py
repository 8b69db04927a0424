"""Gradient-boosted trees for two classes on a bounded sample, small enough to send to every task."""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    feature: np.ndarray    # (trees, inner nodes); children of node k are 2k + 1 and 2k + 2
    cut: np.ndarray        # right if above
    leaf: np.ndarray       # (trees, leaves)
    start: float

    def to_bytes(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, feature=self.feature, cut=self.cut, leaf=self.leaf, start=self.start)
        return held.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Trees:
        held = np.load(io.BytesIO(data))
        return Trees(held["feature"], held["cut"], held["leaf"], float(held["start"]))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total, rows, inner = np.full(len(x), self.start), np.arange(len(x)), self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:  # the trees are complete: all rows reach the leaves together
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += leaf[at - inner]
        return total


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int, depth: int, rate: float, bins: int = 32,
        ridge: float = 5.0) -> Trees:
    """Second-order boosting on features cut at quantiles, complete trees of a fixed depth."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    mean = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    inner, margin = (1 << depth) - 1, np.full(n, start)
    features, cuts, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h, at = weight * (y - p), weight * p * (1 - p), np.zeros(n, np.int64)
        for level in range(depth):
            first, k = (1 << level) - 1, 1 << level
            best = np.zeros(k)
            for j in range(d):
                if not len(edges[j]):
                    continue
                key = (at - first) * bins + code[:, j]
                gs = np.bincount(key, g, k * bins).reshape(k, bins).cumsum(axis=1)
                hs = np.bincount(key, h, k * bins).reshape(k, bins).cumsum(axis=1)
                left, right = gs[:, :-1], gs[:, -1:] - gs[:, :-1]
                gain = (left ** 2 / (hs[:, :-1] + ridge) + right ** 2 / (hs[:, -1:] - hs[:, :-1] + ridge)
                        - gs[:, -1:] ** 2 / (hs[:, -1:] + ridge))[:, :len(edges[j])]
                top = gain.argmax(axis=1)
                value = gain[np.arange(k), top]
                for node in np.flatnonzero(value > best + 1e-12):
                    best[node] = value[node]
                    features[t, first + node], cuts[t, first + node] = j, edges[j][top[node]]
            at = 2 * at + 1 + (x[np.arange(n), features[t, at]] > cuts[t, at])
        gs, hs = np.bincount(at - inner, g, inner + 1), np.bincount(at - inner, h, inner + 1)
        leaves[t] = rate * gs / (hs + ridge)
        margin = margin + leaves[t][at - inner]
    return Trees(features, cuts, leaves, start)
