"""Gradient-boosted regression trees in numpy, with monotonic constraints.

Trees are grown level by level on binned features for the logistic loss. A
constraint of +1 (-1) on a feature lets the score only rise (fall) with it: a
split against the direction is refused, and the middle of the two children's
values bounds everything below them. A fitted model is flat arrays of nodes;
scoring walks all rows through a tree together, one level a step.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Forest:
    """Node arrays of all trees; node ``i`` of a complete tree has the children 2i+1 and 2i+2."""

    base: float
    depth: int
    feature: np.ndarray  # trees x inner nodes; -1: this node's rows all go left
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                right = (f >= 0) & (x[rows, np.maximum(f, 0)] > threshold[node])
                node = 2 * node + 1 + right
            out += value[node - (2**self.depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: dict[int, int] | None = None,
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 64,
    penalty: float = 1.0,
    least: int = 5,
) -> Forest:
    """Fit labels 0/1. Without rows, or with one label only, every score is the prior."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    prior = (y.sum() + 0.5) / (len(y) + 1.0)
    inner, leaves = 2**depth - 1, 2**depth
    forest = Forest(float(np.log(prior / (1 - prior))), depth, np.full((trees, inner), -1), np.zeros((trees, inner)), np.zeros((trees, leaves)))
    if len(y) == 0 or y.min() == y.max():
        return forest
    signs = np.zeros(x.shape[1], int)
    for f, sign in (monotone or {}).items():
        signs[f] = sign
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    width = max(len(c) for c in cuts) + 1
    total = np.full(len(y), forest.base)
    for t in range(trees):
        p = sigmoid(total)
        slope, bend = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-9)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                key = (node - first) * width + binned[:, f]
                tables = [np.bincount(key, w, count * width).reshape(count, width).cumsum(axis=1) for w in (slope, bend, None)]
                (gl, hl, nl), (ga, ha, na) = [a[:, : len(c)] for a in tables], [a[:, -1:] for a in tables]
                gr, hr, nr = ga - gl, ha - hl, na - nl
                span = slice(first, first + count)
                lo, hi = low[span, None], high[span, None]
                left, right = np.clip(gl / (hl + penalty), lo, hi), np.clip(gr / (hr + penalty), lo, hi)
                stay = np.clip(ga / (ha + penalty), lo, hi)
                worth = lambda g, h, v: g * v - (h + penalty) * v * v / 2
                gain = worth(gl, hl, left) + worth(gr, hr, right) - worth(ga, ha, stay)
                gain[(nl < least) | (nr < least) | (signs[f] * (right - left) < 0)] = -np.inf
                at = gain.argmax(axis=1)
                for k in np.flatnonzero(gain[np.arange(count), at] > best):
                    best[k] = gain[k, at[k]]
                    forest.feature[t, first + k], forest.threshold[t, first + k] = f, c[at[k]]
                    i, middle = first + k, (left[k, at[k]] + right[k, at[k]]) / 2
                    for child in (2 * i + 1, 2 * i + 2):
                        low[child], high[child] = low[i], high[i]
                    if signs[f]:
                        below, above = (2 * i + 1, 2 * i + 2) if signs[f] > 0 else (2 * i + 2, 2 * i + 1)
                        high[below], low[above] = middle, middle
            for k in range(count):
                if forest.feature[t, first + k] < 0:
                    low[2 * (first + k) + 1], high[2 * (first + k) + 1] = low[first + k], high[first + k]
            f = forest.feature[t, node]
            node = 2 * node + 1 + ((f >= 0) & (x[np.arange(len(y)), np.maximum(f, 0)] > forest.threshold[t, node]))
        leaf = node - inner
        g, h = np.bincount(leaf, slope, leaves), np.bincount(leaf, bend, leaves)
        forest.value[t] = rate * np.clip(g / (h + penalty), low[inner:], high[inner:])
        total += forest.value[t, leaf]
    return forest
