"""Histogram gradient-boosted trees with logistic loss, in numpy.

Trees are complete to DEPTH, so a forest is three flat arrays and a batch of
rows walks down all of a tree's levels by index arithmetic.
"""

from __future__ import annotations

import numpy as np


class Boosted:
    def __init__(self, trees: int = 80, depth: int = 4, bins: int = 48, rate: float = 0.15, l2: float = 1.0, least: float = 1.0):
        self.trees, self.depth, self.bins, self.rate, self.l2, self.least = trees, depth, bins, rate, l2, least
        inner = 2**depth - 1
        #: By tree and inner node: the column asked, and the value up to which a row goes left. By tree and leaf: what it adds.
        self.column = np.zeros((trees, inner), np.int32)
        self.upto = np.full((trees, inner), np.inf)
        self.adds = np.zeros((trees, inner + 1))
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, f = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.arange(1, self.bins) / self.bins)) for j in range(f)]
        binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)])
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        raw = np.full(n, self.start)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                width, first = 2**level, 2**level - 1
                best = np.full(width, 1e-9)
                split = np.full((width, 2), -1)
                for j in range(f):
                    at = node * self.bins + binned[j]
                    gs = np.bincount(at, g, width * self.bins).reshape(width, -1).cumsum(1)
                    hs = np.bincount(at, h, width * self.bins).reshape(width, -1).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    gain[(hs < self.least) | (ht - hs < self.least)] = 0
                    gain[:, len(edges[j]) :] = 0
                    k = gain.argmax(1)
                    top = gain[np.arange(width), k]
                    new = top > best
                    best[new] = top[new]
                    split[new] = np.stack([np.full(width, j), k], 1)[new]
                right = np.zeros(n, bool)
                for w in range(width):
                    j, k = split[w]
                    if j >= 0:
                        self.column[t, first + w], self.upto[t, first + w] = j, edges[j][k]
                        right |= (node == w) & (binned[j] > k)
                node = node * 2 + right
            gs, hs = np.bincount(node, g, 2**self.depth), np.bincount(node, h, 2**self.depth)
            self.adds[t] = -self.rate * gs / (hs + self.l2)
            raw = raw + self.adds[t][node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row."""
        raw, rows = np.full(len(x), self.start), np.arange(len(x))
        for column, upto, adds in zip(self.column, self.upto, self.adds):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, column[node]] > upto[node])
            raw += adds[node - len(column)]
        return 1 / (1 + np.exp(-raw))
