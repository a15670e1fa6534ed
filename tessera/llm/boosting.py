"""Gradient-boosted trees and isotonic calibration in numpy, for a bounded training table."""

import numpy as np


class Boosted:
    """Trees of fixed depth on quantile bins, logistic loss.  Plain arrays, so it can be broadcast."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 5.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        n, m = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        codes = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)
        share = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(n, self.base)
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.feature, self.cut, self.value = np.zeros((self.rounds, inner), np.int32), np.full((self.rounds, inner), np.inf), np.zeros((self.rounds, leaves))
        for t in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first = 2**level - 1
                for k in range(2**level):
                    rows = np.flatnonzero(node == k)
                    best = (1e-6, 0, np.inf)
                    g, h = grad[rows].sum(), hess[rows].sum()
                    for j in range(m) if len(rows) >= 2 * self.least else ():
                        size = len(self.edges[j]) + 1
                        gs = np.cumsum(np.bincount(codes[rows, j], grad[rows], size))[:-1]
                        hs = np.cumsum(np.bincount(codes[rows, j], hess[rows], size))[:-1]
                        ns = np.cumsum(np.bincount(codes[rows, j], minlength=size))[:-1]
                        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                        gain[(ns < self.least) | (len(rows) - ns < self.least)] = 0
                        if len(gain) and gain.max() > best[0]:
                            best = (gain.max(), j, self.edges[j][int(gain.argmax())])
                    self.feature[t, first + k], self.cut[t, first + k] = best[1], best[2]
                node = 2 * node + (x[np.arange(n), self.feature[t, first + node]] > self.cut[t, first + node])
            g, h = np.bincount(node, grad, leaves), np.bincount(node, hess, leaves)
            self.value[t] = self.rate * g / (h + 1)
            margin += self.value[t][node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities."""
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            margin += value[node]
        return 1 / (1 + np.exp(-margin))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, share) of the monotone fit by pooling adjacent violators."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # sum of scores, sum of labels, weight
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        pools.append([s, v, 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])
