"""A random forest in numpy, for a bounded training table."""

import numpy as np


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 8, least: int = 4, seed: int = 5) -> list[list[tuple]]:
    """Trees as lists of nodes (feature, cut, left, right) or (-1, share, 0, 0); plain values."""
    rng = np.random.default_rng(seed)
    tried = max(1, int(np.sqrt(x.shape[1])) + 1)
    out = []
    for _ in range(trees):
        nodes: list[tuple] = []
        todo = [(rng.integers(0, len(y), len(y)), 0, -1, 0)]
        while todo:
            rows, level, parent, side = todo.pop()
            here, share = len(nodes), float(y[rows].mean()) if len(rows) else 0.0
            best = None
            if level < depth and len(rows) >= 2 * least and 0 < share < 1:
                for j in rng.choice(x.shape[1], tried, replace=False).tolist():
                    order = rows[np.argsort(x[rows, j], kind="stable")]
                    v, hits = x[order, j], np.cumsum(y[order])
                    n = np.arange(1, len(order))
                    p, q = hits[:-1] / n, (hits[-1] - hits[:-1]) / (len(order) - n)
                    impurity = n * p * (1 - p) + (len(order) - n) * q * (1 - q)
                    impurity[(v[:-1] == v[1:]) | (n < least) | (len(order) - n < least)] = np.inf
                    k = int(impurity.argmin())
                    if np.isfinite(impurity[k]) and (best is None or impurity[k] < best[0]):
                        best = (impurity[k], j, (v[k] + v[k + 1]) / 2)
            nodes.append((-1, share, 0, 0) if best is None else (best[1], best[2], 0, 0))
            if parent >= 0:
                f, c, left, right = nodes[parent]
                nodes[parent] = (f, c, here, right) if side == 0 else (f, c, left, here)
            if best is not None:
                low = x[rows, best[1]] <= best[2]
                todo += [(rows[~low], level + 1, here, 1), (rows[low], level + 1, here, 0)]
        out.append(nodes)
    return out


def predict(forest: list[list[tuple]], x: np.ndarray) -> np.ndarray:
    """Mean share of the leaves."""
    total = np.zeros(len(x))
    for nodes in forest:
        feature, cut, left, right = (np.array([n[i] for n in nodes]) for i in range(4))
        at = np.zeros(len(x), np.int64)
        while (inner := feature[at] >= 0).any():
            r = np.flatnonzero(inner)
            low = x[r, feature[at[r]]] <= cut[at[r]]
            at[r] = np.where(low, left[at[r]], right[at[r]])
        total += cut[at]
    return total / max(len(forest), 1)
