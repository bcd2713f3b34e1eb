"""Small learners in numpy: sparse logistic regression, gradient-boosted trees, isotonic calibration.

Everything is deterministic (fixed seeds, full-batch updates), so a model fitted on the driver is the same on each run.
"""

from __future__ import annotations

import numpy as np


def fit_logistic(rows: list[list[int]], labels: np.ndarray, size: int, epochs: int = 120, l2: float = 1e-4, values: list[list[float]] | None = None) -> np.ndarray:
    """Weights over ``size`` features (binary, or with ``values``; feature 0 is the bias) by full-batch Adagrad on the log loss."""
    lens = np.fromiter((len(r) for r in rows), np.int64, len(rows))
    flat = np.fromiter((f for r in rows for f in r), np.int64, int(lens.sum()))
    at = np.repeat(np.arange(len(rows)), lens)
    much = np.ones(len(flat)) if values is None else np.fromiter((v for r in values for v in r), float, len(flat))
    w, g2 = np.zeros(size), np.full(size, 1e-8)
    y = labels.astype(float)
    for _ in range(epochs):
        z = np.bincount(at, weights=w[flat] * much, minlength=len(rows))
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(flat, weights=err[at] * much, minlength=size) / len(rows) + l2 * w
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
    return w


class BoostedTrees:
    """Binary log-loss boosting with depth-limited trees on quantile-binned features (at most 32 bins each)."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.25, min_child: float = 2.0):
        self.rounds, self.depth, self.rate, self.min_child = rounds, depth, rate, min_child

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        n, d = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(d)]
        b = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(n, self.base)
        self.trees = []
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            tree: list = []
            f += self.rate * self._grow(tree, b, y - q, q * (1 - q), np.arange(n), 0)
            self.trees.append(tree)
        return self

    def _grow(self, tree, b, grad, hess, rows, depth):
        """Append this node to ``tree`` (feature, bin, left, right, value); returns the update of every row."""
        at = len(tree)
        g, h = grad[rows].sum(), hess[rows].sum()
        out = np.zeros(len(grad))
        value = g / (h + 1.0)
        tree.append([-1, 0, 0, 0, value])
        best = (1e-6, -1, 0)
        if depth < self.depth and len(rows) > 1:
            for j, e in enumerate(self.edges):
                if not len(e):
                    continue
                k = b[rows, j]
                gs = np.cumsum(np.bincount(k, weights=grad[rows], minlength=len(e) + 1))[:-1]
                hs = np.cumsum(np.bincount(k, weights=hess[rows], minlength=len(e) + 1))[:-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g * g / (h + 1)
                gain[(hs < self.min_child) | (h - hs < self.min_child)] = -1
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], j, i)
        if best[1] < 0:
            out[rows] = value
            return out
        _, j, i = best
        left = b[rows, j] <= i
        tree[at][:2] = [j, i]
        tree[at][2] = len(tree)
        out += self._grow(tree, b, grad, hess, rows[left], depth + 1)
        tree[at][3] = len(tree)
        out += self._grow(tree, b, grad, hess, rows[~left], depth + 1)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for every row."""
        if not len(x):
            return np.zeros(0)
        b = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for tree in self.trees:
            t = np.array(tree)
            feat, cut, left, right = (t[:, k].astype(int) for k in range(4))
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                j = feat[node]
                go = b[rows, np.maximum(j, 0)] <= cut[node]
                node = np.where(j < 0, node, np.where(go, left[node], right[node]))
            f += self.rate * t[node, 4]
        return 1 / (1 + np.exp(-f))


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (ascending scores, calibrated probabilities) for ``np.interp``."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, y in zip(score[order], label[order], strict=True):
        blocks.append([s, float(y), 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            s1, y1, n1 = blocks.pop()
            blocks[-1] = [s1, blocks[-1][1] + y1, blocks[-1][2] + n1]
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])
