"""Gradient-boosted trees for two classes, in numpy, over features cut into bins.

Trees are grown depth by depth with the usual second-order gain; a tree is stored as arrays of
a complete binary tree, so a prediction is ``depth`` array look-ups a tree.
"""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, smooth: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.smooth = trees, depth, rate, bins, smooth
        self.cuts: list[np.ndarray] = []
        self.grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        columns = [np.searchsorted(cut, x[:, f], "left") for f, cut in enumerate(self.cuts)]
        return np.stack(columns, 1) if columns else np.zeros((len(x), 0), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        weight = np.ones(len(y)) if weight is None else weight
        quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, f], quantiles, method="lower")) for f in range(x.shape[1])]
        binned = self._binned(x)
        share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6))
            self.grown.append(tree)
            score += self._leaf(binned, tree)
        return self

    def _grow(self, binned, gradient, curvature):
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, self.bins, np.int64)
        node = np.zeros(len(binned), np.int64)  # number within the level
        for level in range(self.depth):
            nodes, first = 2**level, 2**level - 1
            best = np.full(nodes, 1e-9)
            total_g = np.bincount(node, gradient, nodes)
            total_h = np.bincount(node, curvature, nodes)
            base = total_g**2 / (total_h + self.smooth)
            for f in range(binned.shape[1]):
                at = node * self.bins + binned[:, f]
                g = np.bincount(at, gradient, nodes * self.bins).reshape(nodes, -1).cumsum(1)[:, :-1]
                h = np.bincount(at, curvature, nodes * self.bins).reshape(nodes, -1).cumsum(1)[:, :-1]
                rest_g, rest_h = total_g[:, None] - g, total_h[:, None] - h
                gain = g**2 / (h + self.smooth) + rest_g**2 / (rest_h + self.smooth) - base[:, None]
                gain[(h < 1e-3) | (rest_h < 1e-3)] = -1
                top = gain.argmax(1)
                value = gain[np.arange(nodes), top]
                better = value > best
                best = np.where(better, value, best)
                feature[first : first + nodes][better] = f
                cut[first : first + nodes][better] = top[better]
            own = first + node
            node = node * 2 + (binned[np.arange(len(binned)), feature[own]] > cut[own])
        g = np.bincount(node, gradient, 2**self.depth)
        h = np.bincount(node, curvature, 2**self.depth)
        return feature, cut, -self.rate * g / (h + self.smooth)

    def _leaf(self, binned: np.ndarray, tree) -> np.ndarray:
        feature, cut, value = tree
        node, row = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for _ in range(self.depth):
            node = 2 * node + 1 + (binned[row, feature[node]] > cut[node])
        return value[node - (2**self.depth - 1)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1."""
        binned = self._binned(x)
        return self.start + sum((self._leaf(binned, t) for t in self.grown), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.score(x), -30, 30)))


def calibrate(score: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and shift of a logistic curve over scores (Platt), by damped Newton steps."""
    a, b = 1.0, 0.0
    # Smoothed targets keep the slope finite where the classes are apart.
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))

    def loss(a: float, b: float) -> float:
        z = a * score + b
        return float((np.logaddexp(0, z) - target * z).sum())

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        g = np.array([((p - target) * score).sum(), (p - target).sum()])
        w = p * (1 - p)
        h = np.array([[(w * score**2).sum(), (w * score).sum()], [(w * score).sum(), w.sum()]])
        step = np.linalg.solve(h + 1e-3 * np.eye(2), g)
        now, size = loss(a, b), 1.0
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if size <= 1e-6 or abs(size * step).max() < 1e-8:
            break
    return float(a), float(b)
