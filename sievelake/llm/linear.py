"""Linear support vector machines on the driver, over a bounded sample of labelled rows."""

from __future__ import annotations

from itertools import combinations

import numpy as np


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: float = 8.0, steps: int = 250) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2/2 + cost/n * sum max(0, 1 - y (w x + b))^2, by accelerated gradient steps.

    The classes weigh alike, however many rows each has.
    """
    x, y = np.ascontiguousarray(x, np.float32), y.astype(np.float32)
    d = x.shape[1]
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    v = np.full(d, d**-0.5, np.float32)
    for _ in range(12):  # the largest eigenvalue of the weighted Gram matrix bounds the curvature
        v = (share * (x @ v)) @ x
        top = float(np.linalg.norm(v))
        v /= top or 1
    rate = 1 / (1 + 2 * cost * (top + 1))
    w, b, w0, b0, t = np.zeros(d, np.float32), 0.0, np.zeros(d, np.float32), 0.0, 1.0
    for _ in range(steps):
        slack = share * y * np.maximum(0, 1 - y * (x @ w + np.float32(b)))
        w1, b1 = w - np.float32(rate) * (w - np.float32(2 * cost) * (slack @ x)), b + rate * 2 * cost * float(slack.sum())
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, b = w1 + np.float32((t - 1) / t1) * (w1 - w0), b1 + (t - 1) / t1 * (b1 - b0)
        w0, b0, t = w1, b1, t1
    return w0, float(b0)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def slope(margin: np.ndarray, y: np.ndarray, steps: int = 60) -> float:
    """The steepness that turns a margin into a probability: logistic regression through the origin."""
    a = 1.0
    target = (y > 0).astype(float) * 0.98 + 0.01
    for _ in range(steps):
        p = sigmoid(a * margin)
        curve = (p * (1 - p) * margin * margin).mean() + 1e-6
        a = float(np.clip(a + ((target - p) * margin).mean() / curve, 0.1, 50))
    return a


class OneVersusOne:
    """A machine for each pair of classes; the class with the most votes wins, then the larger sum of margins."""

    def __init__(self, classes: list[str], x: np.ndarray, y: np.ndarray):
        self.classes = classes
        self.pairs = list(combinations(range(len(classes)), 2))
        self.weights = np.zeros((x.shape[1], len(self.pairs)), np.float32)
        self.bias, self.slopes = np.zeros(len(self.pairs)), np.ones(len(self.pairs))
        for j, (a, b) in enumerate(self.pairs):
            own = (y == a) | (y == b)
            sign = np.where(y[own] == a, 1.0, -1.0)
            w, self.bias[j] = squared_hinge(x[own], sign)
            self.weights[:, j] = w
            self.slopes[j] = slope(x[own] @ w + self.bias[j], sign)

    def predict(self, margins: np.ndarray) -> tuple[int, float]:
        """The class's place and its share of the pairwise probabilities; margins as by weights and bias."""
        k = len(self.classes)
        if k == 1:
            return 0, 1.0
        votes, sums, odds = np.zeros(k), np.zeros(k), np.ones(k)
        p = sigmoid(self.slopes * margins)
        for j, (a, b) in enumerate(self.pairs):
            votes[a if margins[j] >= 0 else b] += 1
            sums[a] += margins[j]
            sums[b] -= margins[j]
            odds[a] *= p[j]
            odds[b] *= 1 - p[j]
        best = max(range(k), key=lambda c: (votes[c], sums[c]))
        return best, float(odds[best] / odds.sum())
