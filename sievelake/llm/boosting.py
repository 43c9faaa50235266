"""Gradient-boosted trees over dense features and isotonic calibration, fitted on the driver over a bounded sample."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of a fixed depth on the logistic loss, split on histograms of quantile bins with second-order gains."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, shrink: float = 2.0):
        self.depth, self.rate = depth, rate
        n, d = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(d)], axis=1)  # bin b: x <= cut b
        rate_of_ones = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
        margin = np.full(n, self.base)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        width = bins + 1
        flat = binned + np.arange(d) * width
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            inner = 2**depth - 1
            feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(n, np.int64)
            for level in range(depth):
                first, count = 2**level - 1, 2**level
                slot = ((node - first)[:, None] * (d * width) + flat).ravel()
                sums = [np.bincount(slot, np.repeat(v, d), count * d * width).reshape(count, d, width).cumsum(axis=2) for v in (g, h)]
                left_g, left_h = sums[0][:, :, :-1], sums[1][:, :, :-1]
                all_g, all_h = sums[0][:, :, -1:], sums[1][:, :, -1:]
                gain = left_g**2 / (left_h + shrink) + (all_g - left_g) ** 2 / (all_h - left_h + shrink) - all_g**2 / (all_h + shrink)
                gain[(left_h < 1) | (all_h - left_h < 1)] = -1
                for k in range(count):
                    best = int(gain[k].argmax())
                    j, b = divmod(best, width - 1)
                    if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                        feature[first + k], threshold[first + k] = j, cuts[j][b]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
            leaf = node - inner
            value = np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + shrink)
            self.trees.append((feature, threshold, value * rate))
            margin += value[leaf] * rate

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - len(feature)]
        return out


class Isotonic:
    """The non-decreasing function closest to the labels (pool adjacent violators), linear between its blocks.

    A block of more than one row also counts half a row of either label; one of a single row keeps its label, so a score may be 0 or 1.
    """

    def __init__(self, score: np.ndarray, y: np.ndarray):
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # [sum of labels, rows, sum of scores]
        for s, v in zip(score[order], y[order], strict=True):
            blocks.append([float(v), 1.0, float(s)])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
        self.at = np.array([b[2] / b[1] for b in blocks])
        self.value = np.maximum.accumulate([(b[0] + 0.5) / (b[1] + 1) if b[1] > 1 else b[0] / b[1] for b in blocks]) if blocks else np.zeros(0)

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(score, self.at, self.value), 0, 1) if len(self.at) else np.zeros(len(score))
