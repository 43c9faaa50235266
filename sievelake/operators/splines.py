"""Adaptive regression splines: least squares on hinges max(0, x - t) and max(0, t - x) whose knots t are found step by step.

Forward, every step takes the pair of hinges that lowers the squared error most. One aggregate a step has what that needs of all
candidates: the products of each hinge with itself, with the terms chosen so far and with the target; the error that a pair would
leave follows on the driver. Backward, terms are dropped one by one from the sums of the chosen ones, and the set with the least
generalised cross-validation stays. Candidate knots are quantiles of each column, every value where there are few, kept apart from
one another and from the ends by spans that grow slowly with the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions.stats import number, numeric_columns
from sievelake.operators.evaluate import BaseRegressionEvaluator, split
from sievelake.plans.shared import written

Term = tuple[int, float, int]  # column, knot, side: 1 for x over the knot, -1 for x under it


def hinges(x: np.ndarray, terms: list[Term]) -> np.ndarray:
    """A column for the intercept and each term."""
    out = np.ones((len(x), len(terms) + 1))
    for i, (j, t, side) in enumerate(terms, 1):
        out[:, i] = np.maximum(side * (x[:, j] - t), 0.0)
    return out


def gains(gram: np.ndarray, target: np.ndarray, cross: np.ndarray, own: np.ndarray, with_y: np.ndarray) -> np.ndarray:
    """By how much each candidate pair lowers the squared error: cross is pairs x 2 x terms, own and with_y pairs x 2.

    The two hinges of a pair are never both over 0, so their product is 0.
    """
    inverse = np.linalg.pinv(gram, rcond=1e-12, hermitian=True)
    along = cross @ inverse
    left = np.einsum("kam,kbm->kab", along, cross)
    rest = -left
    rest[:, [0, 1], [0, 1]] += own
    miss = with_y - along @ target
    scale = np.maximum(own, 1e-300)
    fresh = np.einsum("kaa->ka", rest) > 1e-9 * scale  # else the hinge is a sum of the terms there are
    a, b, c = rest[:, 0, 0], rest[:, 0, 1], rest[:, 1, 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        alone = np.where(fresh, miss**2 / np.einsum("kaa->ka", rest), 0.0)
        det = a * c - b * b
        both = (c * miss[:, 0] ** 2 - 2 * b * miss[:, 0] * miss[:, 1] + a * miss[:, 1] ** 2) / det
    return np.where(fresh.all(1) & (det > 1e-9 * a * c), both, alone.max(1))


class SplineRegressor:
    """terms and weights after fit; `columns` in the order of the terms' first numbers."""

    def __init__(self, columns: list[str], target: str, max_terms: int = 21, knots: int = 64, penalty: float = 3.0, least_gain: float = 1e-3, minspan_alpha: float = 0.05, endspan_alpha: float = 0.05):
        self.columns, self.target, self.max_terms, self.knots = columns, target, max_terms, knots
        self.penalty, self.least_gain, self.minspan_alpha, self.endspan_alpha = penalty, least_gain, minspan_alpha, endspan_alpha

    def candidates(self, rows: DataFrame, n: int) -> list[tuple[int, float]]:
        p = len(self.columns)
        apart = max(1, int(-math.log2(-math.log(1 - self.minspan_alpha) / (p * n)) / 2.5)) if n else 1
        ends = max(0, int(3 - math.log2(self.endspan_alpha / p)))
        shares = [k / n for k in range(ends, n - ends, apart)] if n <= self.knots * apart else [k / (self.knots + 1) for k in range(1, self.knots + 1)]
        shares = [s for s in shares if ends / n <= s <= 1 - ends / n] or [0.5]
        # the sketch is exact while a column has fewer values than its size
        row = rows.agg(*(F.percentile_approx(f"x{j}", shares, 10000).alias(f"q{j}") for j in range(p))).first()
        return [(j, float(t)) for j in range(p) for t in sorted(set(row[f"q{j}"] or ()))]

    def products(self, rows: DataFrame, terms: list[Term], pairs: list[tuple[int, float]]) -> dict[str, np.ndarray]:
        """Sums over all rows, of a size that terms and candidates bound."""
        p, m, k = len(self.columns), len(terms) + 1, len(pairs)
        at, knots = np.array([j for j, _ in pairs], int), np.array([t for _, t in pairs])
        sizes = {"gram": (m, m), "target": (m,), "cross": (2, k, m), "own": (2, k), "with_y": (2, k), "y": (1,)}

        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = {name: np.zeros(size) for name, size in sizes.items()}
            for batch in stream:
                x = np.column_stack([batch.column(i).to_numpy() for i in range(p)])
                y = batch.column(p).to_numpy()
                b = hinges(x, terms)
                out["gram"] += b.T @ b
                out["target"] += b.T @ y
                out["y"] += y @ y
                if k:
                    far = x[:, at] - knots
                    for s, h in enumerate((np.maximum(far, 0.0), np.maximum(-far, 0.0))):
                        out["cross"][s] += h.T @ b
                        out["own"][s] += (h * h).sum(0)
                        out["with_y"][s] += h.T @ y
            yield pa.RecordBatch.from_arrays([pa.array(list(out)), pa.array([v.ravel() for v in out.values()], pa.list_(pa.float64()))], ["name", "v"])

        sums = rows.mapInArrow(run, "name string, v array<double>").select("name", F.posexplode("v").alias("i", "v")).groupBy("name", "i").agg(F.sum("v").alias("v")).collect()
        out = {name: np.zeros(int(np.prod(size))) for name, size in sizes.items()}
        for r in sums:
            out[r.name][r.i] = r.v
        return {name: v.reshape(sizes[name]) for name, v in out.items()}

    def gcv(self, error: float, terms: int, n: int) -> float:
        free = terms + self.penalty * (terms - 1) / 2
        return error / n / (1 - free / n) ** 2 if free < n else math.inf

    def fit(self, df: DataFrame) -> SplineRegressor:
        own = df.select(*(number(c).alias(f"x{j}") for j, c in enumerate(self.columns)), number(self.target).alias("y")).dropna()
        n, middle = own.agg(F.count(F.lit(1)), F.avg("y")).first()
        self.terms, self.weights, self.middle = [], np.zeros(1), middle or 0.0
        if not n:
            return self
        rows = written(own.withColumn("y", F.col("y") - F.lit(self.middle)), "splines")
        pairs, terms = self.candidates(rows, n), []
        sums = self.products(rows, terms, pairs)
        total = before = float(sums["y"][0])
        while len(terms) + 3 <= self.max_terms and pairs:
            gain = gains(sums["gram"], sums["target"], sums["cross"].transpose(1, 0, 2), sums["own"].T, sums["with_y"].T)
            best = int(np.nanargmax(gain))
            if not gain[best] > self.least_gain * total:
                break
            j, t = pairs[best]
            terms += [(j, t, side) for side, own_sum in zip((1, -1), sums["own"][:, best], strict=True) if own_sum > 0]
            pairs = [x for x in pairs if x != (j, t)]
            sums = self.products(rows, terms, pairs)
            before -= gain[best]
            if before <= 1e-12 * total:
                break
        self.terms, self.weights = self.prune(terms, sums, n)
        return self

    def prune(self, terms: list[Term], sums: dict[str, np.ndarray], n: int) -> tuple[list[Term], np.ndarray]:
        gram, target, y = sums["gram"], sums["target"], float(sums["y"][0])

        def solve(kept: list[int]) -> tuple[float, np.ndarray]:
            g = gram[np.ix_(kept, kept)]
            size = np.sqrt(np.maximum(np.diag(g), 1e-300))
            w = np.linalg.pinv(g / np.outer(size, size), rcond=1e-10, hermitian=True) @ (target[kept] / size) / size
            return max(0.0, y - float(2 * w @ target[kept] - w @ g @ w)), w

        kept = list(range(len(terms) + 1))
        error, weights = solve(kept)
        best = (self.gcv(error, len(kept), n), kept, weights)
        while len(kept) > 1:
            tries = [(solve([k for k in kept if k != drop]), drop) for drop in kept[1:]]
            (error, weights), drop = min(tries, key=lambda x: x[0][0])
            kept = [k for k in kept if k != drop]
            best = min(best, (self.gcv(error, len(kept), n), kept, weights), key=lambda x: x[0])
        return [terms[k - 1] for k in best[1][1:]], best[2]

    def prediction(self, columns: list[Column] | None = None) -> Column:
        x = columns or [number(c) for c in self.columns]
        out = F.lit(float(self.weights[0]) + self.middle)
        for (j, t, side), w in zip(self.terms, self.weights[1:], strict=True):
            out = out + F.lit(float(w)) * F.greatest(F.lit(float(side)) * (x[j] - F.lit(t)), F.lit(0.0))
        return out


class MARSEvaluator(BaseRegressionEvaluator):
    """Splines on the training rows, nulls at the training means; every test row is predicted."""

    def predictions(self, df):
        features = self.features or [c for c in numeric_columns(df) if c not in (*self.key, self.target)]
        known = split(df.where(F.col(self.target).isNotNull()), self.key, seed=self.seed)
        means = known.where("split = 'train'").agg(*(F.avg(number(c)).alias(c) for c in features)).first()
        x = [F.coalesce(number(c), F.lit(means[c] or 0.0)) for c in features]
        train = known.where("split = 'train'").select(*(v.alias(c) for v, c in zip(x, features, strict=True)), number(self.target).alias("_y"))
        self.model = SplineRegressor(features, "_y", **self.params).fit(train)
        return known.where("split = 'test'").select(*self.key, number(self.target).alias("label"), self.model.prediction(x).alias("prediction"))
