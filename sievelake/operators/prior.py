"""How far a table is from a prior: kernel and energy distances between the rows of two frames, how well a classifier tells them
apart, and tables drawn from a prior of random causal networks to hold them against.

Rows are compared as whole vectors, all of them. Kernel means go by random features (one sum a side and feature), energy distances
by projections on random lines (distribution functions of one number each); both state the error that this leaves. Draws are by
counters, so they are the same on any partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import classification
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.functions.stats import hash_unit, number
from sievelake.operators.distance import areas
from sievelake.operators.evaluate import running_counts
from sievelake.plans.shared import spread, written

# ---- draws


def counted(ident: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Uniform numbers in (0, 1) by row number and draw: a mix of the counter's bits, whatever other rows are drawn beside."""
    x = ident.astype(np.uint64)[:, None] * np.uint64(draws) + np.arange(draws, dtype=np.uint64)
    x = (x + np.uint64((seed + 1) * 0xD1342543DE82EF95 % 2**64)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return ((x ^ x >> np.uint64(31)) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54


def normals(ident: np.ndarray, draws: int, seed: int) -> np.ndarray:
    u = counted(ident, 2 * draws, seed)
    return np.sqrt(-2 * np.log(u[:, :draws])) * np.cos(2 * np.pi * u[:, draws:])


def product(h: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A matrix product whose sums run in one order, so that a row's digits do not depend on the rows beside it."""
    out = np.zeros((len(h), weights.shape[1]))
    for k in range(weights.shape[0]):
        out += h[:, k : k + 1] * weights[k]
    return out


class CausalNetwork:
    """A random network from hidden causes to features: one to three layers of random width, weights and activations, and noise."""

    def __init__(self, features: int, seed: int, index: int):
        rng = np.random.default_rng([seed, index])
        self.features, self.seed, self.index = features, seed, index
        self.causes = int(rng.integers(2, max(3, features + 1)))
        self.layers, width = [], self.causes
        for _ in range(int(rng.integers(1, 4))):
            out = int(rng.integers(max(2, features // 2), 2 * features + 1))
            self.layers.append((rng.standard_normal((width, out)) * rng.uniform(0.5, 2.0) / math.sqrt(width), rng.standard_normal(out) * rng.uniform(0.0, 0.5), int(rng.integers(0, 3))))
            width = out
        self.last = rng.standard_normal((width, features)) * rng.uniform(0.5, 2.0) / math.sqrt(width)
        self.noise = rng.uniform(0.0, 0.3)

    def rows(self, ident: np.ndarray) -> np.ndarray:
        drawn = normals(ident, self.causes + self.features, self.seed * 1_000_003 + self.index)
        h = drawn[:, : self.causes]
        for weights, bias, activation in self.layers:
            h = product(h, weights) + bias
            h = np.tanh(h) if activation == 0 else np.maximum(h, 0.0) if activation == 1 else h
        return product(h, self.last) + self.noise * drawn[:, self.causes :]


def _drawn(spark: SparkSession, n: int, columns: list[str], rows) -> DataFrame:
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            x = rows(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, x.T)], ["id", *columns])

    return spark.range(n).mapInArrow(run, "id long, " + ", ".join(f"`{c}` double" for c in columns))


def prior_sample(spark: SparkSession, n: int, columns: list[str], seed: int = 0, networks: int = 8) -> DataFrame:
    """id and n rows of features, row i from network i mod `networks`."""

    def rows(ident: np.ndarray) -> np.ndarray:
        out = np.zeros((len(ident), len(columns)))
        for index in np.unique(ident % networks):
            own = ident % networks == index
            out[own] = CausalNetwork(len(columns), seed, int(index)).rows(ident[own])
        return out

    return _drawn(spark, n, columns, rows)


def normal_sample(spark: SparkSession, n: int, columns: list[str], seed: int = 0) -> DataFrame:
    """id and n rows of independent standard normal features."""
    return _drawn(spark, n, columns, lambda ident: normals(ident, len(columns), seed))


def standardised(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """key and columns less their means over their population deviations; nulls at 0, constant columns 0."""
    row = df.agg(*(e for i, c in enumerate(columns) for e in (F.avg(number(c)).alias(f"m{i}"), F.stddev_pop(number(c)).alias(f"s{i}")))).first()
    z = ((number(c) - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"] or 1.0) for i, c in enumerate(columns))
    return df.select(key, *(F.coalesce(x, F.lit(0.0)).alias(c) for c, x in zip(columns, z, strict=True)))


# ---- distances


def median_distance(df: DataFrame, columns: list[str], key: list[str], seed: int = 0, each: int = 4) -> float:
    """The median distance of pairs of rows, from the pairs within groups of about `each` rows that a hash of the key puts together.

    A key must tell rows apart: those of one key are in one group.
    """
    n, d = df.count(), len(columns)
    group = F.floor(hash_unit(*key, seed=seed) * max(1, n // each))
    rows = df.select(group.alias("g"), F.xxhash64(*key).alias("k"), *(number(c).alias(f"x{i}") for i, c in enumerate(columns)))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, x = np.zeros(0, np.int64), np.zeros((0, d))
        for batch in stream:
            g = np.concatenate((g, batch.column(0).to_numpy()))
            x = np.concatenate((x, np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(d)]).astype(float)))
            whole = np.searchsorted(g, g[-1])  # the last group may go on
            yield from pairs(g[:whole], x[:whole])
            g, x = g[whole:], x[whole:]
        yield from pairs(g, x)

    def pairs(g: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for apart in range(1, len(g)):
            at = np.flatnonzero(g[apart:] == g[:-apart])
            if not len(at):
                return
            far = np.sqrt(((x[at] - x[at + apart]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(far[far > 0])], ["d"])

    near = rows.repartition("g").sortWithinPartitions("g", "k").drop("k")
    found = near.mapInArrow(run, "d double").agg(F.percentile_approx("d", 0.5, 10000)).first()[0]
    return float(found or 1.0)


def counted_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct rows and `_w`, how many there are of each: what is worked out for a row is worked out once for its copies."""
    return df.groupBy(*(number(c).alias(c) for c in columns)).agg(F.count(F.lit(1)).alias("_w"))


#: Degree of the monomials that stand for the rows of a cell, and how far the waves turn within one (its corner from its middle).
DEGREE, TURN = 7, 0.5

#: Monomials of a cell, and cells of a task, at most.
MONOMIALS, CELLS = 400, 1 << 16


class CellWaves:
    """Sums of exp(iwx) over weighted points, for many w, from the monomials' sums in cells of a grid around the cells' middles.

    exp(iwx) is exp(iwc) times the series of exp(iw(x - c)) up to `DEGREE`, so a row costs its monomials, and each wave is worked
    out once a cell. What is cut off is at most TURN^8 / 8!, 1e-7, for a row in a corner and the shortest wave, and falls with the
    eighth power of either.
    """

    def __init__(self, lines: np.ndarray):
        self.lines, d = lines, len(lines)
        self.side = 2 * TURN / max(float(np.abs(lines).sum(0).max()), 1e-300)  # a corner's |w(x - c)| is at most half a side times this sum
        # a monomial is an earlier one times a column
        self.powers, self.made = [(0,) * d], [(0, 0)]
        start = 0
        for _ in range(DEGREE):
            stop = len(self.powers)
            for m in range(start, stop):
                last = max((i for i, e in enumerate(self.powers[m]) if e), default=0)
                for i in range(last, d):
                    self.powers.append(tuple(e + (j == i) for j, e in enumerate(self.powers[m])))
                    self.made.append((m, i))
            start = stop
        degrees = np.array([sum(e) for e in self.powers])
        self.even = degrees % 2 == 0
        self.terms = np.array([np.prod([lines[i] ** e / math.factorial(e) for i, e in enumerate(p)], axis=0) for p in self.powers]) * np.where(degrees % 4 < 2, 1.0, -1.0)[:, None]
        self.total = np.zeros((2, lines.shape[1]))
        self.clear()

    @staticmethod
    def offered(d: int) -> bool:
        return math.comb(d + DEGREE, DEGREE) <= MONOMIALS

    def clear(self) -> None:
        self.cells, self.sums = np.zeros((0, len(self.lines)), np.int64), np.zeros((0, len(self.powers)))

    def add(self, x: np.ndarray, w: np.ndarray) -> None:
        place = np.floor(x / self.side).astype(np.int64)
        order = np.lexsort(place.T)
        place, w = place[order], w[order].astype(float)
        u = x[order] - (place + 0.5) * self.side
        first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]).any(1)))
        sums, own = np.empty((len(first), len(self.powers))), [w]
        sums[:, 0] = np.add.reduceat(w, first)
        for m, (of, i) in enumerate(self.made[1:], 1):
            own.append(own[of] * u[:, i])
            sums[:, m] = np.add.reduceat(own[m], first)
        cells = np.concatenate((self.cells, place[first]))
        self.cells, at = np.unique(cells, axis=0, return_inverse=True)
        both = np.zeros((len(self.cells), len(self.powers)))
        both[at[: len(self.sums)]] = self.sums
        both[at[len(self.sums) :]] += sums
        self.sums = both
        if len(self.cells) > CELLS:
            self.flush()

    def flush(self) -> None:
        for a in range(0, len(self.cells), 512):
            wave = np.ones((1, 1))
            for own, w in zip(self.cells[a : a + 512].T, self.lines, strict=True):
                steps, at = np.unique(own, return_inverse=True)
                wave = wave * np.exp(1j * np.outer((steps + 0.5) * self.side, w))[at]
            real, imaginary = (self.sums[a : a + 512, own] @ self.terms[own] for own in (self.even, ~self.even))
            self.total += (wave.real * real - wave.imag * imaginary).sum(0), (wave.real * imaginary + wave.imag * real).sum(0)
        self.clear()


def kernel_means(df: DataFrame, columns: list[str], lines: np.ndarray, weight: str | None = None) -> np.ndarray:
    """Means over rows of the cosines and sines along each line: a row a task, added up before they reach the driver."""
    width, d = lines.shape[1], len(columns)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(2 * width), 0
        waves = CellWaves(lines) if CellWaves.offered(d) else None
        for x, w in held(stream):
            if waves:
                waves.add(x, w)
            else:
                for at in range(0, len(x), 256):
                    along = x[at : at + 256] @ lines
                    total[:width] += w[at : at + 256] @ np.cos(along)
                    total[width:] += w[at : at + 256] @ np.sin(along)
            n += int(w.sum())
        if waves:
            waves.flush()
            total = waves.total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total], pa.list_(pa.float64()))], ["n", "total"])

    def held(stream: Iterator[pa.RecordBatch], most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own, n = [], 0
        for batch in stream:
            own.append((np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(d)]), batch.column(d).to_numpy()))
            n += batch.num_rows
            if n >= most:
                yield tuple(map(np.concatenate, zip(*own, strict=True)))
                own, n = [], 0
        if n:
            yield tuple(map(np.concatenate, zip(*own, strict=True)))

    own = df.select(*(number(c).alias(c) for c in columns), F.col(weight) if weight else F.lit(1).cast("long")).mapInArrow(run, "n long, total array<double>")
    by = own.select("n", F.posexplode("total").alias("at", "t")).groupBy("at").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).collect()
    out = np.zeros(2 * width)
    for r in by:
        out[r["at"]] = r["t"] / max(1, r["n"])
    return out


def kernel_distance(p: DataFrame, q: DataFrame, columns: list[str], gamma: float, features: int = 2048, seed: int = 0, weight: str | None = None) -> tuple[float, float]:
    """(squared maximum mean discrepancy for exp(-gamma |x - y|^2), its standard error): every row of both frames counts.

    The distance is the mean over lines w, normal with variance 2 gamma, of |mean exp(iwx) - mean exp(iwy)|^2.
    """
    lines = np.random.default_rng(seed).standard_normal((len(columns), features)) * math.sqrt(2 * gamma)
    gap = kernel_means(p, columns, lines, weight) - kernel_means(q, columns, lines, weight)
    each = gap[:features] ** 2 + gap[features:] ** 2
    return float(each.mean()), float(each.std() / math.sqrt(features))


def row_energy(p: DataFrame, q: DataFrame, columns: list[str], lines: int = 64, seed: int = 0, weight: str | None = None) -> tuple[float, float]:
    """(2 E|X - Y| - E|X - X'| - E|Y - Y'| over whole rows, its standard error), from random directions.

    The length of a vector is the mean length of its projections over that of a unit vector's, so the distance is the mean of the
    energy distances along lines, each from exact distribution functions.
    """
    d = len(columns)
    unit = np.random.default_rng(seed).standard_normal((1 if d == 1 else lines, d))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    mean_length = math.exp(math.lgamma(d / 2) - math.lgamma((d + 1) / 2)) / math.sqrt(math.pi)
    by = areas(p, q, columns, lambda gap: 2 * gap**2, unit.T, weight)
    found = np.array([e for e in by if e is not None]) / mean_length
    return (float(found.mean()), float(found.std() / math.sqrt(len(found)))) if len(found) else (0.0, 0.0)


def auc(df: DataFrame, by: list[str], label: str = "label", score: str = "score", weight: str | None = None) -> DataFrame:
    """by, positives, negatives, auc: the share of (positive, negative) pairs that the score puts in order, ties for half.

    Scores are counted by value first; null without rows of both labels. With a `weight` column a row stands for so many.
    """
    w = F.col(weight) if weight else F.lit(1).cast("long")
    counts = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, F.col(score).alias("_s")).agg(F.sum(w).alias("_c"), F.sum(F.col(label).cast("long") * w).alias("_p"))
    rank = F.col("_run") - (F.col("_c") - 1) / 2
    sums = running_counts(counts, by, "_s", "_c").groupBy(*by).agg(F.sum("_p").alias("positives"), F.sum(F.col("_c") - F.col("_p")).alias("negatives"), F.sum(rank * F.col("_p")).alias("_r"))
    p, n = F.col("positives").cast("double"), F.col("negatives").cast("double")
    return sums.select(*by, "positives", "negatives", ((F.col("_r") - p * (p + 1) / 2) / F.nullif(p * n, F.lit(0.0))).alias("auc"))


def told_apart(p: DataFrame, q: DataFrame, columns: list[str], key: str, folds: int = 3, kind: str = "logistic", seed: int = 0, pooled: bool = False) -> float | None:
    """The AUC by which a classifier, trained on the other folds, tells rows of p (1) from rows of q (0); 0.5: not at all.

    The mean over folds, or of all scores together. Folds are drawn by a hash of side and key. A logistic regression learns from
    distinct rows with their counts, which is the same sum; the hash of whole rows also deals both sides alike over tasks, however
    few bytes one of them takes. A forest draws rows one by one, so it keeps every copy.
    """
    side = lambda df, label: df.select(F.lit(label).cast("double").alias("label"), F.floor(hash_unit(F.col(key), F.lit(label), seed=seed) * folds).cast("int").alias("fold"), *(number(c).alias(c) for c in columns))
    both = side(p, 1).unionByName(side(q, 0))
    both = both.groupBy(*both.columns).agg(F.count(F.lit(1)).alias("_w")) if kind == "logistic" else both.withColumn("_w", F.lit(1).cast("long"))
    rows = written(both, "two-samples")
    seen = VectorAssembler(inputCols=columns, outputCol="x").transform(rows).select("label", "fold", "x", "_w")
    if kind == "logistic":
        score = {}
        for fold in range(folds):
            fitted = classification.LogisticRegression(featuresCol="x", labelCol="label", weightCol="_w", maxIter=300, regParam=1e-6).fit(seen.where(F.col("fold") != fold))
            margin = sum((F.lit(float(c)) * F.col(name) for c, name in zip(fitted.coefficients, columns, strict=True)), F.lit(float(fitted.intercept)))
            score[fold] = F.when(F.col("fold") == fold, 1 / (1 + F.exp(-margin)))
        names = ["s"] if pooled else [f"s{fold}" for fold in score]
        by = [F.coalesce(*score.values())] if pooled else score.values()
        scored = rows.select("label", "_w", *(x.alias(name) for x, name in zip(by, names, strict=True)))
        found = [a for a in areas(scored.where("label = 1"), scored.where("label = 0"), names, None, weight="_w") if a is not None]
        return float(np.mean(found)) if found else None
    scored = None
    for fold in range(folds):
        model = classification.RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=100, maxDepth=8, seed=seed)
        fitted = model.fit(spread(seen.where(F.col("fold") != fold)))  # a forest holds each row with its draws for every tree
        out = fitted.transform(seen.where(F.col("fold") == fold)).select("fold", "label", "_w", F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
        scored = out if scored is None else scored.unionByName(out)
    scored = scored.withColumn("fold", F.lit(0)) if pooled else scored
    return auc(scored, ["fold"], weight="_w").agg(F.avg("auc")).first()[0]


def prior_distances(df: DataFrame, columns: list[str], key: str, seed: int = 0, prior: str = "networks", features: int = 2048, lines: int = 64) -> dict[str, float | None]:
    """How far the standardised rows are from as many of the prior: a mean of W1 by column, mmd (squared for the normal prior, its
    root for networks), energy (networks), and the AUC of a logistic regression (normal) or a forest (networks)."""
    z = written(standardised(df, columns, key), "standardised")
    n = z.count()
    drawn = (prior_sample if prior == "networks" else normal_sample)(df.sparkSession, n, columns, seed)
    g = written(standardised(drawn, columns, "id") if prior == "networks" else drawn, "prior")
    both = z.select(F.lit(1).alias("_side"), F.col(key).cast("string").alias("_key"), *columns).unionByName(g.select(F.lit(0).alias("_side"), F.col("id").cast("string").alias("_key"), *columns))
    median = median_distance(both, columns, ["_side", "_key"], seed)
    gamma = 1 / (2 * median**2) if prior == "networks" else 1 / median**2
    mmd, error = kernel_distance(z, g, columns, gamma, features, seed)
    out: dict[str, float | None] = {"w1": float(np.mean([a for a in areas(z, g, columns, np.abs) if a is not None])) if n else None, "mmd": math.sqrt(mmd) if prior == "networks" else mmd, "mmd_squared_error": error}
    if prior == "networks":
        out["energy"], out["energy_error"] = row_energy(z, g, columns, lines, seed)
    g = g.withColumnRenamed("id", key)
    out["c2st"] = told_apart(z, g, columns, key, 3, "forest" if prior == "networks" else "logistic", seed, prior == "networks")
    return out
