"""k-fold grids: every fold and every point of a grid from one pass of sums by fold, and one pass that scores.

What a model of all folds but one is fitted on are the sums of all rows less those of the fold, so ten folds cost what one fit
costs. Rows with a null among features or target take no part; folds are drawn by a hash of the key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import classification
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions.stats import hash_unit, number, numeric_columns
from sievelake.operators.evaluate import BaseRegressionEvaluator, lasso, split
from sievelake.plans.shared import written

def fold_of(key: list[str], folds: int, seed: int) -> Column:
    return F.floor(hash_unit(*key, F.lit("fold"), seed=seed) * folds).cast("int")


def gaussian_nb(grid: list[dict], n: np.ndarray, sums: np.ndarray, products: np.ndarray):
    """log prior and normal densities, variances widened by 1e-9 of the largest."""
    mean = sums / n[:, None]
    var = np.maximum(np.einsum("cii->ci", products) / n[:, None] - mean**2, 0.0)
    whole = sums.sum(0) / n.sum()
    widest = (np.einsum("cii->i", products) / n.sum() - whole**2).max()

    def scores(x: np.ndarray) -> np.ndarray:
        out = []
        for point in grid:
            v = var + point.get("var_smoothing", 1e-9) * widest
            out.append(np.log(n / n.sum()) - 0.5 * np.log(2 * np.pi * v).sum(1) - 0.5 * ((x[:, None] - mean) ** 2 / v).sum(2))
        return np.stack(out, 1)

    return scores


def discriminants(grid: list[dict], n: np.ndarray, sums: np.ndarray, products: np.ndarray):
    """Linear discriminants of class means and the pooled covariance."""
    mean = sums / n[:, None]
    within = (products - n[:, None, None] * mean[:, :, None] * mean[:, None, :]).sum(0) / max(1, n.sum() - len(n))

    def scores(x: np.ndarray) -> np.ndarray:
        out = []
        for point in grid:
            s = point.get("shrinkage", 0.0)
            own = (1 - s) * within + (s * np.trace(within) / len(within) + 1e-6) * np.eye(len(within))
            w = np.linalg.solve(own, mean.T)
            out.append(np.log(n / n.sum()) - 0.5 * (mean * w.T).sum(1) + x @ w)
        return np.stack(out, 1)

    return scores


def multinomial_nb(grid: list[dict], n: np.ndarray, sums: np.ndarray, products: np.ndarray):
    """Shares of each feature's sum by class, smoothed by alpha; negative values count as 0."""

    def scores(x: np.ndarray) -> np.ndarray:
        out = []
        for point in grid:
            a = point.get("alpha", 1.0)
            share = np.log(sums + a) - np.log(sums.sum(1, keepdims=True) + a * sums.shape[1])
            out.append(np.log(n / n.sum()) + x @ share.T)
        return np.stack(out, 1)

    return scores


KINDS = {"nb": (gaussian_nb, [{}]), "lda": (discriminants, [{}]), "mnb": (multinomial_nb, [{"alpha": 0.001 + 0.01 * i} for i in range(100)]), "cart": (None, [{"max_depth": d} for d in (3, 5, 7, 9, 10)])}


class KFoldClassifier:
    """Accuracy by fold and point of a grid: naive Bayes (`nb`, `mnb`), discriminants (`lda`), trees (`cart`).

    Trees are fitted by fold and depth over one written table; the others need two passes in all, whatever the grid.
    """

    def __init__(self, target: str, key: list[str], features: list[str] | None = None, kind: str = "nb", folds: int = 10, grid: list[dict] | None = None, seed: int = 42):
        self.target, self.key, self.features, self.kind, self.folds, self.seed = target, key, features, kind, folds, seed
        self.fit, self.grid = KINDS[kind][0], grid or KINDS[kind][1]

    def rows(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        features = self.features or [c for c in numeric_columns(df) if c not in (*self.key, self.target)]
        low = (lambda x: F.greatest(x, F.lit(0.0))) if self.kind == "mnb" else (lambda x: x)
        own = df.select(fold_of(self.key, self.folds, self.seed).alias("fold"), F.col(self.target).cast("string").alias("y"), *(low(number(c)).alias(f"x{i}") for i, c in enumerate(features)))
        return own.dropna(), [f"x{i}" for i in range(len(features))]

    def results(self, df: DataFrame) -> DataFrame:
        """point (of the grid), fold, n, hits."""
        rows, x = self.rows(df)
        if self.kind == "cart":
            return self._trees(rows, x)
        p = len(x)
        shift = [0.0] * p if self.kind == "mnb" else [v or 0.0 for v in rows.agg(*(F.avg(c) for c in x)).first()]
        z = [F.col(c) - F.lit(m) for c, m in zip(x, shift, strict=True)]
        pairs = [(i, j) for i in range(p) for j in range(i, p)] if self.kind != "mnb" else []
        by = rows.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n"), *(F.sum(a).alias(f"s{i}") for i, a in enumerate(z)), *(F.sum(z[i] * z[j]).alias(f"p{i}_{j}") for i, j in pairs)).collect()
        classes = sorted({r.y for r in by})  # a row for each class and fold
        n, sums, products = np.zeros((self.folds, len(classes))), np.zeros((self.folds, len(classes), p)), np.zeros((self.folds, len(classes), p, p))
        for r in by:
            c = classes.index(r.y)
            n[r.fold, c], sums[r.fold, c] = r.n, [r[f"s{i}"] for i in range(p)]
            for i, j in pairs:
                products[r.fold, c, i, j] = products[r.fold, c, j, i] = r[f"p{i}_{j}"]
        models = {}
        for fold in range(self.folds):
            left = n.sum(0) - n[fold]
            seen = np.flatnonzero(left)
            if n[fold].any() and len(seen):
                models[fold] = seen, self.fit(self.grid, left[seen], (sums.sum(0) - sums[fold])[seen], (products.sum(0) - products[fold])[seen])
        points, middle = len(self.grid), np.array(shift)

        def score(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hits, count = np.zeros((len(n), points), np.int64), np.zeros(len(n), np.int64)
            names = {c: i for i, c in enumerate(classes)}
            for batch in stream:
                fold = batch.column(0).to_numpy()
                label = np.array([names[y] for y in batch.column(1).to_pylist()], np.int64)
                values = np.column_stack([batch.column(2 + i).to_numpy() for i in range(p)]) - middle
                for f, (seen, scores) in models.items():
                    own = fold == f
                    if own.any():
                        hits[f] += (seen[scores(values[own]).argmax(2)] == label[own, None]).sum(0)
                        count[f] += int(own.sum())
            at = [(i, f, count[f], hits[f, i]) for f in range(len(n)) if count[f] for i in range(points)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in at], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["point", "fold", "n", "hits"])

        return rows.mapInArrow(score, "point int, fold int, n long, hits long").groupBy("point", "fold").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))

    def _trees(self, rows: DataFrame, x: list[str]) -> DataFrame:
        classes = [r.y for r in rows.select("y").distinct().orderBy("y").collect()]
        label = F.array_position(F.array(*map(F.lit, classes)), F.col("y")).cast("double") - 1
        table = written(VectorAssembler(inputCols=x, outputCol="x").transform(rows.withColumn("label", label)).select("fold", "label", "x"), "folds")
        out = None
        for i, point in enumerate(self.grid):
            for fold in range(self.folds):
                model = classification.DecisionTreeClassifier(featuresCol="x", labelCol="label", maxDepth=point["max_depth"], seed=self.seed).fit(table.where(F.col("fold") != fold))
                found = model.transform(table.where(F.col("fold") == fold)).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == F.col("prediction")).cast("long")).alias("hits"))
                found = found.where("n > 0").select(F.lit(i).alias("point"), F.lit(fold).alias("fold"), "n", "hits")
                out = found if out is None else out.unionByName(found)
        return out

    def table(self, df: DataFrame) -> DataFrame:
        """point, mean accuracy over folds, folds that had rows."""
        return self.results(df).groupBy("point").agg(F.avg(F.col("hits") / F.col("n")).alias("accuracy"), F.count(F.lit(1)).alias("folds"))

    def evaluate(self, df: DataFrame) -> tuple[float, dict]:
        """The best mean accuracy, and the point of the grid that has it, the first of several; frames of under five rows give 0."""
        rows = [r for r in self.table(df).collect() if r.accuracy is not None] if df.limit(5).count() == 5 else []
        best = max(rows, key=lambda r: (r.accuracy, -r.point), default=None)
        return (float(best.accuracy), self.grid[best.point]) if best else (0.0, {})


class KFoldRegression:
    """Errors by fold of least squares, or of LASSO for each penalty: one pass, as a fold's error is a form of its own sums."""

    def __init__(self, target: str, key: list[str], features: list[str] | None = None, folds: int = 10, alphas: list[float] | None = None, seed: int = 42):
        self.target, self.key, self.features, self.folds, self.alphas, self.seed = target, key, features, folds, alphas or [0.0], seed

    def results(self, df: DataFrame) -> list[dict]:
        """alpha, fold, n, mse, r2."""
        features = self.features or [c for c in numeric_columns(df) if c not in (*self.key, self.target)]
        rows = df.select(fold_of(self.key, self.folds, self.seed).alias("fold"), number(self.target).alias("y"), *(number(c).alias(f"x{i}") for i, c in enumerate(features))).dropna()
        names = [*(f"x{i}" for i in range(len(features))), "y"]
        shift = [v or 0.0 for v in rows.agg(*(F.avg(c) for c in names)).first()]
        terms = [F.lit(1.0), *(F.col(c) - F.lit(m) for c, m in zip(names, shift, strict=True))]
        t = len(terms)
        by = rows.groupBy("fold").agg(*(F.sum(terms[i] * terms[j]).alias(f"{i}_{j}") for i in range(t) for j in range(i, t))).collect()
        sums = {r.fold: np.array([[r[f"{min(i, j)}_{max(i, j)}"] for j in range(t)] for i in range(t)]) for r in by}
        total, out = sum(sums.values()), []
        for fold, m in sorted(sums.items()):
            train = total - m
            if train[0, 0] < 1:
                continue
            mean = train[0] / train[0, 0]
            centred = train / train[0, 0] - np.outer(mean, mean)
            beta = np.zeros(t - 2)
            for alpha in sorted(self.alphas, reverse=True):
                gram, product = centred[1:-1, 1:-1], centred[1:-1, -1]
                beta = lasso(gram, product, alpha, beta) if alpha else np.linalg.lstsq(gram, product, rcond=None)[0]
                form = np.concatenate(([mean[-1] - mean[1:-1] @ beta], beta, [-1.0]))
                error, n = float(form @ m @ form), m[0, 0]
                spread = m[-1, -1] - m[0, -1] ** 2 / n
                out.append({"alpha": float(alpha), "fold": int(fold), "n": int(n), "mse": float(error / n), "r2": float(1 - error / spread) if spread > 0 else None})
        return out

    def evaluate(self, df: DataFrame) -> tuple[float, float]:
        """(least mean squared error over folds, its penalty)."""
        by: dict[float, list[float]] = {}
        for r in self.results(df):
            by.setdefault(r["alpha"], []).append(r["mse"])
        means = {a: sum(v) / len(v) for a, v in by.items()}
        best = min(means, key=lambda a: (means[a], -a), default=None)
        return (means[best], best) if best is not None else (0.0, 0.0)


class KernelRidgeEvaluator(BaseRegressionEvaluator):
    """RBF kernel ridge by `cosines` random cosines over all rows, penalty and width chosen by k folds.

    For each width the products of the cosines are summed by fold in one pass of all widths; penalties are then solved from those
    sums. Features are standardised on the training rows, as the widths of the grid suppose; nulls count as their means.
    """

    ALPHAS = (1e-5, 1e-4, 0.001, 0.01, 0.1, 1, 10, 100)
    GAMMAS = (1e-5, 1e-4, 0.001, 0.01, 0.1, 1, 10)

    def predictions(self, df):
        features = self.features or [c for c in numeric_columns(df) if c not in (*self.key, self.target)]
        alphas, gammas, folds, width = (self.params.get(k, v) for k, v in (("alphas", self.ALPHAS), ("gammas", self.GAMMAS), ("folds", 5), ("cosines", 128)))
        known = split(df.where(F.col(self.target).isNotNull()), self.key, seed=self.seed)
        row = known.where("split = 'train'").agg(F.avg(number(self.target)).alias("y"), *(e for i, c in enumerate(features) for e in (F.avg(number(c)).alias(f"m{i}"), F.stddev_pop(number(c)).alias(f"s{i}")))).first()
        z = [((F.coalesce(number(c), F.lit(row[f"m{i}"])) - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"] or 1.0)).alias(f"z{i}") for i, c in enumerate(features)]
        rng = np.random.default_rng(self.seed)
        lines, start = rng.standard_normal((len(features), width)), rng.uniform(0, 2 * np.pi, width)
        middle = float(row["y"] or 0.0)

        def cosines(x: np.ndarray, gamma: float) -> np.ndarray:
            return np.sqrt(2 / width) * np.cos(x @ lines * np.sqrt(2 * gamma) + start)

        def gather(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((folds, len(gammas), width + 1, width + 1))
            for batch in stream:
                fold = batch.column(0).to_numpy()
                x = np.nan_to_num(np.column_stack([batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(features))]).astype(float))
                y = batch.column(1).to_numpy() - middle
                for g, gamma in enumerate(gammas):
                    both = np.column_stack((cosines(x, gamma), y))
                    for f in np.unique(fold):
                        own = both[fold == f]
                        total[f, g] += own.T @ own
            at = [(f, g, i) for f in range(folds) for g in range(len(gammas)) for i in range(width + 1)]
            yield pa.RecordBatch.from_arrays([*(pa.array([a[k] for a in at], pa.int32()) for k in range(3)), pa.array([total[a] for a in at], pa.list_(pa.float64()))], ["fold", "g", "i", "row"])

        train = known.where("split = 'train'").select(fold_of(self.key, folds, self.seed).alias("fold"), number(self.target).alias("y"), *z)
        # a task's sums are rows of a matrix; they are added up before they reach the driver
        sums = train.mapInArrow(gather, "fold int, g int, i int, row array<double>").select("fold", "g", "i", F.posexplode("row").alias("j", "v")).groupBy("fold", "g", "i", "j").agg(F.sum("v").alias("v"))
        rows = sums.groupBy("fold", "g", "i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("row"))
        by = np.zeros((folds, len(gammas), width + 1, width + 1))
        for r in rows.toLocalIterator():
            by[r.fold, r.g, r.i] = [e["v"] for e in r.row]
        whole = by.sum(0)
        errors = np.zeros((len(gammas), len(alphas)))
        for f in range(folds):
            for g in range(len(gammas)):
                values, vectors = np.linalg.eigh(whole[g, :-1, :-1] - by[f, g, :-1, :-1])
                along = vectors.T @ (whole[g, :-1, -1] - by[f, g, :-1, -1])
                for a, alpha in enumerate(alphas):
                    form = np.append(vectors @ (along / (np.maximum(values, 0) + alpha)), -1.0)
                    errors[g, a] += form @ by[f, g] @ form
        g, a = np.unravel_index(errors.argmin(), errors.shape)
        self.best_params = {"gamma": gammas[g], "alpha": alphas[a]}
        weights = np.linalg.solve(whole[g, :-1, :-1] + alphas[a] * np.eye(width), whole[g, :-1, -1])
        gamma = gammas[g]

        @F.pandas_udf("double")
        def predict(*series: pd.Series) -> pd.Series:
            x = np.nan_to_num(np.column_stack([s.to_numpy(float) for s in series]))
            return pd.Series(cosines(x, gamma) @ weights + middle)

        return known.where("split = 'test'").select(*self.key, number(self.target).alias("label"), *z).withColumn("prediction", predict(*(F.col(f"z{i}") for i in range(len(features))))).select(*self.key, "label", "prediction")
