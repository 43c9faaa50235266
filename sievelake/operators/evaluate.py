"""Downstream evaluation: models trained and scored in Spark, and metrics over (label, prediction) rows."""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import classification, clustering, regression
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions.stats import correlation, hash_unit, number, numeric_columns
from sievelake.plans.shared import written


def split(df: DataFrame, key: list[str], target: str | None = None, test: float = 0.2, seed: int = 42, name: str = "split") -> DataFrame:
    """A column train/test by hash of the key: each class loses the same share, no row moves, and every run agrees."""
    return df.withColumn(name, F.when(hash_unit(*key, seed=seed) < test, "test").otherwise("train"))


def stratified_split(df: DataFrame, key: list[str], target: str, test: float = 0.25, seed: int = 42, name: str = "split") -> DataFrame:
    """Exactly ceil(share) test rows in every class, by hash order: one window over the (salted) classes' rows."""
    order = hash_unit(*key, seed=seed)
    salted = Window.partitionBy(target, F.floor(order * 1024))
    sizes = df.groupBy(target, F.floor(order * 1024).alias("_s")).count()
    before = sizes.withColumn("_b", F.sum("count").over(Window.partitionBy(target).orderBy("_s")) - F.col("count")).withColumn("_n", F.sum("count").over(Window.partitionBy(target))).drop("count")
    ranked = df.withColumn("_s", F.floor(order * 1024)).withColumn("_r", F.row_number().over(salted.orderBy(order, *key)))
    joined = ranked.join(before, [target, "_s"])
    return joined.withColumn(name, F.when(F.col("_r") + F.col("_b") <= F.ceil(F.col("_n") * test), "test").otherwise("train")).drop("_s", "_r", "_b", "_n")


def vectors(df: DataFrame, features: list[str], target: str | None = None, fill: str = "mean", floor: float | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """x (features, nulls at the column's mean or 0), y and the kept columns."""
    if fill == "mean":
        row = df.agg(*(F.avg(number(c)).alias(c) for c in features)).first()
        start = {c: row[c] or 0.0 for c in features}
    else:
        start = dict.fromkeys(features, 0.0)
    x = {c: F.coalesce(number(c), F.lit(start[c])) for c in features}
    if floor is not None:
        x = {c: F.greatest(v, F.lit(floor)) for c, v in x.items()}
    rows = df.select(*(v.alias(f"_x_{c}") for c, v in x.items()), *([F.col(target).alias("_t")] if target else []), *keep)
    return VectorAssembler(inputCols=[f"_x_{c}" for c in features], outputCol="x").transform(rows)


class BaseClassifierEvaluator:
    """Accuracy on a held-out fifth; frames of under ten rows give 0."""

    fill, floor = "mean", None

    def __init__(self, target: str, key: list[str], features: list[str] | None = None, seed: int = 42, **params):
        self.target, self.key, self.features, self.seed, self.params = target, key, features, seed, params

    def estimator(self):
        raise NotImplementedError

    def predictions(self, df: DataFrame) -> DataFrame:
        """key, label, prediction, confidence of the test rows."""
        features = self.features or [c for c in numeric_columns(df) if c not in (*self.key, self.target)]
        known = split(df.where(F.col(self.target).isNotNull()), self.key, self.target, seed=self.seed)
        rows = vectors(known, features, self.target, self.fill, self.floor, (*self.key, "split"))
        labelled = StringIndexer(inputCol="_t", outputCol="y", stringOrderType="alphabetAsc").fit(rows.withColumn("_t", F.col("_t").cast("string"))).transform(rows.withColumn("_t", F.col("_t").cast("string")))
        model = self.estimator().setFeaturesCol("x").setLabelCol("y").fit(labelled.where("split = 'train'"))
        out = model.transform(labelled.where("split = 'test'"))
        return out.select(*self.key, F.col("y").alias("label"), "prediction", F.array_max(vector_to_array("probability")).alias("confidence"))

    def evaluate(self, df: DataFrame) -> float:
        if df.limit(10).count() < 10:
            return 0.0
        got = self.predictions(df).agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
        return float(got or 0.0)


class CARTEvaluator(BaseClassifierEvaluator):
    def estimator(self):
        return classification.DecisionTreeClassifier(impurity="gini", seed=self.seed, maxDepth=self.params.get("max_depth", 8))


class GaussianNBEvaluator(BaseClassifierEvaluator):
    def estimator(self):
        return classification.NaiveBayes(modelType="gaussian")


class MultinomialNBEvaluator(BaseClassifierEvaluator):
    fill, floor = "zero", 0.0

    def estimator(self):
        return classification.NaiveBayes(modelType="multinomial", smoothing=1.0)


class RandomForestEvaluator(BaseClassifierEvaluator):
    def estimator(self):
        return classification.RandomForestClassifier(numTrees=self.params.get("n_estimators", 50), seed=self.seed)


class LogisticEvaluator(BaseClassifierEvaluator):
    def estimator(self):
        return classification.LogisticRegression(regParam=self.params.get("reg", 0.01))


class LDAEvaluator(BaseClassifierEvaluator):
    """Linear discriminants from class means and pooled products: one aggregate, a solve on the driver, a projection."""

    def predictions(self, df):
        features = self.features or [c for c in numeric_columns(df) if c not in (*self.key, self.target)]
        known = split(df.where(F.col(self.target).isNotNull()), self.key, self.target, seed=self.seed)
        means = known.where("split = 'train'").agg(*(F.avg(number(c)).alias(c) for c in features)).first()
        x = [F.coalesce(number(c), F.lit(means[c] or 0.0)) for c in features]
        p = len(features)
        train = known.where("split = 'train'").groupBy(F.col(self.target).cast("string").alias("t")).agg(F.count(F.lit(1)).alias("n"), *(F.avg(a).alias(f"m{i}") for i, a in enumerate(x)), *(F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p))).orderBy("t").collect()
        total = sum(r.n for r in train)
        pooled = sum(r.n * np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) for r in train) / max(1, total - len(train)) + 1e-6 * np.eye(p)
        scores = []
        for r in train:
            mean = np.array([r[f"m{i}"] for i in range(p)])
            w = np.linalg.solve(pooled, mean)
            value = F.lit(float(math.log(r.n / total) - mean @ w / 2))
            for a, b in zip(x, w, strict=True):
                value = value + a * F.lit(float(b))
            scores.append(F.struct(value.alias("s"), F.lit(r.t).alias("t")))
        best = F.array_max(F.array(*scores))
        top = F.aggregate(F.array(*(s["s"] for s in scores)), F.lit(0.0), lambda acc, s: acc + F.exp(s - best["s"]))
        return known.where("split = 'test'").select(*self.key, F.col(self.target).cast("string").alias("label"), best["t"].alias("prediction"), (1 / top).alias("confidence"))


class BaseRegressionEvaluator:
    def __init__(self, target: str, key: list[str], features: list[str] | None = None, seed: int = 42, **params):
        self.target, self.key, self.features, self.seed, self.params = target, key, features, seed, params

    def estimator(self):
        raise NotImplementedError

    def training(self, rows: DataFrame, features: list[str]) -> DataFrame:
        """What the estimator is fitted on: x, y and whatever columns it is told of."""
        return rows

    def predictions(self, df: DataFrame) -> DataFrame:
        features = self.features or [c for c in numeric_columns(df) if c not in (*self.key, self.target)]
        rows = vectors(split(df.where(F.col(self.target).isNotNull()), self.key, seed=self.seed), features, self.target, "mean", None, (*self.key, "split")).withColumn("y", F.col("_t").cast("double"))
        self.model = self.estimator().setFeaturesCol("x").setLabelCol("y").fit(self.training(rows.where("split = 'train'"), features))
        return self.model.transform(rows.where("split = 'test'")).select(*self.key, F.col("y").alias("label"), "prediction")

    def evaluate(self, df: DataFrame) -> dict[str, float]:
        r = regression_metrics(self.predictions(df)).first()
        return {"mse": float(r.mse or 0.0), "r2": float(r.r2 or 0.0)}


class OLSEvaluator(BaseRegressionEvaluator):
    def estimator(self):
        return regression.LinearRegression(solver="normal")


def lasso(gram: np.ndarray, product: np.ndarray, alpha: float, start: np.ndarray, rounds: int = 1000, tol: float = 1e-10) -> np.ndarray:
    """Coordinate descent for the least of b'Gb/2 - b'p + alpha |b|, G and p being centred means of products."""
    beta = start.copy()
    for _ in range(rounds):
        before = beta.copy()
        for j in np.flatnonzero(np.diag(gram) > 0):
            rho = product[j] - gram[j] @ beta + gram[j, j] * beta[j]
            beta[j] = np.sign(rho) * max(abs(rho) - alpha, 0.0) / gram[j, j]
        if np.abs(beta - before).max(initial=0.0) <= tol * max(1.0, np.abs(beta).max(initial=0.0)):
            break
    return beta


class LassoEvaluator(BaseRegressionEvaluator):
    """The best of a grid of 100 penalties by hash-fold cross-validation.

    Fits and errors of all folds and penalties follow from sums of products by fold: one pass over the rows, whatever the grid.
    """

    def predictions(self, df):
        features = self.features or [c for c in numeric_columns(df) if c not in (*self.key, self.target)]
        folds, alphas = self.params.get("folds", 5), sorted(self.params.get("alphas", np.logspace(-4, 0, 100)), reverse=True)
        known = split(df.where(F.col(self.target).isNotNull()), self.key, seed=self.seed)
        means = known.agg(*(F.avg(number(c)).alias(c) for c in features)).first()
        own = [F.coalesce(number(c), F.lit(means[c] or 0.0)) for c in features]
        terms = [F.lit(1.0), *(x - F.lit(means[c] or 0.0) for c, x in zip(features, own, strict=True)), number(self.target)]
        t = len(terms)
        fold = F.floor(hash_unit(*self.key, F.lit("fold"), seed=self.seed) * folds).alias("fold")
        by = known.where("split = 'train'").groupBy(fold).agg(*(F.sum(terms[i] * terms[j]).alias(f"{i}_{j}") for i in range(t) for j in range(i, t))).orderBy("fold").collect()
        sums = [np.array([[r[f"{min(i, j)}_{max(i, j)}"] for j in range(t)] for i in range(t)]) for r in by]
        total = sum(sums)

        def path(m: np.ndarray) -> list[np.ndarray]:
            """Intercept and slopes for each penalty."""
            mean = m[0] / m[0, 0]
            centred = m / m[0, 0] - np.outer(mean, mean)
            beta, out = np.zeros(t - 2), []
            for alpha in alphas:
                beta = lasso(centred[1:-1, 1:-1], centred[1:-1, -1], alpha, beta)
                out.append(np.concatenate(([mean[-1] - mean[1:-1] @ beta], beta)))
            return out

        errors = np.zeros(len(alphas))
        for m in sums if len(sums) > 1 else []:
            for a, b in enumerate(path(total - m)):
                errors[a] += (np.array([*b, -1.0]) @ m @ np.array([*b, -1.0])) / m[0, 0] / len(sums)
        best = int(errors.argmin())
        self.alpha, beta = alphas[best], path(total)[best]
        value = F.lit(float(beta[0]))
        for b, x in zip(beta[1:], terms[1:-1], strict=True):
            value = value + F.lit(float(b)) * x
        return known.where("split = 'test'").select(*self.key, number(self.target).alias("label"), value.alias("prediction"))


class GBREvaluator(BaseRegressionEvaluator):
    """Boosted trees by squared error, which need only the count and the mean target of the rows of equal features: what these
    differ by among themselves is the same on either side of a cut."""

    def training(self, rows, features):
        own = [f"_x_{c}" for c in features]
        points = rows.groupBy(*own).agg(F.avg("y").alias("y"), F.count("y").cast("double").alias("w"))
        return written(VectorAssembler(inputCols=own, outputCol="x").transform(points).select("x", "y", "w"), "points")

    def estimator(self):
        return regression.GBTRegressor(weightCol="w", maxIter=self.params.get("n_estimators", 100), maxDepth=3, stepSize=0.1, seed=self.seed)


class KMeansEvaluator:
    """The best number of clusters by silhouette (squared Euclidean distance)."""

    kind = clustering.KMeans

    def __init__(self, features: list[str], ks: tuple[int, ...] = (2, 3, 4, 5), seed: int = 42):
        self.features, self.ks, self.seed = features, ks, seed

    def evaluate(self, df: DataFrame) -> tuple[float, int]:
        rows = vectors(df, self.features).select("x").persist()
        try:
            scores = {}
            for k in self.ks:
                out = self.kind(k=k, seed=self.seed, featuresCol="x").fit(rows).transform(rows)
                scores[k] = ClusteringEvaluator(featuresCol="x").evaluate(out) if out.select("prediction").distinct().limit(2).count() > 1 else -1.0
        finally:
            rows.unpersist()
        best = max(scores, key=scores.get)
        return scores[best], best


class AgglomerativeEvaluator(KMeansEvaluator):
    """Bottom-up clustering by average cosine distance; the best number of clusters by cosine silhouette.

    The mean cosine distance of two clusters is 1 less the product of their sums of unit vectors over their sizes, so sums and
    sizes are all that linkage needs. Up to `most` rows each is a summary of its own, and the result is that of all pairs. Beyond
    that tasks gather rows of one direction into summaries, which meet until at most `most` are left; rows without a direction
    take no part.
    """

    def __init__(self, features: list[str], ks: tuple[int, ...] = (2, 3, 4, 5), seed: int = 42, most: int = 1000):
        super().__init__(features, ks, seed)
        self.most = most

    def labelled(self, df: DataFrame, ks: tuple[int, ...]) -> DataFrame:
        """The rows' unit vectors as x, and k0, k1, ...: their cluster for each number of clusters."""
        p, most = len(self.features), self.most
        x = F.array(*(F.coalesce(number(c), F.lit(0.0)) for c in self.features))
        size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, b: a + b * b))
        rows = written(df.select(x.alias("x")).withColumn("s", size).where("s > 0").select(F.transform("x", lambda v: v / F.col("s")).alias("x")), "directions")

        def gathered(n: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """At most `most` summaries: each joins the first whose direction is near, ever less near while there are too many."""
            reach = 1e-6
            while len(n) > most:
                unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
                home, lead = np.full(len(n), -1), []
                for i in range(len(n)):
                    if home[i] < 0:
                        own = (home < 0) & (unit @ unit[i] >= 1 - reach)
                        own[i] = True
                        home[own] = len(lead)
                        lead.append(i)
                count, total = np.zeros(len(lead)), np.zeros((len(lead), p))
                np.add.at(count, home, n)
                np.add.at(total, home, sums)
                n, sums, reach = count, total, reach * 4
            return n, sums

        def table(part: int, n: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int64()), pa.array(n, pa.float64()), pa.array(list(sums), pa.list_(pa.float64()))], ["part", "n", "x"])

        def local(stream):
            n, sums = np.zeros(0), np.zeros((0, p))
            for batch in stream:
                more = np.array(batch.column(0).to_pylist(), float).reshape(-1, p)
                n, sums = gathered(np.append(n, np.ones(len(more))), np.concatenate((sums, more)))
            yield table(TaskContext.get().partitionId(), n, sums)

        def meet(t: pa.Table) -> pa.Table:
            return pa.Table.from_batches([table(t["bucket"][0].as_py(), *gathered(t["n"].to_numpy(), np.array(t["x"].to_pylist(), float).reshape(-1, p)))])

        schema = "part long, n double, x array<double>"
        found = written(rows.mapInArrow(local, schema), "summaries")
        parts = (found.agg(F.max("part")).first()[0] or 0) + 1
        while parts > 1:
            found = written(found.withColumn("bucket", F.expr("part div 16")).groupBy("bucket").applyInArrow(meet, schema), "summaries")
            parts = -(-parts // 16)
        got = sorted((tuple(r.x), r.n) for r in found.collect())  # at most `most`, in an order of their own
        sums, n = np.array([g[0] for g in got]).reshape(-1, p), np.array([g[1] for g in got])
        cuts = average_linkage(sums, n, ks)
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)

        @F.pandas_udf("array<int>")
        def cluster(values: pd.Series) -> pd.Series:
            near = (np.stack(values.to_list()) @ centre.T).argmax(1)
            return pd.Series([[int(c[i]) for c in cuts] for i in near])

        return rows.withColumn("c", cluster("x")).select("x", *(F.get("c", F.lit(i)).alias(f"k{i}") for i in range(len(ks))))

    def evaluate(self, df: DataFrame) -> tuple[float, int]:
        rows = written(self.labelled(df, self.ks).withColumn("x", array_to_vector("x")), "clustered")
        scores = {}
        for i, k in enumerate(self.ks):
            several = rows.select(f"k{i}").distinct().limit(2).count() > 1
            scores[k] = ClusteringEvaluator(featuresCol="x", predictionCol=f"k{i}", distanceMeasure="cosine").evaluate(rows) if several else -1.0
        best = max(scores, key=scores.get)
        return scores[best], best


def average_linkage(sums: np.ndarray, n: np.ndarray, ks: tuple[int, ...]) -> list[np.ndarray]:
    """For each number of clusters the cluster of every summary, numbered by first member: the two nearest join, the first of equals."""
    m = len(n)
    sums, n, home = sums.copy(), n.astype(float).copy(), np.arange(m)
    with np.errstate(divide="ignore", invalid="ignore"):
        far = 1 - (sums @ sums.T) / np.outer(n, n)
    np.fill_diagonal(far, np.inf)
    out, alive = {}, m

    def labels() -> np.ndarray:
        return np.unique(home, return_inverse=True)[1]

    for k in sorted(ks, reverse=True):
        while alive > max(k, 1):
            i, j = sorted(divmod(int(far.argmin()), m))
            sums[i] += sums[j]
            n[i] += n[j]
            home[home == j] = i
            far[j], far[:, j] = np.inf, np.inf
            own = 1 - (sums @ sums[i]) / (n * n[i])
            live = np.isin(np.arange(m), home) & (np.arange(m) != i)
            far[i] = np.where(live, own, np.inf)
            far[:, i] = far[i]
            alive -= 1
        out[k] = labels()
    return [out[k] for k in ks]


def dbscan(df: DataFrame, key: str, features: list[str], eps: float = 0.1, least: int = 5) -> DataFrame:
    """key, cluster (null: noise): neighbours by a grid of eps cells in the first two features, components of core points.

    Rows at one point are one, with their count and first key. Cells of very many points are compared point by point of
    neighbouring cells only; the result is that of all pairs.
    """
    from sievelake.plans.components import connected_components
    from sievelake.plans.shared import written

    grid = features[:2]
    rows = written(df.select(F.col(key).alias("k"), F.array(*(number(c) for c in features)).alias("x"), *(F.floor(number(c) / eps).alias(f"g{i}") for i, c in enumerate(grid))).where(~F.exists("x", lambda v: v.isNull())), "dbscan")
    cell = [f"g{i}" for i in range(len(grid))]
    points = written(rows.groupBy("x", *cell).agg(F.min("k").alias("p"), F.count(F.lit(1)).alias("c")), "points")
    near = points
    for i in range(len(grid)):
        near = near.withColumn(f"g{i}", F.explode(F.array(*(F.col(f"g{i}") + d for d in (-1, 0, 1)))))
    square = F.aggregate(F.zip_with("x", "x2", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    pairs = written(near.select(F.col("p").alias("k2"), F.col("x").alias("x2"), F.col("c").alias("c2"), *cell).join(points.withColumnRenamed("p", "k"), cell).where(square <= eps * eps).select("k", "k2", "c2"), "dbscan")
    core = pairs.groupBy("k").agg(F.sum("c2").alias("n")).where(F.col("n") >= least).select("k")
    linked = pairs.where("k < k2").join(core, "k", "left_semi").join(core.withColumnRenamed("k", "k2"), "k2", "left_semi").select(F.col("k").alias("a"), F.col("k2").alias("b"))
    labels = core.join(connected_components(linked), core["k"] == F.col("node"), "left").select("k", F.coalesce("component", "k").alias("cluster"))
    edge = pairs.join(labels.select(F.col("k").alias("k2"), "cluster"), "k2").groupBy("k").agg(F.min("cluster").alias("cluster"))
    found = edge.join(labels.withColumnRenamed("cluster", "own"), "k", "left").select(F.col("k").alias("p"), F.coalesce("own", "cluster").alias("cluster"))
    named = points.join(found, "p", "left").select("x", "cluster")
    return rows.join(named, "x").select(F.col("k").alias(key), "cluster")


# ---- metrics


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    e = F.col(label) - F.col(prediction)
    return df.agg(F.avg(e * e).alias("mse"), (1 - F.sum(e * e) / F.nullif(F.var_pop(label) * F.count(label), F.lit(0.0))).alias("r2"))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy and macro precision, recall and F1 over the classes that occur in either column."""
    cells = confusion(df, label, prediction)
    sides = cells.select(F.explode(F.array(F.struct(F.col(label).alias("c"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("predicted"), F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col(prediction).alias("c"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")))).alias("s")).select("s.*")
    by = sides.groupBy("c").agg(F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return by.agg((F.sum("hit") / F.sum("actual")).alias("accuracy"), F.avg(ratio(F.col("hit"), F.col("predicted"))).alias("precision"), F.avg(ratio(F.col("hit"), F.col("actual"))).alias("recall"), F.avg(ratio(2 * F.col("hit"), F.col("actual") + F.col("predicted"))).alias("f1"))


def expected_calibration_error(df: DataFrame, correct: str = "correct", confidence: str = "confidence", bins: int = 10, closed: bool = False) -> DataFrame:
    """Mean gap of accuracy and confidence over half-open bins, by their share of all rows; a confidence of 1 falls in no bin unless closed."""
    c = F.col(confidence)
    place = F.floor(c * bins)
    place = F.least(place, F.lit(bins - 1)) if closed else place
    by = df.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(correct).cast("double")).alias("a"), F.avg(c).alias("m"))
    return by.agg(F.coalesce(F.sum(F.when(F.col("b") < bins, F.abs(F.col("a") - F.col("m")) * F.col("n"))) / F.sum("n"), F.lit(0.0)).alias("ece"))


def best_f1_threshold(df: DataFrame, label: str = "label", score: str = "score", decimals: int | None = None) -> DataFrame:
    """threshold, f1: the score from which predicting 1 gives the best F1, the smallest of several.

    Scores are counted by value, rounded if decimals are given, and accumulated from the largest by ranges of values.
    """
    value = F.col(score) if decimals is None else F.round(score, decimals)
    counts = written(df.where(F.col(score).isNotNull()).groupBy((-value).alias("_s")).agg(F.sum(F.col(label).cast("long")).alias("_p"), F.count(F.lit(1)).alias("_c")), "scores")
    total = counts.agg(F.sum("_p").alias("_t"))  # one row
    hits = running_counts(counts, [], "_s", "_p").select("_s", F.col("_run").alias("_tp"))
    both = running_counts(counts, [], "_s", "_c").join(hits, "_s").join(F.broadcast(total))
    f1 = 2 * F.col("_tp") / F.nullif(F.col("_run") + F.col("_t"), F.lit(0))
    return both.select((-F.col("_s")).alias("threshold"), f1.alias("f1")).orderBy(F.desc("f1"), "threshold").limit(1)


def confidence_signals(df: DataFrame, probabilities: str = "probability") -> DataFrame:
    """Mean confidence, mean margin between the two likeliest classes, and mean entropy of a probability array."""
    p = F.sort_array(probabilities, asc=False)
    entropy = -F.aggregate(probabilities, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.log(x)).otherwise(0.0))
    return df.agg(F.avg(F.get(p, F.lit(0))).alias("confidence"), F.avg(F.get(p, F.lit(0)) - F.coalesce(F.get(p, F.lit(1)), F.lit(0.0))).alias("margin"), F.avg(entropy).alias("entropy"))


# ---- statistics over results


def confidence_interval(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, sd and the half width 1.96 sd / sqrt(n) of each group."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).withColumn("ci95", F.coalesce(1.96 * F.col("sd") / F.sqrt("n"), F.lit(0.0)))


def running_counts(counts: DataFrame, by: list[str], value: str, count: str) -> DataFrame:
    """The counts with `_run`, their running sum by value within each group: a sum within ranges of values, and the ranges before.

    Ranges are Spark's own partitions by value, so a group of any number of values spreads over tasks.
    """
    parts = written(counts.repartitionByRange(*by, value).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    sizes = parts.groupBy("_range", *by).agg(F.sum(count).alias("_s"))
    before = sizes.select("_range", *by, (F.sum("_s").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_s")).alias("_before"))  # a row a range and group
    same = F.col("x._range") == F.col("y._range")
    for c in by:
        same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    within = parts.withColumn("_in", F.sum(count).over(inside))
    return within.alias("x").join(before.alias("y"), same).select("x.*", "y._before").withColumn("_run", F.col("_in") + F.col("_before")).drop("_range", "_in", "_before")


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Ranks within groups, ties at their mean: distinct values are counted first."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    ranks = running_counts(counts, by, value, "_c").withColumn(name, F.col("_run") - (F.col("_c") - 1) / 2).drop("_c", "_run")
    return df.join(ranks, [*by, value])


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation of each group."""
    both = average_ranks(average_ranks(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), by, a, "_ra"), by, b, "_rb")
    return both.groupBy(*by).agg(correlation("_ra", "_rb").alias("rho"), F.count(F.lit(1)).alias("n"))


def partial_spearman(df: DataFrame, by: list[str], a: str, b: str, given: str) -> DataFrame:
    """Rank correlation of a and b with the ranks of a third held fixed."""
    ranked = df
    for c, n in ((a, "_ra"), (b, "_rb"), (given, "_rz")):
        ranked = average_ranks(ranked, by, c, n)
    r = ranked.groupBy(*by).agg(correlation("_ra", "_rb").alias("ab"), correlation("_ra", "_rz").alias("az"), correlation("_rb", "_rz").alias("bz"))
    return r.select(*by, ((F.col("ab") - F.col("az") * F.col("bz")) / F.nullif(F.sqrt((1 - F.col("az") ** 2) * (1 - F.col("bz") ** 2)), F.lit(0.0))).alias("rho"))


def one_sample_t(df: DataFrame, by: list[str], value: str, mean: float = 0.0) -> DataFrame:
    """n, mean and Student's t of each group's mean against a given one."""
    rows = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return rows.select(*by, "n", "mean", ((F.col("mean") - F.lit(mean)) / F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0))).alias("t"))


def wilcoxon(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Signed-rank test of paired columns by group: n of unequal pairs, the smaller rank sum, and its normal score with ties allowed for."""
    own = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(*by, (F.col(a) - F.col(b)).alias("_d")).withColumn("_a", F.abs("_d"))
    counts = own.groupBy(*by, "_a").agg(F.count(F.lit(1)).alias("_c"), F.sum((F.col("_d") > 0).cast("long")).alias("_p"))
    ranks = running_counts(counts, by, "_a", "_c").withColumn("_r", F.col("_run") - (F.col("_c") - 1) / 2)
    c = F.col("_c").cast("double")
    sums = ranks.groupBy(*by).agg(F.sum("_c").alias("n"), F.sum(F.col("_r") * F.col("_p")).alias("_up"), F.sum(F.col("_r") * (F.col("_c") - F.col("_p"))).alias("_down"), F.sum(c**3 - c).alias("_ties"))
    n = F.col("n").cast("double")
    w = F.least("_up", "_down")
    return sums.select(*by, "n", w.alias("w"), ((w - n * (n + 1) / 4) / F.nullif(F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48), F.lit(0.0))).alias("z"))


def pivot_delta(df: DataFrame, by: str, pivot: str, value: str, before: str, after: str) -> DataFrame:
    """by, the mean of the value under either of two names, and how far the second lies over the first."""
    named = lambda v: F.avg(F.when(F.col(pivot) == v, F.col(value))).alias(v)
    return df.groupBy(by).agg(named(before), named(after)).withColumn("delta", F.col(f"`{after}`") - F.col(f"`{before}`"))


def grouped_totals(df: DataFrame, by: list[str], value: str, how: str = "cube") -> DataFrame:
    """Counts, sums and means over every subset of the grouping columns (`cube`) or its leading ones (`rollup`); `level` tells which."""
    grouped = {"cube": df.cube, "rollup": df.rollup}[how](*by)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.grouping_id().alias("level"))


def align_target(features: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """The target's rows of the keys that the features still have; a cleaning step may have dropped some."""
    return target.join(features.select(key).distinct(), key, "left_semi")


def power_law(df: DataFrame, x: str, y: str) -> DataFrame:
    """Exponent and R2 of y = c x^e, by logarithms."""
    return df.where((F.col(x) > 0) & (F.col(y) > 0)).agg(F.regr_slope(F.log(y), F.log(x)).alias("exponent"), F.regr_r2(F.log(y), F.log(x)).alias("r2"))


def pareto_front(df: DataFrame, key: str, maximise: list[str]) -> DataFrame:
    """Rows that no other dominates. With two objectives one sweep: a row stays if it beats the best second value among
    rows of a larger first value; with more, an anti-join."""
    if len(maximise) == 2:
        a, b = maximise
        by_a = df.groupBy(a).agg(F.max(b).alias("_b"))
        cuts = [r for r in (by_a.agg(F.percentile_approx(a, [i / 64 for i in range(1, 64)], 5000)).first()[0] or [])]
        edges = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array()
        placed = by_a.withColumn("_p", F.size(F.filter(edges, lambda x: x < F.col(a))) if cuts else F.lit(0))
        tops = placed.groupBy("_p").agg(F.max("_b").alias("_t"))
        later = tops.withColumn("_after", F.max("_t").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1))).select("_p", "_after")  # at most 64 rows
        inside = placed.withColumn("_over", F.max("_b").over(Window.partitionBy("_p").orderBy(F.desc(a)).rowsBetween(Window.unboundedPreceding, -1)))
        best = inside.join(later, "_p").where((F.col("_b") > F.coalesce(F.greatest("_over", "_after"), F.lit(float("-inf"))))).select(a, F.col("_b").alias(b))
        return df.join(best, [a, b], "left_semi")
    names = [f"_o{i}" for i in range(len(maximise))]
    kind = df.schema[key].dataType.simpleString()
    schema = f"_key {kind}, " + ", ".join(f"{c} double" for c in names)

    def local(stream):
        held = None
        for batch in stream:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            x = np.column_stack([table[c].to_numpy() for c in names])
            held = table.filter(pa.array(~dominated(x, x)))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    # a row that another of its partition dominates is out; what is left of each meets what is left of the others, in blocks
    own = df.select(F.col(key).alias("_key"), *(F.col(c).cast("double").alias(n) for c, n in zip(maximise, names, strict=True))).dropna()
    rest = written(own.mapInArrow(local, schema), "fronts")
    blocks = max(1, -(-rest.count() // 4096))
    dealt = rest.withColumn("i", F.pmod(F.xxhash64("_key"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = dealt.withColumn("j", every)
    right = dealt.select(*(F.col(c).alias(c) for c in names), F.col("i").alias("j")).withColumn("i", every)

    def beaten(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = (np.column_stack([t[c].to_numpy() for c in names]) for t in (a, b))
        return a.select(["_key"]).filter(pa.array(dominated(x, y))) if a.num_rows and b.num_rows else a.select(["_key"]).slice(0, 0)

    out = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(beaten, f"_key {kind}").distinct()
    kept = rest.select("_key").join(out, "_key", "left_anti")
    return df.join(kept, df[key] == kept["_key"], "left_semi")


def dominated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of x some row of y dominates: nowhere smaller, somewhere larger."""
    out = np.zeros(len(x), bool)
    for i, row in enumerate(x):
        near = (y >= row).all(1)
        out[i] = bool(near.any() and (y[near] > row).any())
    return out


def moving_average(df: DataFrame, by: list[str], order: str, value: str, width: int = 10) -> DataFrame:
    return df.withColumn("moving_average", F.avg(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(1 - width, 0)))


def converged_at(values: list[float], patience: int = 5, tolerance: float = 1e-3) -> int | None:
    """The first step after which `patience` steps stay within the tolerance."""
    for i in range(len(values) - patience + 1):
        if max(abs(b - a) for a, b in pairwise(values[i : i + patience])) <= tolerance:
            return i
    return None
