"""Feature selection: every score is an aggregate; the chosen columns come first, the others pass through."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.functions.stats import correlation, number, numeric_columns
from sievelake.operators.base import Action
from sievelake.operators.learners import CountedForest, ExtraTrees, l1_support_vectors
from sievelake.operators.neighbours import RANGE_ROWS, jittered, mutual_information


class BaseSelector(Action):
    """`scores` gives a number per column (None: unknown); `choose` the kept ones. Columns that are not numbers pass through."""

    NUMERIC_ONLY = True

    def scores(self, df: DataFrame, columns: list[str]) -> dict[str, float | None]:
        raise NotImplementedError

    def choose(self, scores: dict[str, float | None]) -> list[str]:
        k = self.params.get("k", "all")
        ranked = sorted(scores, key=lambda c: (-(scores[c] if scores[c] is not None else float("-inf")), list(scores).index(c)))
        own = set(ranked if k == "all" else ranked[:k])
        return [c for c in scores if c in own]

    def settle(self, df, columns, stats):
        found = self.scores(df, columns)
        return {"scores": found, "kept": self.choose(found)}

    def transform(self, df):
        if self.fitted_columns is None:
            raise RuntimeError(f"{self.name} is not fitted")
        return super().transform(df)

    def apply(self, df, columns, stats):
        rest = [c for c in df.columns if c not in columns]
        return df.select(*(f"`{c}`" for c in [*stats["kept"], *rest]))


class VarianceThresholdSelector(BaseSelector):
    """Population variance over a threshold."""

    DEFAULTS = {"threshold": 0.0}

    def scores(self, df, columns):
        return df.agg(*(F.var_pop(number(c)).alias(c) for c in columns)).first().asDict()

    def choose(self, scores):
        return [c for c, v in scores.items() if v is not None and v > self.params["threshold"]]


class ChiSquareSelector(BaseSelector):
    """Chi-squared of per-class sums of non-negative features against the classes' shares."""

    DEFAULTS = {"k": 10}

    def scores(self, df, columns):
        rows = df.groupBy(self.target).agg(F.count(F.lit(1)).alias("_n"), *(F.sum(number(c)).alias(c) for c in columns)).collect()
        n = sum(r["_n"] for r in rows)
        out = {}
        for c in columns:
            total = sum(r[c] or 0.0 for r in rows)
            out[c] = sum(((r[c] or 0.0) - total * r["_n"] / n) ** 2 / (total * r["_n"] / n) for r in rows) if total > 0 else None
        return out


class LinearCorrelationSelector(BaseSelector):
    """The F statistic of Pearson's r with the target."""

    DEFAULTS = {"k": 10}

    def scores(self, df, columns):
        y = number(self.target)
        row = df.agg(*(e for c in columns for e in (correlation(number(c), y).alias(f"r_{c}"), F.count(F.when(number(c).isNotNull() & y.isNotNull(), 1)).alias(f"n_{c}")))).first()
        return {c: None if (r := row[f"r_{c}"]) is None else r * r / max(1 - r * r, 1e-300) * (row[f"n_{c}"] - 2) for c in columns}


class MutualInformationSelector(BaseSelector):
    """Mutual information with a discrete target by the distances to `n_neighbors` neighbours.

    Equal values are told apart by noise of `noise` of a column's spread, drawn by a hash of `key`; without a key they stay equal.
    """

    DEFAULTS = {"k": 10, "random_state": 42, "n_neighbors": 3, "key": None, "noise": 1e-10, "range_rows": RANGE_ROWS}

    def scores(self, df, columns):
        if key := self.params["key"]:
            df = jittered(df, columns, [key] if isinstance(key, str) else list(key), self.params["noise"], self.params["random_state"])
        return mutual_information(df, columns, self.target, self.params["n_neighbors"], self.params["range_rows"])


class MissingRatioSelector(BaseSelector):
    """Drops columns of which more than a share is null; of any type."""

    DEFAULTS = {"threshold": 0.3}
    NUMERIC_ONLY = False

    def scores(self, df, columns):
        return df.agg(*(F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in columns)).first().asDict()

    def choose(self, scores):
        return [c for c, v in scores.items() if v is None or v <= self.params["threshold"]]


class CollinearitySelector(BaseSelector):
    """Drops each column that correlates over a threshold with an earlier one; all pairs in one pass."""

    DEFAULTS = {"threshold": 0.9}

    def scores(self, df, columns):
        pairs = list(combinations(columns, 2))
        row = df.agg(F.count(F.lit(1)).alias("_n"), *(correlation(number(a), number(b)).alias(f"{i}") for i, (a, b) in enumerate(pairs))).first()
        most = dict.fromkeys(columns, 0.0)
        for i, (_, b) in enumerate(pairs):
            most[b] = max(most[b], abs(row[f"{i}"] or 0.0))
        return most

    def choose(self, scores):
        return [c for c, v in scores.items() if v <= self.params["threshold"]]


class LowDeviationSelector(BaseSelector):
    """Drops columns whose deviation lies below a percentile of all deviations."""

    DEFAULTS = {"percentile": 25}

    def scores(self, df, columns):
        return df.agg(*(F.stddev_samp(number(c)).alias(c) for c in columns)).first().asDict()

    def choose(self, scores):
        return _over_percentile(scores, self.params["percentile"])


def _over_percentile(scores, percentile):
    import numpy as np

    known = [v for v in scores.values() if v is not None]
    limit = float(np.percentile(known, percentile)) if known else 0.0
    return [c for c, v in scores.items() if v is not None and v >= limit]


class _Modelled(BaseSelector):
    def fitted(self, df, columns):
        from pyspark.ml.feature import VectorAssembler

        filled = df.select(*(F.coalesce(number(c), F.lit(0.0)).alias(c) for c in columns), number(self.target).alias("_y")).where("_y is not null")
        return VectorAssembler(inputCols=columns, outputCol="_x").transform(filled)


class RandomForestSelector(_Modelled):
    """Forest importances at least the median (or a number); `max_features` bounds how many stay.

    Forests for classes grow from counts by ranges of the features; those for numbers are Spark's.
    """

    DEFAULTS = {"n_estimators": 100, "threshold": "median", "max_features": None, "random_state": 42, "max_depth": 5, "task": "classification"}

    def scores(self, df, columns):
        from pyspark.ml.regression import RandomForestRegressor

        if self.params["task"] == "classification":
            forest = CountedForest(columns, self.target, self.params["n_estimators"], self.params["max_depth"], seed=self.params["random_state"]).fit(df)
            return dict(zip(columns, forest.importances.tolist(), strict=True))
        model = RandomForestRegressor(featuresCol="_x", labelCol="_y", numTrees=self.params["n_estimators"], maxDepth=self.params["max_depth"], seed=self.params["random_state"]).fit(self.fitted(df, columns))
        return dict(zip(columns, model.featureImportances.toArray().tolist(), strict=True))

    def choose(self, scores):
        import statistics

        limit = statistics.median(scores.values()) if self.params["threshold"] == "median" else self.params["threshold"]
        own = sorted((c for c in scores if scores[c] >= limit), key=lambda c: -scores[c])[: self.params["max_features"]]
        return [c for c in scores if c in own]


class LassoSelector(_Modelled):
    """Absolute Lasso (regression) or L1 logistic (classification) weights over a percentile."""

    DEFAULTS = {"alpha": 0.01, "percentile": 25, "task": "regression"}

    def scores(self, df, columns):
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.regression import LinearRegression

        rows = self.fitted(df, columns)
        if self.params["task"] == "regression":
            weights = LinearRegression(featuresCol="_x", labelCol="_y", regParam=self.params["alpha"], elasticNetParam=1.0).fit(rows).coefficients.toArray()
        else:
            weights = abs(LogisticRegression(featuresCol="_x", labelCol="_y", regParam=self.params["alpha"], elasticNetParam=1.0).fit(rows).coefficientMatrix.toArray()).max(axis=0)
        return dict(zip(columns, map(float, abs(weights)), strict=True))

    def choose(self, scores):
        return _over_percentile(scores, self.params["percentile"])


class ExtraTreesSelector(BaseSelector):
    """Importances of extremely randomised trees at least their mean (or a number)."""

    DEFAULTS = {"n_estimators": 50, "threshold": "mean", "random_state": 42, "max_depth": 10, "task": "classification"}

    def scores(self, df, columns):
        forest = ExtraTrees(columns, self.target, self.params["task"], self.params["n_estimators"], self.params["max_depth"], seed=self.params["random_state"]).fit(df)
        return dict(zip(columns, forest.importances.tolist(), strict=True))

    def choose(self, scores):
        limit = sum(scores.values()) / max(1, len(scores)) if self.params["threshold"] == "mean" else self.params["threshold"]
        return [c for c, v in scores.items() if v >= limit - 1e-12]


class LinearSVCSelector(BaseSelector):
    """Columns with a weight in some L1-penalised support vector machine of one class against the rest."""

    DEFAULTS = {"C": 0.01, "max_iter": 50, "least": 1e-5}

    def scores(self, df, columns):
        known = df.where(F.col(self.target).isNotNull())
        classes = [r[0] for r in known.select(F.col(self.target).cast("string").alias("y")).distinct().orderBy("y").collect()]
        classes = classes[1:] if len(classes) == 2 else classes
        most = dict.fromkeys(columns, 0.0)
        for label in classes:
            weights = l1_support_vectors(known, columns, F.col(self.target).cast("string") == label, self.params["C"], self.params["max_iter"])
            most = {c: max(most[c], abs(float(w))) for c, w in zip(columns, weights, strict=False)}
        return most

    def choose(self, scores):
        return [c for c, v in scores.items() if v > self.params["least"]]


def feature_columns(df: DataFrame, *leave_out: str) -> list[str]:
    return [c for c in numeric_columns(df) if c not in leave_out]
