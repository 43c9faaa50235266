"""Imputation: fill nulls from statistics, from observed values, from neighbours, or by chained regressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.functions.quantiles import Quantiles
from sievelake.functions.stats import hash_unit, mode, nan_to_null, number
from sievelake.operators.base import Action, ParameterizedAction, ParamSpec
from sievelake.operators.learners import BinnedForest, ExtraTrees, cuts_of, ranges


class _Fill(Action):
    def apply(self, df, columns, stats):
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"{self.name} was fitted on columns that are missing: {', '.join(missing)}")
        out = {}
        for c in columns:
            if stats.get(c) is not None:
                x = number(c) if self.NUMERIC_ONLY else F.col(f"`{c}`")
                out[c] = F.coalesce(x, F.lit(stats[c]))
        return df.withColumns(out)


class MeanImputer(_Fill):
    NUMERIC_ONLY = True

    def stat_exprs(self, df, columns):
        return {c: F.avg(number(c)) for c in columns}


class MedianImputer(_Fill):
    NUMERIC_ONLY = True

    def stat_exprs(self, df, columns):
        return {c: Quantiles(number(c), [0.5], True) for c in columns}


class MFImputer(_Fill):
    """Most frequent value of columns of any type, the smallest of several; `rank` and `max_iter` are accepted and unused."""

    DEFAULTS = {"rank": 10, "max_iter": 200}

    def stat_exprs(self, df, columns):
        return {c: mode(c) for c in columns}


class ZeroImputer(_Fill):
    NUMERIC_ONLY = True

    def settle(self, df, columns, stats):
        return {c: 0.0 for c in columns}


class DefaultImputer(Action):
    """Nulls at a value by type: `number` for numbers, `text` for strings, false for booleans; other types stay."""

    DEFAULTS = {"number": 0, "text": "missing"}

    def apply(self, df, columns, stats):
        kinds = {f.name: f.dataType for f in df.schema.fields}
        value = lambda t: F.lit(False) if isinstance(t, T.BooleanType) else F.lit(self.params["number"]).cast(t) if isinstance(t, T.NumericType) else F.lit(self.params["text"]) if isinstance(t, T.StringType) else None
        return nan_to_null(df).withColumns({c: F.coalesce(F.col(f"`{c}`"), v) for c in columns if (v := value(kinds[c])) is not None})


class DropMissing(Action):
    """Drops rows with a null in any of the columns."""

    def apply(self, df, columns, stats):
        return nan_to_null(df).dropna(subset=columns)


class ForwardFill(Action):
    """The last observed value within a partition, by an order; without a partition key all rows would meet in one task, so one is asked for."""

    DEFAULTS = {"partition_by": (), "order_by": ()}

    def apply(self, df, columns, stats):
        if not self.params["partition_by"] or not self.params["order_by"]:
            raise ValueError("ForwardFill needs partition_by and order_by")
        w = Window.partitionBy(*self.params["partition_by"]).orderBy(*self.params["order_by"]).rowsBetween(Window.unboundedPreceding, 0)
        keys = {*self.params["partition_by"], *self.params["order_by"]}
        return df.withColumns({c: F.last(f"`{c}`", ignorenulls=True).over(w) for c in columns if c not in keys})


class RandomImputer(Action):
    """A value drawn from all observed ones, by a hash of the row's key; a column without observed values stays.

    The observed values are numbered by hash, block by block of about `block` rows, and written out; a gap is joined to the
    number that its hash draws, so each value comes up as often as it is observed.
    """

    DEFAULTS = {"random_state": 42, "block": 1 << 18, "key": None}
    NUMERIC_ONLY = True

    def _key(self, df):
        keys = self.params["key"] or df.columns
        return [F.col(f"`{k}`") for k in ([keys] if isinstance(keys, str) else keys)]

    def settle(self, df, columns, stats):
        from sievelake.plans.shared import written

        seed, key, out = self.params["random_state"] or 0, self._key(df), {}
        for c in columns:
            own = df.select(number(c).alias("v"), (hash_unit(*key, F.lit(c), seed=seed) * float(1 << 48)).cast("long").alias("h")).where("v is not null")
            if n := own.count():
                dealt = own.withColumn("b", F.pmod("h", F.lit(-(-n // self.params["block"]))))
                sizes, starts, at = dealt.groupBy("b").count().orderBy("b").collect(), [], 0
                for b, size in sizes:
                    starts.append((b, at))
                    at += size
                nth = F.row_number().over(Window.partitionBy("b").orderBy("h", "v"))
                numbered = dealt.withColumn("nth", nth).join(F.broadcast(df.sparkSession.createDataFrame(starts, "b long, start long")), "b")
                out[c] = (written(numbered.select((F.col("start") + F.col("nth") - 1).alias("_place"), F.col("v").alias("_drawn")), "observed"), at)
        return out

    def apply(self, df, columns, stats):
        key, seed = self._key(df), (self.params["random_state"] or 0) + 1
        pools = {c: stats[c] for c in columns if stats.get(c)}
        # a row without a gap gets a negative place, which no value has, and does not gather with others in one task
        place = {c: F.floor(hash_unit(*key, F.lit(c), seed=seed) * n).cast("long") for c, (_, n) in pools.items()}
        rows = df.withColumns({f"_at_{c}": F.when(number(c).isNull(), p).otherwise(-1 - p) for c, p in place.items()})
        for c, (values, _) in pools.items():
            own = values.select(F.col("_place").alias(f"_at_{c}"), F.col("_drawn").alias(f"_of_{c}"))
            rows = rows.join(own, f"_at_{c}", "left")
        return rows.withColumns({c: F.coalesce(number(c), F.col(f"`_of_{c}`")) for c in pools}).select(*(f"`{c}`" for c in df.columns))


class KNNImputer(Action):
    """The mean of the k nearest rows that have the value, by nan-euclidean distance; the column's mean where there is none.

    Rows with a gap meet all others block by block, each block of at most `block` rows in one task; per block the k nearest
    are kept, then merged. Ties go to the smaller key.
    """

    DEFAULTS = {"n_neighbors": 5, "weights": "uniform", "metric": "nan_euclidean", "key": None, "block": 4096}
    NUMERIC_ONLY = True

    def select_columns(self, df, numeric_only=None, categorical_only=None):
        return [c for c in super().select_columns(df, numeric_only, categorical_only) if c != self.params["key"]]

    def stat_exprs(self, df, columns):
        return {c: F.avg(number(c)) for c in columns}

    def fit(self, df):
        super().fit(df)
        self.donors = df
        return self

    def apply(self, df, columns, stats):
        key, k, block = self.params["key"], self.params["n_neighbors"], self.params["block"]
        if key is None:
            raise ValueError("KNNImputer needs the name of a key column")
        donors = getattr(self, "donors", df)
        x = F.array(*(number(c) for c in columns)).alias("x")
        rows = donors.select(F.col(key).cast("string").alias("d"), x)
        gaps = df.select(F.col(key).cast("string").alias("q"), x).where(F.exists("x", lambda v: v.isNull()))
        blocks = max(1, -(-donors.count() // block))
        right = rows.withColumn("b", F.pmod(F.xxhash64("d"), F.lit(blocks)).cast("int"))
        left = gaps.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        p, keys = len(columns), pa.schema([("q", pa.string()), ("j", pa.int32()), ("d", pa.string()), ("distance", pa.float64()), ("value", pa.float64())])

        def nearest(a: pa.Table, b: pa.Table) -> pa.Table:
            out: list[list] = [[], [], [], [], []]
            if a.num_rows and b.num_rows:
                m = np.array(b["x"].to_pylist(), float)
                names = np.array(b["d"].to_pylist(), object)
                for q, own in zip(a["q"].to_pylist(), np.array(a["x"].to_pylist(), float), strict=True):
                    shared = ~np.isnan(own) & ~np.isnan(m)
                    n = shared.sum(axis=1)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        distance = np.sqrt(p / n * np.where(shared, (own - m) ** 2, 0).sum(axis=1))
                    for j in np.flatnonzero(np.isnan(own)):
                        fit = np.flatnonzero((n > 0) & ~np.isnan(m[:, j]) & (names != q))
                        if len(fit) > 4 * k:
                            limit = np.partition(distance[fit], k - 1)[k - 1]
                            fit = fit[distance[fit] <= limit]
                        for i in sorted(fit, key=lambda i: (distance[i], len(names[i]), names[i]))[:k]:
                            for column, v in zip(out, (q, int(j), names[i], float(distance[i]), float(m[i, j])), strict=True):
                                column.append(v)
            return pa.table([pa.array(c, f.type) for c, f in zip(out, keys, strict=True)], schema=keys)

        found = left.groupBy("b").cogroup(right.groupBy("b")).applyInArrow(nearest, "q string, j int, d string, distance double, value double")
        best = found.withColumn("r", F.row_number().over(Window.partitionBy("q", "j").orderBy("distance", F.length("d"), "d"))).where(F.col("r") <= k)
        if self.params["weights"] == "distance":
            weight = F.when(F.min("distance").over(Window.partitionBy("q", "j")) == 0, (F.col("distance") == 0).cast("double")).otherwise(1 / F.nullif(F.col("distance"), F.lit(0.0)))
            best = best.withColumn("w", weight)
        else:
            best = best.withColumn("w", F.lit(1.0))
        filled = best.groupBy("q", "j").agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("v")).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("_filled"))
        joined = df.join(filled, F.col(key).cast("string") == F.col("q"), "left").drop("q")
        values = {c: F.coalesce(number(c), F.get(F.array(F.element_at("_filled", F.lit(j).cast("int"))), F.lit(0)), F.lit(stats[c])) for j, c in enumerate(columns)}
        return joined.withColumns(values).drop("_filled")


class EMImputer(Action):
    """Chained ridge regressions: nulls start at the mean and are predicted from the other columns as filled so far, fewest nulls first.

    Every regression is fitted from one aggregate row of sums of products; each round's filled columns are written out, so that
    plans stay short. Rounds end when no filled value moved by more than `tol` times the largest observed one, after
    `max_iter` at most; other frames go through the same regressions in the same order.
    """

    DEFAULTS = {"max_iter": 20, "tol": 1e-3, "random_state": 42, "ridge": 1e-3}
    NUMERIC_ONLY = True
    ASCENDING = True

    def stat_exprs(self, df, columns):
        return {f"{k}_{c}": e for c in columns for k, e in (("mean", F.avg(number(c))), ("sd", F.stddev_pop(number(c))), ("most", F.max(F.abs(number(c)))), ("gaps", F.count(F.when(number(c).isNull(), 1))))}

    def _order(self, columns, stats):
        own = [c for c in columns if stats[f"gaps_{c}"]]
        return sorted(own, key=lambda c: stats[f"gaps_{c}"], reverse=not self.ASCENDING)

    def settle(self, df, columns, stats):
        from sievelake.plans.shared import forget, written

        columns = [c for c in columns if stats[f"mean_{c}"] is not None]
        order, models = self._order(columns, stats), []
        scale = max([stats[f"most_{c}"] or 0.0 for c in columns], default=0.0)
        raw = [number(c).alias(f"_v_{i}") for i, c in enumerate(columns)]
        start = [F.coalesce(number(c), F.lit(stats[f"mean_{c}"])).alias(f"_f_{i}") for i, c in enumerate(columns)]
        rows = written(df.select(*raw, *start), "em-round") if order else None
        for _ in range(self.params["max_iter"] if order else 0):
            was = rows
            rows = rows.withColumns({f"_w_{i}": F.col(f"_f_{i}") for i in range(len(columns))})
            for c in order:
                i = columns.index(c)
                z = self._standard(columns, stats)
                terms = [F.lit(1.0), *(z[j] for j in range(len(columns)) if j != i), (F.col(f"_v_{i}") - stats[f"mean_{c}"]) / (stats[f"sd_{c}"] or 1.0)]
                k = len(terms) - 1
                sums = rows.where(F.col(f"_v_{i}").isNotNull()).agg(*(F.sum(terms[a] * terms[b]).alias(f"{a}_{b}") for a in range(len(terms)) for b in range(a, len(terms)))).first()
                gram = np.array([[sums[f"{min(a, b)}_{max(a, b)}"] or 0.0 for b in range(k)] for a in range(k)])
                beta = np.linalg.solve(gram + self.params["ridge"] * np.eye(k), np.array([sums[f"{a}_{k}"] or 0.0 for a in range(k)]))
                models.append((i, beta.tolist()))
                rows = rows.withColumn(f"_f_{i}", self._predicted(i, beta.tolist(), columns, stats, F.col(f"_v_{i}")))
            rows = written(rows, "em-round")
            forget(was)
            moved = rows.agg(F.max(F.greatest(*(F.abs(F.col(f"_f_{i}") - F.col(f"_w_{i}")) for i in range(len(columns))), F.lit(0.0)))).first()[0]
            if (moved or 0.0) <= self.params["tol"] * scale:
                break
        if order:
            forget(rows)
        return stats | {"models": models, "used": columns}

    def _standard(self, columns, stats):
        return [(F.col(f"_f_{j}") - stats[f"mean_{d}"]) / (stats[f"sd_{d}"] or 1.0) for j, d in enumerate(columns)]

    def _predicted(self, i, beta, columns, stats, observed):
        """The observed value, or the regression's on the other columns as they are filled now."""
        value = F.lit(beta[0])
        for b, x in zip(beta[1:], (x for j, x in enumerate(self._standard(columns, stats)) if j != i), strict=True):
            value = value + F.lit(b) * x
        return F.coalesce(observed, value * (stats[f"sd_{columns[i]}"] or 1.0) + stats[f"mean_{columns[i]}"])

    def apply(self, df, columns, stats):
        used = stats["used"]
        rows = df.withColumns({f"_f_{i}": F.coalesce(number(c), F.lit(stats[f"mean_{c}"])) for i, c in enumerate(used)})
        for i, beta in stats["models"]:
            rows = rows.withColumn(f"_f_{i}", self._predicted(i, beta, used, stats, number(used[i])))
        return rows.withColumns({c: F.col(f"_f_{i}") for i, c in enumerate(used)}).drop(*(f"_f_{i}" for i in range(len(used))))


class MICEImputer(Action):
    """Chained random forests, most nulls first: each column with nulls is predicted from the others, mean-filled at first.

    The estimator is `random_forest` or `extra_trees`. Rounds end when no filled value moved by more than `tol` times the largest observed one, after `max_iter` at most; every
    round is written out, so that plans stay short. A forest takes one pass (`BinnedForest`, its ranges those of the round's start)
    where its cells are few enough to be summed, Spark's own by levels otherwise.
    """

    DEFAULTS = {"max_iter": 50, "tol": 1e-3, "n_estimators": 50, "max_depth": 6, "random_state": 42, "estimator": "random_forest"}
    NUMERIC_ONLY = True
    #: Rows of a task, about: a small file would be one task otherwise.
    TASK_ROWS = 50_000

    def stat_exprs(self, df, columns):
        return {"rows": F.count(F.lit(1))} | {f"{k}_{c}": e for c in columns for k, e in (("mean", F.avg(number(c))), ("gaps", F.count(F.when(number(c).isNull(), 1))))}

    def _start(self, df, columns, stats):
        return df.withColumns({f"_f_{c}": F.coalesce(number(c), F.lit(stats[f"mean_{c}"] or 0.0)) for c in columns})

    def _step(self, rows, c, columns, model):
        from pyspark.ml.feature import VectorAssembler

        if isinstance(model, (ExtraTrees, BinnedForest)):
            return rows.withColumn(f"_f_{c}", F.coalesce(number(c), model.prediction([F.col(f"_f_{d}") for d in columns if d != c])))
        made = VectorAssembler(inputCols=[f"_f_{d}" for d in columns if d != c], outputCol="_x").transform(rows)
        out = model.transform(made)
        return out.withColumn(f"_f_{c}", F.coalesce(number(c), F.col("_p"))).drop("_x", "_p")

    def _model(self, rows, c, columns, stats, cuts):
        """The estimator of a column, fitted to the rows that have it."""
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import RandomForestRegressor

        features, p = [f"_f_{d}" for d in columns if d != c], self.params
        if p["estimator"] == "extra_trees":
            return ExtraTrees(features, c, "regression", p["n_estimators"], p["max_depth"], seed=p["random_state"]).fit(rows)
        forest = BinnedForest(features, c, [cuts[d] for d in columns if d != c], "_id", p["n_estimators"], p["max_depth"], p["random_state"] + columns.index(c))  # columns draw their rows apart
        if forest.fits:
            return forest.fit(rows, stats[f"mean_{c}"])
        train = VectorAssembler(inputCols=features, outputCol="_x").transform(rows).where(number(c).isNotNull()).select("_x", number(c).alias("_y"))
        return RandomForestRegressor(featuresCol="_x", labelCol="_y", predictionCol="_p", numTrees=p["n_estimators"], maxDepth=p["max_depth"], seed=p["random_state"]).fit(train)

    def settle(self, df, columns, stats):
        from sievelake.plans.shared import forget, written

        order = sorted((c for c in columns if stats[f"gaps_{c}"] and stats[f"mean_{c}"] is not None), key=lambda c: -stats[f"gaps_{c}"])
        models, rounds = [], 0
        if order and len(columns) > 1:
            rows = self._start(df, columns, stats).select(*(number(c).alias(c) for c in columns), *(f"_f_{c}" for c in columns))
            if stats["rows"] > self.TASK_ROWS:
                rows = rows.repartition(-(-stats["rows"] // self.TASK_ROWS))
            rows = written(rows.withColumn("_id", F.monotonically_increasing_id()), "mice")
            most = [F.max(F.abs(number(c))).alias(f"most_{c}") for c in columns]
            seen = rows.agg(*most, *(cuts_of(F.col(f"_f_{c}")).alias(c) for c in columns)).first()
            limit = self.params["tol"] * max((seen[f"most_{c}"] or 0.0 for c in columns), default=0.0)
            cuts = {c: ranges(seen[c]) for c in columns}
            for rounds in range(1, self.params["max_iter"] + 1):
                before, rows = rows, rows.withColumns({f"_o_{c}": F.col(f"_f_{c}") for c in order})
                for c in order:
                    models.append((c, self._model(rows, c, columns, stats, cuts)))
                    rows = self._step(rows, *models[-1][:1], columns, models[-1][1])
                rows = written(rows, "mice")
                forget(before)
                seen = rows.agg(*(F.max(F.abs(F.col(f"_f_{c}") - F.col(f"_o_{c}"))).alias(f"moved_{c}") for c in order), *(cuts_of(F.col(f"_f_{c}")).alias(c) for c in order)).first()
                cuts |= {c: ranges(seen[c]) for c in order}
                if max(seen[f"moved_{c}"] for c in order) < limit:
                    break
            forget(rows)
        return stats | {"models": models, "rounds": rounds}

    def apply(self, df, columns, stats):
        from sievelake.plans.shared import written

        models, each = stats["models"], len({c for c, _ in stats["models"]})
        if models and all(isinstance(model, BinnedForest) for _, model in models):
            return self._chained(df, columns, stats)
        rows = self._start(df, columns, stats)
        for i, (c, model) in enumerate(models, 1):
            rows = self._step(rows, c, columns, model)
            if i % each == 0 and i < len(models):
                rows = written(rows, "mice")
        return rows.withColumns({c: F.col(f"_f_{c}") for c in columns}).drop(*(f"_f_{c}" for c in columns))

    def _chained(self, df, columns, stats):
        """All rounds in one pass: what a row is filled with depends on the row alone."""
        models, starts = stats["models"], np.array([stats[f"mean_{c}"] or 0.0 for c in columns])

        @F.pandas_udf("array<double>")
        def run(*series: pd.Series) -> pd.Series:
            raw = np.column_stack([s.to_numpy(float) for s in series])
            gaps = np.isnan(raw)
            x = np.where(gaps, starts, raw)
            for c, model in models:
                j = columns.index(c)
                own = np.flatnonzero(gaps[:, j])
                x[own, j] = model.predict(np.delete(x[own], j, axis=1))
            return pd.Series(list(x))

        rows = df.withColumn("_all", run(*(number(c) for c in columns)))
        return rows.withColumns({c: F.col("_all")[i] for i, c in enumerate(columns)}).drop("_all")


class ParameterizedImputer(ParameterizedAction):
    NUMERIC_ONLY = True
    PARAM_SPECS = (ParamSpec("strategy", "categorical", choices=("mean", "median", "most_frequent", "knn"), default="mean"), ParamSpec("n_neighbors", "int", 1, 20, default=5))

    def _inner(self) -> Action:
        kind = {"mean": MeanImputer, "median": MedianImputer, "most_frequent": MFImputer, "knn": KNNImputer}[self.params["strategy"]]
        extra = {"n_neighbors": self.params["n_neighbors"], "key": self.params.get("key")} if kind is KNNImputer else {}
        return kind(columns=self.columns, exclude=set(self.exclude), target=self.target, **extra)

    def fit(self, df: DataFrame):
        inner = self._inner()
        inner.columns = self.select_columns(df)
        self.inner = inner.fit(df)
        self.fitted_columns, self.stats = inner.fitted_columns, inner.stats
        return self

    def transform(self, df):
        return (self.inner if self.fitted_columns is not None else self._inner()).transform(df)
