"""Scaling and transforms: literals from one pass, projections after."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from sievelake.functions.quantiles import quantile_grid
from sievelake.functions.stats import number, quantiles
from sievelake.operators.base import Action, ParameterizedAction, ParamSpec
from sievelake.plans.shared import written


class ZScoreScaler(Action):
    """(x - mean) / population deviation; a constant column is divided by 1."""

    DEFAULTS = {"with_mean": True, "with_std": True}
    NUMERIC_ONLY = True

    def stat_exprs(self, df, columns):
        return {f"{k}_{c}": e for c in columns for k, e in (("mean", F.avg(number(c))), ("sd", F.stddev_pop(number(c))))}

    def apply(self, df, columns, stats):
        mean = lambda c: (stats[f"mean_{c}"] or 0.0) if self.params["with_mean"] else 0.0
        sd = lambda c: (stats[f"sd_{c}"] or 1.0) if self.params["with_std"] else 1.0
        return df.withColumns({c: (number(c) - F.lit(mean(c))) / F.lit(sd(c)) for c in columns})


class MinMaxScaler(Action):
    """To feature_range; a constant column becomes its lower end."""

    DEFAULTS = {"feature_range": (0.0, 1.0), "clip": False}
    NUMERIC_ONLY = True

    def stat_exprs(self, df, columns):
        return {f"{k}_{c}": e for c in columns for k, e in (("min", F.min(number(c))), ("max", F.max(number(c))))}

    def apply(self, df, columns, stats):
        low, high = map(float, self.params["feature_range"])
        out = {}
        for c in columns:
            a, b = stats[f"min_{c}"], stats[f"max_{c}"]
            if a is None:
                continue
            x = (number(c) - F.lit(a)) / F.lit((b - a) or 1.0) * (high - low) + low
            out[c] = F.when(x < low, low).when(x > high, high).otherwise(x) if self.params["clip"] else x
        return df.withColumns(out)


class DecimalScaler(Action):
    """x / 10^j with the smallest j that brings every |x| below 1; an exact power of ten takes one more."""

    NUMERIC_ONLY = True

    def stat_exprs(self, df, columns):
        return {c: F.max(F.abs(number(c))) for c in columns}

    @staticmethod
    def divisor(most: float | None) -> float | None:
        if not most or most <= 0:
            return None
        j = math.floor(math.log10(most))
        while 10.0**j <= most:
            j += 1
        while j > 0 and 10.0 ** (j - 1) > most:
            j -= 1
        return 10.0 ** max(0, j)

    def apply(self, df, columns, stats):
        return df.withColumns({c: number(c) / F.lit(d) for c in columns if (d := self.divisor(stats[c]))})


class Log10Scaler(Action):
    """log10(x + C) with one C over all columns: |smallest| + epsilon if that is not positive, else 0."""

    DEFAULTS = {"shift_epsilon": 1e-6}
    NUMERIC_ONLY = True

    def stat_exprs(self, df, columns):
        return {c: F.min(number(c)) for c in columns}

    def apply(self, df, columns, stats):
        known = [stats[c] for c in columns if stats[c] is not None]
        least = min(known, default=1.0)
        shift = abs(least) + self.params["shift_epsilon"] if least <= 0 else 0.0
        return df.withColumns({c: F.log10(number(c) + F.lit(shift)) for c in columns})


class Log1pScaler(Action):
    """log(1 + x) after a shift to non-negative; with `min_skew`, only columns at least that skewed."""

    DEFAULTS = {"min_skew": None}
    NUMERIC_ONLY = True

    def stat_exprs(self, df, columns):
        return {f"{k}_{c}": e for c in columns for k, e in (("min", F.min(number(c))), ("skew", F.skewness(number(c))))}

    def apply(self, df, columns, stats):
        cut = self.params["min_skew"]
        own = [c for c in columns if stats[f"min_{c}"] is not None and (cut is None or (stats[f"skew_{c}"] or 0.0) >= cut)]
        return df.withColumns({c: F.log1p(number(c) + F.lit(max(0.0, -stats[f"min_{c}"]))) for c in own})


class RobustScaler(Action):
    """(x - median) / interquartile range, divided by 1 where that is 0."""

    NUMERIC_ONLY = True

    def stat_exprs(self, df, columns):
        return {c: quantiles(number(c), [0.25, 0.5, 0.75]) for c in columns}

    def apply(self, df, columns, stats):
        return df.withColumns({c: (number(c) - F.lit(stats[c][1])) / F.lit((stats[c][2] - stats[c][0]) or 1.0) for c in columns if stats[c] and stats[c][0] is not None})


class QuantileScaler(Action):
    """To the uniform or normal distribution by piecewise-linear quantiles; ties take the middle of their range."""

    DEFAULTS = {"n_quantiles": 1000, "output_distribution": "uniform", "ignore_implicit_zeros": False, "subsample": 100000, "random_state": None}
    NUMERIC_ONLY = True

    def stat_exprs(self, df, columns):
        return {f"n_{c}": F.count(number(c)) for c in columns}

    def settle(self, df, columns, stats):
        grids = {c: min(self.params["n_quantiles"], stats[f"n_{c}"]) for c in columns}
        return {c: quantile_grid(df, number(c), [i / max(1, n - 1) for i in range(n)]) for c, n in grids.items() if n}

    def apply(self, df, columns, stats):
        return df.withColumns({c: through_quantiles(number(c), stats[c], self.params["output_distribution"]) for c in columns if c in stats})


def through_quantiles(x: Column, grid: list[float], distribution: str) -> Column:
    q = np.array(grid)
    share = np.linspace(0, 1, len(q)) if len(q) > 1 else np.array([0.0])
    inverse = NormalDist().inv_cdf

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        v = s.to_numpy(float)
        up = np.interp(v, q, share)
        down = -np.interp(-v, -q[::-1], -share[::-1])
        out = (up + down) / 2
        out = np.where(v <= q[0], 0.0, np.where(v >= q[-1], 1.0, out))
        if distribution == "normal":
            out = np.array([np.nan if np.isnan(p) else inverse(min(max(p, 1e-7), 1 - 1e-7)) for p in out])
        return pd.Series(out).where(~np.isnan(v))

    return run(x)


class PowerScaler(Action):
    """Box-Cox (after a shift to positive) or Yeo-Johnson, without standardising; lambda is the likeliest of a grid, all in one pass."""

    DEFAULTS = {"method": "yeo-johnson", "low": -2.0, "high": 3.0, "steps": 51}
    NUMERIC_ONLY = True

    def stat_exprs(self, df, columns):
        return {c: F.min(number(c)) for c in columns}

    def _shifted(self, c, least):
        return number(c) + F.lit(1 - least if least <= 0 else 0.0) if self.params["method"] == "box-cox" else number(c)

    def _value(self, x: Column, power: float) -> Column:
        up = F.log(x) if abs(power) < 1e-9 else (F.pow(x, F.lit(power)) - 1) / power
        if self.params["method"] == "box-cox":
            return up
        a = F.log1p(x) if abs(power) < 1e-9 else (F.pow(x + 1, F.lit(power)) - 1) / power
        b = -F.log1p(-x) if abs(power - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - power)) - 1) / (2 - power)
        return F.when(x >= 0, a).otherwise(b)

    def settle(self, df, columns, stats):
        grid = [round(v, 10) for v in np.linspace(self.params["low"], self.params["high"], self.params["steps"])]
        known = [c for c in columns if stats[c] is not None]
        exprs = []
        for c in known:
            x = self._shifted(c, stats[c])
            jacobian = F.log(x) if self.params["method"] == "box-cox" else F.signum(x) * F.log1p(F.abs(x))
            exprs += [F.avg(jacobian).alias(f"j_{c}"), *(F.var_pop(self._value(x, p)).alias(f"{i}_{c}") for i, p in enumerate(grid))]
        row = df.agg(*exprs).first() if exprs else {}
        best = lambda c: max(range(len(grid)), key=lambda i: -0.5 * math.log(max(row[f"{i}_{c}"] or 0.0, 1e-300)) + (grid[i] - 1) * (row[f"j_{c}"] or 0.0))
        return {c: (stats[c], grid[best(c)]) for c in known}

    def apply(self, df, columns, stats):
        return df.withColumns({c: self._value(self._shifted(c, stats[c][0]), stats[c][1]) for c in columns if c in stats})


class FrequencyEncoder(Action):
    """Each value as its share of the fitted rows that have one; a value that the fit has not met counts 0, null stays null.

    The shares are a table, however many values there are, and are joined by value.
    """

    CATEGORICAL_ONLY = True

    def settle(self, df, columns, stats):
        cells = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns))).alias("e")
        counts = df.select(cells).select("e.*").where("v is not null").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")) if columns else None
        n = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in columns)).first().asDict() if columns else {}
        return {"counts": written(counts, "frequencies") if columns else None, "n": n}

    def apply(self, df, columns, stats):
        for i, c in enumerate(columns):
            own = stats["counts"].where(F.col("c") == c).select(F.col("v").alias(f"_v{i}"), (F.col("n") / F.lit(max(1, stats["n"][c]))).alias(f"_f{i}"))
            share = F.when(F.col(f"`{c}`").isNotNull(), F.coalesce(f"_f{i}", F.lit(0.0)))
            df = df.join(own, F.col(f"`{c}`").cast("string") == F.col(f"_v{i}"), "left").withColumn(c, share).drop(f"_v{i}", f"_f{i}")
        return df


class DummyCoder(Action):
    """A column of 0 and 1 for each fitted value, named <column>_<value>, in place of the column; nulls and other values are 0 everywhere.

    At most `most` values a column, as each is a column of the result; more are an error. `drop_first` leaves out the first.
    """

    DEFAULTS = {"most": 50, "drop_first": False}
    CATEGORICAL_ONLY = True

    def settle(self, df, columns, stats):
        out = {}
        for c in columns:
            values = [r[0] for r in df.select(F.col(f"`{c}`").cast("string").alias("v")).where("v is not null").distinct().orderBy("v").limit(self.params["most"] + 1).collect()]
            if len(values) > self.params["most"]:
                raise ValueError(f"{c} has over {self.params['most']} values")
            out[c] = values[1:] if self.params["drop_first"] else values
        return out

    def apply(self, df, columns, stats):
        coded = [F.coalesce((F.col(f"`{c}`").cast("string") == v).cast("int"), F.lit(0)).alias(f"{c}_{v}") for c in columns for v in stats[c]]
        return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in columns), *coded)


class LabelEncoder(Action):
    """Codes 0, 1, ... in ascending order of the distinct values; the mapping is a join, so it may be large."""

    def apply(self, df, columns, stats):
        for c in columns:
            codes = df.select(F.col(f"`{c}`").alias("_v")).where("_v is not null").distinct()
            # ranks of distinct values by ranges: each range's rank starts where the last one ended
            codes = ranked(codes, "_v").withColumnRenamed("rank", "_code")
            df = df.join(codes, df[c] == codes["_v"], "left").drop("_v").withColumn(c, F.col("_code") - 1).drop("_code")
        return df


def ranked(distinct, column: str):
    """(column, rank from 1) of distinct values: range-partitioned, ranked within, and shifted by the ranges before."""
    parts = distinct.repartitionByRange(F.col(column)).withColumn("_p", F.spark_partition_id())
    parts = written(parts, "ranks")
    within = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(column)))
    sizes = parts.groupBy("_p").count()
    before = sizes.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_before"))  # one row a partition
    return within.join(before, "_p").select(column, (F.col("_r") + F.col("_before")).cast("long").alias("rank"))


class ParameterizedScaler(ParameterizedAction):
    NUMERIC_ONLY = True
    PARAM_SPECS = (ParamSpec("method", "categorical", choices=("minmax", "zscore", "quantile"), default="minmax"), ParamSpec("quantile_output", "categorical", choices=("uniform", "normal"), default="uniform"))

    def _inner(self, columns):
        kind = {"minmax": MinMaxScaler, "zscore": ZScoreScaler}.get(self.params["method"])
        return kind(columns=columns) if kind else QuantileScaler(columns=columns, output_distribution=self.params["quantile_output"])

    def settle(self, df, columns, stats):
        return self._inner(columns).compute(df, columns)

    def apply(self, df, columns, stats):
        return self._inner(columns).apply(df, columns, stats)
