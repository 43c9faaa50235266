"""Dimension reduction and class balancing."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from sievelake.functions.quantiles import Quantiles, exact_quantiles
from sievelake.functions.stats import hash_unit, number
from sievelake.operators.base import Action


class PCAReducer(Action):
    """Principal components of mean-centred columns, from one aggregate row of products; the largest loading of each is positive."""

    DEFAULTS = {"k": None, "prefix": "d"}
    NUMERIC_ONLY = True

    def stat_exprs(self, df, columns):
        x = [F.coalesce(number(c), F.lit(0.0)) for c in columns]
        return {f"m_{i}": F.avg(a) for i, a in enumerate(x)} | {f"c_{i}_{j}": F.covar_samp(x[i], x[j]) for i in range(len(x)) for j in range(i, len(x))}

    def settle(self, df, columns, stats):
        p = len(columns)
        k = min(p, self.params["k"] or max(2, min(p - 1, 10)))
        cov = np.array([[stats[f"c_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p)] for i in range(p)])
        values, vectors = np.linalg.eigh(cov)
        top = vectors[:, np.argsort(-values)[:k]]
        top = top * np.sign(top[np.abs(top).argmax(axis=0), np.arange(top.shape[1])])
        return {"means": [stats[f"m_{i}"] or 0.0 for i in range(p)], "loadings": top}

    def apply(self, df, columns, stats):
        return projected(df, columns, stats["means"], stats["loadings"], self.params["prefix"])


def projected(df, columns, means, loadings, prefix):
    made = {}
    for j in range(loadings.shape[1]):
        value = F.lit(0.0)
        for c, m, w in zip(columns, means, loadings[:, j], strict=True):
            if w:
                value = value + (F.coalesce(number(c), F.lit(0.0)) - F.lit(float(m))) * F.lit(float(w))
        made[f"{prefix}{j}"] = value
    return df.select(*(c.alias(n) for n, c in made.items()), *(f"`{c}`" for c in df.columns if c not in columns))


class RandomProjector(Action):
    """Seeded Gaussian or sparse projection as literals."""

    DEFAULTS = {"k": 2, "kind": "gaussian", "random_state": 42, "prefix": "d"}
    NUMERIC_ONLY = True

    def settle(self, df, columns, stats):
        rng, p, k = np.random.default_rng(self.params["random_state"]), len(columns), self.params["k"]
        if self.params["kind"] == "gaussian":
            return {"loadings": rng.normal(0, 1 / np.sqrt(k), (p, k))}
        density = 1 / np.sqrt(max(p, 1))
        return {"loadings": rng.choice([-1, 0, 1], (p, k), p=[density / 2, 1 - density, density / 2]) * np.sqrt(1 / density / k)}

    def apply(self, df, columns, stats):
        return projected(df, columns, [0.0] * len(columns), stats["loadings"], self.params["prefix"])


class Undersampler(Action):
    """As many rows of each class as the smallest has, those first by a hash of the key; rows without a class go.

    Where a class ends is an exact quantile of its rows' hashes, so no class is sorted or gathered. Keys are unique.
    """

    DEFAULTS = {"key": None, "random_state": 42}

    def fit(self, df):
        key, target = self.params["key"], self.target
        own = df.withColumn("_h", hash_unit(*([key] if isinstance(key, str) else key), seed=self.params["random_state"]))
        sizes = {r[0]: r[1] for r in df.where(F.col(target).isNotNull()).groupBy(target).count().collect()}  # a row a class
        least = min(sizes.values(), default=0)
        # half a step beyond the last row that stays
        ends = exact_quantiles(own, {str(i): Quantiles(F.when(F.col(target) == F.lit(c), F.col("_h")), [(least - 0.5) / (n - 1)], True) for i, (c, n) in enumerate(sizes.items()) if n > least})
        self.fitted_columns, self.stats = [], {c: ends.get(str(i)) for i, c in enumerate(sizes)}
        return self

    def transform(self, df):
        if self.fitted_columns is None:
            return self.fit(df).transform(df)
        key, target = self.params["key"], self.target
        h = hash_unit(*([key] if isinstance(key, str) else key), seed=self.params["random_state"])
        within = reduce(lambda a, b: a | b, ((F.col(target) == F.lit(c)) & (h <= F.lit(1.0 if end is None else end)) for c, end in self.stats.items()), F.lit(False))
        return df.where(within)


class SMOTEBalancer(Action):
    """Adds rows between neighbours of the smaller classes until each is as large as the largest.

    Neighbours are the k nearest of the whole class: blocks of about `block` rows, dealt by hash, meet in tasks of two, and the
    k nearest of each are merged. Keys are unique; ties go to the smaller one; draws follow the key, so a run repeats and rows of equal values differ. Classes below `least` rows stay as they are.
    """

    DEFAULTS = {"k": 5, "key": None, "least": 6, "block": 4096, "random_state": 42}
    NUMERIC_ONLY = True

    def fit(self, df):
        self.fitted_columns, self.stats = [c for c in self.select_columns(df) if c != self.params["key"]], {}
        return self

    def apply(self, df, columns, stats):
        key, target, k, seed = self.params["key"], self.target, self.params["k"], self.params["random_state"]
        columns = [c for c in columns if c != key]
        sizes = {r[0]: r[1] for r in df.groupBy(target).count().collect()}
        most = max(sizes.values(), default=0)
        small = {c: n for c, n in sizes.items() if self.params["least"] <= n < most}
        if not small:
            return df
        made = None
        for label, n in small.items():
            own = df.where(F.col(target) == F.lit(label)).select(F.col(key).alias("k"), F.array(*(F.coalesce(number(c), F.lit(0.0)) for c in columns)).alias("x"))
            times, rest = divmod(most - n, n)
            blocks = max(1, -(-n // self.params["block"]))
            all_blocks = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
            dealt = own.withColumns({"n": F.lit(times) + (hash_unit("k", seed=seed) < rest / n).cast("int"), "own": F.pmod(F.xxhash64("k", F.lit(seed)), F.lit(blocks)).cast("int"), "k": F.col("k").cast("string")})
            left = dealt.where("n > 0").withColumn("other", all_blocks)
            right = dealt.select(F.col("k").alias("near"), F.col("x").alias("y"), F.col("own").alias("other")).withColumn("own", all_blocks)
            shape = pa.schema([("q", pa.string()), ("n", pa.int32()), ("x", pa.list_(pa.float64())), ("near", pa.string()), ("distance", pa.float64()), ("y", pa.list_(pa.float64()))])

            def nearest(a: pa.Table, b: pa.Table) -> pa.Table:
                out: list[list] = [[], [], [], [], [], []]
                if a.num_rows and b.num_rows:
                    names, values = b["near"].to_pylist(), b["y"].to_pylist()
                    y = np.array(values, float)
                    for q, times, own_x in zip(a["k"].to_pylist(), a["n"].to_pylist(), a["x"].to_pylist(), strict=True):
                        distance = ((y - np.array(own_x, float)) ** 2).sum(axis=1)
                        fit = np.arange(len(y))
                        if len(fit) > k + 1:  # one of them may be the row itself
                            fit = fit[distance <= np.partition(distance, k)[k]]
                        others = (i for i in fit if names[i] != q)
                        for i in sorted(others, key=lambda i: (distance[i], len(names[i]), names[i]))[:k]:
                            for column, v in zip(out, (q, times, own_x, names[i], float(distance[i]), values[i]), strict=True):
                                column.append(v)
                return pa.table([pa.array(c, f.type) for c, f in zip(out, shape, strict=True)], schema=shape)

            def between(frames):
                for frame in frames:
                    out = []
                    for q, times, own_x, near in zip(*(frame.column(i).to_pylist() for i in range(4)), strict=True):
                        x = np.array(own_x, float)
                        rng = np.random.default_rng([seed, *q.encode()])
                        for _ in range(times):
                            share = rng.random()
                            out.append((x + share * (np.array(near[int(rng.integers(len(near)))]["y"], float) - x)).tolist())
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64()))], names=["x"])

            found = left.groupBy("own", "other").cogroup(right.groupBy("own", "other")).applyInArrow(nearest, "q string, n int, x array<double>, near string, distance double, y array<double>")
            best = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("distance", F.length("near"), "near"))).where(F.col("r") <= k)
            drawn = best.groupBy("q").agg(F.first("n").alias("n"), F.first("x").alias("x"), F.sort_array(F.collect_list(F.struct("r", "y"))).alias("near")).select("q", "n", "x", "near")
            rows = drawn.mapInArrow(between, "x array<double>").select(*(F.get("x", F.lit(i)).alias(c) for i, c in enumerate(columns)), F.lit(label).alias(target))
            made = rows if made is None else made.unionByName(rows)
        typed = made.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in made.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields))
        return df.unionByName(typed)
