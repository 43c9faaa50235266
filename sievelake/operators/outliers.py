"""Outliers: bounds from quantiles, moments or medians as literals; local outlier factors over value ranges."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions.quantiles import Quantiles, exact_quantiles
from sievelake.functions.stats import aggregated, number, quantiles
from sievelake.operators.base import Action, ParameterizedAction, ParamSpec
from sievelake.plans.shared import written

METHODS = ("mask", "drop", "clip")


def bounded(df: DataFrame, bounds: dict[str, tuple[float, float]], method: str) -> DataFrame:
    """mask: null outside the bounds; drop: rows with any value outside go, nulls pass; clip: to the nearer bound."""
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}, not {method}")
    within = {c: number(c).between(*b) for c, b in bounds.items()}
    if method == "drop":
        return df.where(reduce(lambda a, b: a & b, (F.coalesce(w, F.lit(True)) for w in within.values()), F.lit(True)))
    if method == "mask":
        return df.withColumns({c: F.when(w, F.col(f"`{c}`")) for c, w in within.items()})
    clip = lambda c, lo, hi: F.when(number(c) < lo, F.lit(lo)).when(number(c) > hi, F.lit(hi)).otherwise(number(c))
    return df.withColumns({c: clip(c, *b) for c, b in bounds.items()})


class _Bounded(Action):
    NUMERIC_ONLY = True

    def bounds(self, c: str, stats: dict) -> tuple[float, float] | None:
        raise NotImplementedError

    def __init__(self, **params):
        super().__init__(**params)
        if self.params["method"] not in METHODS:
            raise ValueError(f"method is one of {', '.join(METHODS)}, not {self.params['method']}")

    def apply(self, df, columns, stats):
        found = {c: b for c in columns if (b := self.bounds(c, stats))}
        return bounded(df, found, self.params["method"])


class IQROutlierCleaner(_Bounded):
    """Bounds q1 - factor iqr and q3 + factor iqr of interpolated quartiles."""

    DEFAULTS = {"factor": 1.5, "method": "mask", "accuracy": None, "min_iqr": None}

    def stat_exprs(self, df, columns):
        return {c: quantiles(number(c), [0.25, 0.75], self.params["accuracy"]) for c in columns}

    def bounds(self, c, stats):
        if not stats[c] or stats[c][0] is None:
            return None
        q1, q3 = stats[c]
        if self.params["min_iqr"] is not None and q3 - q1 <= self.params["min_iqr"]:
            return None
        reach = self.params["factor"] * (q3 - q1)
        return q1 - reach, q3 + reach


class GuardedIQRCleaner(IQROutlierCleaner):
    """Drops rows outside the bounds of any column whose interquartile range is not 0; frames of under `least` rows stay as they are."""

    DEFAULTS = IQROutlierCleaner.DEFAULTS | {"method": "drop", "min_iqr": 0.0, "least": 10}

    def apply(self, df, columns, stats):
        return super().apply(df, columns, stats) if df.limit(self.params["least"]).count() >= self.params["least"] else df


class ClampNormaliser(Action):
    """Values to the nearer bound (`sd3`: mean -+ 3 population deviations, `iqr`: 1.5 ranges beyond the quartiles, `none`), then
    `standard`, `minmax` or `robust` scaling by the statistics of what was clamped; widths of 0 count as 1."""

    DEFAULTS = {"clamp": "sd3", "scale": "standard"}
    NUMERIC_ONLY = True

    def stat_exprs(self, df, columns):
        exprs = {"sd3": lambda x: F.struct(F.avg(x).alias("a"), F.stddev_pop(x).alias("b")), "iqr": lambda x: Quantiles(x, [0.25, 0.75]), "none": lambda x: F.count(x)}
        if self.params["clamp"] not in exprs or self.params["scale"] not in ("standard", "minmax", "robust"):
            raise ValueError("clamp is sd3, iqr or none, scale standard, minmax or robust")
        return {c: exprs[self.params["clamp"]](number(c)) for c in columns}

    def clamped(self, c: str, found) -> Column:
        x = number(c)
        if self.params["clamp"] == "none" or not found or found[0] is None:
            return x
        low, high = (found[0] - 3 * found[1], found[0] + 3 * found[1]) if self.params["clamp"] == "sd3" else (found[0] - 1.5 * (found[1] - found[0]), found[1] + 1.5 * (found[1] - found[0]))
        return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)

    def settle(self, df, columns, stats):
        exprs = {}
        for c in columns:
            x = self.clamped(c, stats[c])
            exprs[c] = {"standard": lambda x: F.struct(F.avg(x).alias("a"), F.stddev_pop(x).alias("b")), "minmax": lambda x: F.struct(F.min(x).alias("a"), (F.max(x) - F.min(x)).alias("b")), "robust": lambda x: Quantiles(x, [0.25, 0.5, 0.75])}[self.params["scale"]](x)
        found = aggregated(df, exprs)
        scale = {c: None if not v or v[0] is None else (v[1], v[2] - v[0]) if self.params["scale"] == "robust" else (v[0], v[1]) for c, v in found.items()}
        return {c: (stats[c], scale[c]) for c in columns}

    def apply(self, df, columns, stats):
        return df.withColumns({c: (self.clamped(c, bounds) - F.lit(scale[0])) / F.lit(scale[1] or 1.0) for c, (bounds, scale) in stats.items() if scale})


class ZScoreOutlierCleaner(_Bounded):
    """Bounds mean -+ threshold sample deviations (ddof=0: population); a constant column is left alone."""

    DEFAULTS = {"threshold": 3.0, "method": "mask", "ddof": 1}

    def stat_exprs(self, df, columns):
        spread = F.stddev_samp if self.params["ddof"] else F.stddev_pop
        return {f"{k}_{c}": e for c in columns for k, e in (("mean", F.avg(number(c))), ("sd", spread(number(c))))}

    def bounds(self, c, stats):
        mean, sd = stats[f"mean_{c}"], stats[f"sd_{c}"]
        return (mean - self.params["threshold"] * sd, mean + self.params["threshold"] * sd) if sd else None


class RobustZOutlierCleaner(_Bounded):
    """Bounds median -+ cut * scale * MAD; the median absolute deviation takes a second pass."""

    DEFAULTS = {"cut": 1.6, "scale": 1.4296, "method": "drop"}

    def stat_exprs(self, df, columns):
        return {c: Quantiles(number(c), [0.5], True) for c in columns}

    def settle(self, df, columns, stats):
        known = [c for c in columns if stats[c] is not None]
        mad = exact_quantiles(df, {c: Quantiles(F.abs(number(c) - F.lit(stats[c])), [0.5], True) for c in known})
        return {c: (stats[c], mad[c]) for c in known}

    def bounds(self, c, stats):
        if c not in stats or not stats[c][1]:
            return None
        median, mad = stats[c]
        reach = self.params["cut"] * self.params["scale"] * mad
        return median - reach, median + reach


class FractionOutlierCleaner(Action):
    """Drops rows of which more than a share of the columns is out of bounds; threshold -1: any."""

    DEFAULTS = {"threshold": 0.3, "detector": "iqr"}
    NUMERIC_ONLY = True

    def settle(self, df, columns, stats):
        kind = {"iqr": IQROutlierCleaner, "zscore": ZScoreOutlierCleaner, "robust": RobustZOutlierCleaner}[self.params["detector"]]
        self.inner = kind(columns=columns)
        return {c: b for c in columns if (b := self.inner.bounds(c, self.inner.compute(df, columns)))}

    def apply(self, df, columns, stats):
        if not stats:
            return df
        out = sum(((~F.coalesce(number(c).between(*b), F.lit(True))).cast("int") for c, b in stats.items()), F.lit(0))
        limit = self.params["threshold"]
        return df.where(out == 0 if limit == -1 else out / len(columns) <= limit)


class GuardedRemoval(Action):
    """A row-removing operator that does nothing if fewer than max(least, share of the rows) would stay."""

    DEFAULTS = {"inner": None, "least": 20, "share": 0.5}

    def fit(self, df):
        self.params["inner"].fit(df)
        self.fitted_columns, self.stats = [], {}
        return self

    def transform(self, df):
        kept = self.params["inner"].transform(df)
        before, after = df.count(), kept.count()
        return kept if after >= max(self.params["least"], self.params["share"] * before) else df


def local_outlier_factors(values: np.ndarray, k: int) -> np.ndarray:
    """LOF of sorted numbers: the k nearest lie within k ranks, so windows of 2k + 1 suffice."""
    n = len(values)
    k = min(k, n - 1)
    offsets = np.concatenate((np.arange(-k, 0), np.arange(1, k + 1)))
    at = np.arange(n)[:, None] + offsets
    gap = np.where((at >= 0) & (at < n), np.abs(values[np.clip(at, 0, n - 1)] - values[:, None]), np.inf)
    order = np.argsort(gap, axis=1, kind="stable")[:, :k]
    near = np.take_along_axis(np.clip(at, 0, n - 1), order, axis=1)
    distance = np.take_along_axis(gap, order, axis=1)
    reach = np.maximum(distance, distance[near, k - 1])
    density = 1 / (reach.mean(axis=1) + 1e-10)
    return density[near].mean(axis=1) / density


class LocalOutlierFactorCleaner(Action):
    """Univariate LOF per column: values over 1.5 are outliers (contamination auto), or the given share of largest factors.

    A column is cut into value ranges of about `range_rows` rows; each range borrows 3k rows on either side from its neighbours,
    which is as far as a factor looks, so ranges give the factors of the whole. A value that fills a range of its own
    (ties) makes that range as large as its count.
    """

    DEFAULTS = {"n_neighbors": 20, "contamination": "auto", "method": "mask", "range_rows": 20000}
    NUMERIC_ONLY = True

    def factors(self, df: DataFrame, c: str, key: str) -> DataFrame:
        """key, factor of every row with a value in the column."""
        k, size = self.params["n_neighbors"], self.params["range_rows"]
        rows = df.select(F.col(key).alias("k"), number(c).alias("v")).where("v is not null")
        n = rows.count()
        if n < 2:
            return rows.select("k", F.lit(1.0).alias("factor"))
        parts = max(1, n // size)
        cuts = sorted(set(rows.agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 10000)).first()[0])) if parts > 1 else []
        part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < F.col("v"))) if cuts else F.lit(0)
        own = rows.withColumn("part", part).withColumn("mine", F.lit(True))
        if cuts:
            up, down = Window.partitionBy("part").orderBy("v", "k"), Window.partitionBy("part").orderBy(F.desc("v"), F.desc("k"))
            ranked = own.withColumn("a", F.row_number().over(up)).withColumn("b", F.row_number().over(down))
            halo = ranked.where(F.col("a") <= 3 * k).withColumn("part", F.col("part") - 1).unionByName(ranked.where(F.col("b") <= 3 * k).withColumn("part", F.col("part") + 1)).withColumn("mine", F.lit(False)).drop("a", "b")
            own = own.unionByName(halo)

        def run(table: pa.Table) -> pa.Table:
            v, mine = table["v"].to_numpy(), table["mine"].to_numpy()
            order = np.argsort(v, kind="stable")
            f = np.empty(len(v))
            f[order] = local_outlier_factors(v[order], k) if len(v) > 1 else 1.0
            return table.select(["k"]).append_column("factor", pa.array(f)).filter(pa.array(mine))

        kind = rows.schema["k"].dataType.simpleString()
        return own.groupBy("part").applyInArrow(run, f"k {kind}, factor double")

    def fit(self, df):
        self.fitted_columns, self.stats = self.select_columns(df), {}
        return self

    def apply(self, df, columns, stats):
        if self.params["method"] not in ("mask", "drop"):
            raise ValueError("method is mask or drop")
        key = self.params.get("key")
        if key is None:
            raise ValueError("LocalOutlierFactorCleaner needs the name of a key column")
        bad = []
        for c in (c for c in columns if c != key):
            found = self.factors(df, c, key)
            limit = 1.5 if self.params["contamination"] == "auto" else exact_quantiles(found, {"f": Quantiles(F.col("factor"), [1 - self.params["contamination"]], True)})["f"]
            marked = found.where(F.col("factor") > limit).select(F.col("k").alias(f"_k_{c}"), F.lit(True).alias(f"_out_{c}"))
            df = df.join(marked, F.col(key) == F.col(f"_k_{c}"), "left").drop(f"_k_{c}")
            bad.append(c)
        if self.params["method"] == "drop":
            out = df.where(reduce(lambda a, b: a & b, (F.col(f"_out_{c}").isNull() for c in bad), F.lit(True)))
        else:
            out = df.withColumns({c: F.when(F.col(f"_out_{c}").isNull(), F.col(f"`{c}`")) for c in bad})
        return out.drop(*(f"_out_{c}" for c in bad))


def boxes(x: np.ndarray, most: int) -> tuple[list[tuple[int, float, int, int]], int]:
    """Splits (column, cut, child below or at it, child above) that halve the points by their widest column into at most `most`
    leaves, numbered -1, -2, ...; and how many leaves there are."""
    splits: list[tuple[int, float, int, int]] = []
    leaves = 0

    def grow(own: np.ndarray, most: int) -> int:
        nonlocal leaves
        spread = own.max(axis=0) - own.min(axis=0) if len(own) else np.zeros(1)
        if most < 2 or not spread.max() > 0:
            leaves += 1
            return -leaves
        column = int(spread.argmax())
        v = own[:, column]
        cut = float(np.quantile(v, 0.5, method="lower"))
        if cut == v.max():
            cut = float(v[v < cut].max())
        at = len(splits)
        splits.append((column, cut, 0, 0))
        splits[at] = (column, cut, grow(own[v <= cut], most // 2), grow(own[v > cut], most - most // 2))
        return at

    grow(x, most)
    return splits, leaves


def nearest_rows(df: DataFrame, key: str, columns: list[str], k: int, block: int = 4096) -> DataFrame:
    """q, d, distance, r: the k nearest other rows of every row (Euclidean, ties to the smaller key), of rows without nulls.

    A block is a box of about as many rows. A row is held against those of its own block first, then against the blocks whose
    boxes are no farther than the k-th of these, so the search is exact and few rows travel to more than the next blocks. Of rows
    at one point only the k + 1 of least keys can be anyone's neighbours, and all beyond have the same ones, so one of them
    searches for the rest.
    """
    kind = df.schema[key].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError("the key must be an integer")
    rows = df.select(F.col(key).cast("long").alias("q"), F.array(*(number(c) for c in columns)).alias("x")).where(~F.exists("x", lambda v: v.isNull()) & F.col("q").isNotNull())
    rows = written(rows.withColumn("p", F.dense_rank().over(Window.partitionBy("x").orderBy("q"))), "points")
    asking = rows.where(F.col("p") <= k + 2)
    n = asking.count()
    blocks = max(1, -(-n // block))
    drawn = asking.sample(min(1.0, 64 * blocks / n), 0).select("x").collect() if blocks > 1 else []
    splits, _ = boxes(np.array([r["x"] for r in drawn], float).reshape(-1, len(columns)), blocks)

    @F.pandas_udf("int")
    def place(x: pd.Series) -> pd.Series:
        m, at = np.array(x.tolist(), float).reshape(len(x), -1), np.zeros(len(x), int)
        for _ in range(len(splits)):
            inner = np.flatnonzero(at >= 0)
            if not len(inner):
                break
            column, cut, low, high = (np.array(c) for c in zip(*splits, strict=True))
            node = at[inner]
            at[inner] = np.where(m[inner, column[node]] <= cut[node], low[node], high[node])
        return pd.Series(-1 - at if splits else at)

    asking = written(asking.withColumn("b", place("x")), "blocks")
    box = asking.groupBy("b").agg(*(f(F.col("x")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(len(columns)))).collect()  # a row a block
    names = np.array([r["b"] for r in box], int)
    low, high = (np.array([[r[f"{end}{i}"] for i in range(len(columns))] for r in box], float).reshape(-1, len(columns)) for end in ("low", "high"))

    def nearest(q: int, x: np.ndarray, keys: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distance = np.sqrt(((m - x) ** 2).sum(axis=1))
        distance[keys == q] = np.inf  # a row is no neighbour of its own
        if len(keys) > k + 1:
            near = np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1])
        else:
            near = np.arange(len(keys))
        near = near[(keys[near] != q)]
        near = near[np.lexsort((keys[near], distance[near]))[:k]]
        return keys[near], distance[near]

    def points(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return t["q"].to_numpy(), np.array(t["x"].to_pylist(), float).reshape(t.num_rows, -1)

    def within(t: pa.Table) -> pa.Table:
        (q, x), mine = points(t), t["b"][0].as_py()
        few = t["p"].to_numpy() <= k + 1
        out = []
        for i in range(len(q)):
            d, distance = nearest(q[i], x[i], q[few], x[few])
            far = distance[-1] * (1 + 1e-9) if len(d) == k else np.inf
            away = np.sqrt((np.maximum(0, np.maximum(low - x[i], x[i] - high)) ** 2).sum(axis=1))
            out.append((int(q[i]), x[i].tolist(), d.tolist(), distance.tolist(), names[(away <= far) & (names != mine)].tolist()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), first, strict=True)], schema=first)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if a.num_rows and b.num_rows:
            keys, m = points(b)
            for q, x in zip(*points(a), strict=True):
                d, distance = nearest(q, x, keys, m)
                for column, v in zip(out, ([int(q)] * len(d), d.tolist(), distance.tolist()), strict=True):
                    column += v
        return pa.table([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    schema = pa.schema([("q", pa.int64()), ("d", pa.int64()), ("distance", pa.float64())])
    first = pa.schema([("q", pa.int64()), ("x", pa.list_(pa.float64())), ("d", pa.list_(pa.int64())), ("distance", pa.list_(pa.float64())), ("to", pa.list_(pa.int32()))])
    own = written(asking.groupBy("b").applyInArrow(within, "q long, x array<double>, d array<long>, distance array<double>, to array<int>"), "own-blocks")
    found = own.select("q", F.inline(F.arrays_zip("d", "distance")))
    if blocks > 1:
        left, right = own.select("q", "x", F.explode("to").alias("b")), asking.where(F.col("p") <= k + 1).select("q", "x", "b")
        found = found.unionByName(left.groupBy("b").cogroup(right.groupBy("b")).applyInArrow(meet, "q long, d long, distance double"))
    found = written(found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("distance", "d"))).where(F.col("r") <= k), "found")
    asked = rows.where(F.col("p") == k + 2).select("x", F.col("q").cast("long").alias("at")).distinct()
    others = rows.where(F.col("p") > k + 2).select("x", F.col("q").cast("long").alias("q")).join(asked, "x")
    return found.unionByName(others.join(found.withColumnRenamed("q", "at"), "at").select(*found.columns))


class MultivariateLOFCleaner(Action):
    """Drops rows with nulls and the `contamination` share of rows of largest local outlier factor, over all columns together."""

    DEFAULTS = {"n_neighbors": 4, "contamination": 0.1, "key": None, "block": 4096}
    NUMERIC_ONLY = True

    def factors(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """q, factor of every row without nulls."""
        key = self.params["key"]
        if key is None:
            raise ValueError("MultivariateLOFCleaner needs the name of an integer key column")
        near = written(nearest_rows(df, key, [c for c in columns if c != key], self.params["n_neighbors"], self.params["block"]), "neighbours")
        reach = near.groupBy("q").agg(F.max("distance").alias("far")).select(F.col("q").alias("d"), "far")
        density = written(near.join(reach, "d").groupBy("q").agg((1 / (F.avg(F.greatest("distance", "far")) + 1e-10)).alias("density")), "densities")
        of = density.select(F.col("q").alias("d"), F.col("density").alias("theirs"))
        return near.join(of, "d").groupBy("q").agg(F.avg("theirs").alias("theirs")).join(density, "q").select("q", (F.col("theirs") / F.col("density")).alias("factor"))

    def fit(self, df):
        self.fitted_columns, self.stats = self.select_columns(df), {}
        return self

    def apply(self, df, columns, stats):
        found = written(self.factors(df, columns), "factors")
        limit = exact_quantiles(found, {"f": Quantiles(F.col("factor"), [1 - self.params["contamination"]], True)})["f"]
        kept = found.where(F.col("factor") <= F.lit(limit)).select("q") if limit is not None else found.select("q")
        return df.join(kept, df[self.params["key"]] == kept["q"], "left_semi")


class IsolationForestCleaner(Action):
    """Drops the `contamination` share of rows that random splits isolate soonest; trees grow on a bounded sample by hash."""

    DEFAULTS = {"contamination": 0.05, "trees": 100, "sample": 256, "random_state": 42}
    NUMERIC_ONLY = True

    def settle(self, df, columns, stats):
        rng = np.random.default_rng(self.params["random_state"])
        most = self.params["sample"] * 8
        rows = df.select(*(F.coalesce(number(c), F.lit(0.0)).alias(c) for c in columns))
        x = np.array([tuple(r) for r in rows.orderBy(F.xxhash64(*columns, F.lit(self.params["random_state"])), *columns).limit(most).collect()], float)

        def grow(own: np.ndarray, depth: int):
            low, high = own.min(axis=0), own.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if depth == 0 or len(own) < 2 or not len(open_):
                return len(own)
            j = int(rng.choice(open_))
            cut = float(rng.uniform(low[j], high[j]))
            return j, cut, grow(own[own[:, j] < cut], depth - 1), grow(own[own[:, j] >= cut], depth - 1)

        size = min(self.params["sample"], len(x))
        trees = [grow(x[rng.choice(len(x), size, replace=False)], int(np.ceil(np.log2(max(2, size))))) for _ in range(self.params["trees"])] if len(x) else []
        scored = rows.select(isolation_depth(columns, trees).alias("d"))
        return {"trees": trees, "limit": exact_quantiles(scored, {"d": Quantiles(F.col("d"), [self.params["contamination"]], True)})["d"]}

    def apply(self, df, columns, stats):
        if stats["limit"] is None:
            return df
        shifted = df.withColumns({f"_i_{c}": F.coalesce(number(c), F.lit(0.0)) for c in columns})
        return shifted.where(isolation_depth([f"_i_{c}" for c in columns], stats["trees"]) > stats["limit"]).drop(*(f"_i_{c}" for c in columns))


def isolation_depth(columns: list[str], trees: list) -> Column:
    def unsplit(n: int) -> float:
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    @F.pandas_udf("double")
    def depth(*series: pd.Series) -> pd.Series:
        x = np.stack([s.to_numpy(float) for s in series], axis=1)
        total = np.zeros(len(x))
        for tree in trees:
            stack = [(tree, np.arange(len(x)), 0)]
            while stack:
                node, own, d = stack.pop()
                if not len(own):
                    continue
                if isinstance(node, tuple):
                    left = x[own, node[0]] < node[1]
                    stack += [(node[2], own[left], d + 1), (node[3], own[~left], d + 1)]
                else:
                    total[own] += d + unsplit(node)
        return pd.Series(total / max(1, len(trees)))

    return depth(*(F.col(f"`{c}`") for c in columns))


class ParameterizedOutlierRemover(ParameterizedAction):
    """Row removal by inclusive bounds; nulls stay."""

    NUMERIC_ONLY = True
    PARAM_SPECS = (ParamSpec("method", "categorical", choices=("iqr", "zscore"), default="iqr"), ParamSpec("threshold", "float", 0.5, 5.0, default=1.5))

    def settle(self, df, columns, stats):
        inner = IQROutlierCleaner(factor=self.params["threshold"], method="drop") if self.params["method"] == "iqr" else ZScoreOutlierCleaner(threshold=self.params["threshold"], method="drop")
        found = inner.compute(df, columns)
        return {c: b for c in columns if (b := inner.bounds(c, found))}

    def apply(self, df, columns, stats):
        return bounded(df, stats, "drop")
