"""Distances between the distributions of two frames. Each is lazy down to a one-row frame; `calculate` takes the number."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions.stats import adjusted_kurtosis, adjusted_skew, correlation, number, numeric_columns
from sievelake.plans.shared import written

BINS = 50
TINY = 1e-10


def common(p: DataFrame, q: DataFrame, numeric: bool = True) -> list[str]:
    own = set(numeric_columns(q)) if numeric else set(q.columns)
    return [c for c in (numeric_columns(p) if numeric else p.columns) if c in own]


def both(p: DataFrame, q: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of both frames, marked by side; columns as double."""
    take = lambda df, side: df.select(F.lit(side).alias("_side"), *(number(c).alias(c) for c in columns))
    return take(p, 0).unionByName(take(q, 1))


class BaseDistance:
    name = "distance"

    def frame(self, p: DataFrame, q: DataFrame) -> DataFrame:
        """One row, one column `value`."""
        raise NotImplementedError

    def calculate(self, p: DataFrame | None, q: DataFrame | None) -> float:
        if p is None or q is None:
            return 0.0
        value = self.frame(p, q).first()
        return float(value[0]) if value and value[0] is not None else 0.0


def histograms(p: DataFrame, q: DataFrame, bins: int = BINS) -> DataFrame:
    """feature, bin, p, q: shares of every bin, empty ones too. Numbers: equal bins over the joint range, the last one closed; other
    columns: their values. All columns are unpivoted, so bounds and counts take one aggregate each."""
    numeric = common(p, q)
    texts = [c for c in common(p, q, False) if c not in numeric]
    parts = []
    if numeric:
        entries = lambda side_df, side: side_df.select(F.lit(side).alias("side"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), number(c).alias("v")) for c in numeric))).alias("e")).select("side", "e.*").where("v is not null")
        long = entries(p, 0).unionByName(entries(q, 1))
        ends = long.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))  # a row per column
        place = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int"))
        counts = long.join(F.broadcast(ends), "feature").withColumn("bin", place).groupBy("feature", "bin").agg(F.count(F.when(F.col("side") == 0, 1)).alias("p"), F.count(F.when(F.col("side") == 1, 1)).alias("q"))
        grid = ends.select("feature", F.explode(F.when(F.col("hi") == F.col("lo"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(bins - 1)))).alias("bin"))
        filled = grid.join(counts, ["feature", "bin"], "left").select("feature", F.col("bin").cast("string").alias("bin"), F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("q", F.lit(0)).alias("q"))
        parts.append(filled)
    if texts:
        entries = lambda side_df, side: side_df.select(F.lit(side).alias("side"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("string").alias("bin")) for c in texts))).alias("e")).select("side", "e.*").where("bin is not null")
        long = entries(p, 0).unionByName(entries(q, 1))
        parts.append(long.groupBy("feature", "bin").agg(F.count(F.when(F.col("side") == 0, 1)).alias("p"), F.count(F.when(F.col("side") == 1, 1)).alias("q")))
    if not parts:
        return p.sparkSession.createDataFrame([], "feature string, bin string, p double, q double")
    whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    totals = whole.groupBy("feature").agg(F.sum("p").alias("np"), F.sum("q").alias("nq")).where("np > 0 and nq > 0")
    return whole.join(totals, "feature").select("feature", "bin", (F.col("p") / F.col("np")).alias("p"), (F.col("q") / F.col("nq")).alias("q"))


class BaseDistribution(BaseDistance):
    """The mean over columns of a divergence of their histograms."""

    def per_feature(self, h: DataFrame) -> DataFrame:
        """feature, value."""
        return h.groupBy("feature").agg(self.value().alias("value"))

    def value(self) -> Column:
        raise NotImplementedError

    def frame(self, p, q):
        return self.per_feature(histograms(p, q)).agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("value"))


class ChiSquared(BaseDistribution):
    name = "chi_squared"

    def value(self):
        return 0.5 * F.sum(F.pow(F.col("p") - F.col("q"), F.lit(2)) / (F.col("p") + F.col("q") + TINY))


class HistogramIntersection(BaseDistribution):
    name = "hist_intersection"

    def value(self):
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.sum(F.least("p", "q"))))


class HistogramCorrelation(BaseDistribution):
    """1 - r over all bins; below two bins 0; an undefined r is 0 for equal histograms, else 1."""

    name = "hist_correlation"

    def value(self):
        flat = (F.stddev_pop("p") == 0) | (F.stddev_pop("q") == 0)
        far = F.max(F.abs(F.col("p") - F.col("q"))) > 1e-8
        return F.when(F.count(F.lit(1)) < 2, 0.0).when(flat, far.cast("double")).otherwise(1 - correlation("p", "q"))


def _relative(a: str, m: Column) -> Column:
    return F.sum(F.when(F.col(a) > 0, F.col(a) * F.log(F.try_divide(F.col(a), m))).otherwise(0.0))


class JensenShannon(BaseDistribution):
    """The square root of the divergence, natural logarithms."""

    name = "jensen_shannon"

    def value(self):
        m = (F.col("p") + F.col("q")) / 2
        return F.sqrt(F.greatest(F.lit(0.0), (_relative("p", m) + _relative("q", m)) / 2))


class KullbackLeibler(BaseDistribution):
    """Sum p ln(p / q), empty bins of q at 1e-10, q made to sum to 1 again."""

    name = "kl_divergence"

    def per_feature(self, h):
        held = h.withColumn("q", F.when(F.col("q") == 0, TINY).otherwise(F.col("q")))
        total = held.groupBy("feature").agg(F.sum("q").alias("_t"))
        return held.join(total, "feature").withColumn("q", F.col("q") / F.col("_t")).groupBy("feature").agg(_relative("p", F.col("q")).alias("value"))


def steps(p: DataFrame, q: DataFrame, columns: list[str], buckets: int = 256, weight: str | None = None) -> DataFrame:
    """feature, width, fp, fq: the two distribution functions of each column between one value and the next.

    Values are counted first, so repeated ones weigh nothing, and the counts are a written table, as three plans read it;
    running counts go by value ranges: within a range by a window, between ranges by the sums of those before (at most
    `buckets` rows a column). With a `weight` column a row stands for so many.
    """
    w = F.col(weight) if weight else F.lit(1).cast("long")
    entries = lambda df, side: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), number(c).alias("v")) for c in columns))).alias("e"), w.alias("w")).select("e.*", "w", F.lit(side).alias("side")).where("v is not null")
    long = entries(p, 0).unionByName(entries(q, 1))
    counts = written(long.groupBy("feature", "v").agg(*(F.sum(F.when(F.col("side") == s, F.col("w")).otherwise(0)).alias(c) for s, c in ((0, "cp"), (1, "cq")))), "value-counts")
    cuts = counts.groupBy("feature").agg(F.percentile_approx("v", [i / buckets for i in range(1, buckets)], 5000).alias("cuts"))
    # how many cuts lie below a value: every sixteenth first, then the fifteen after the last of those
    below = lambda own: F.size(F.filter(own, lambda x: x < F.col("v")))
    cuts = cuts.withColumn("sixteenths", F.filter("cuts", lambda x, i: i % 16 == 15))
    placed = counts.join(F.broadcast(cuts), "feature").withColumn("c", 16 * below("sixteenths"))
    placed = placed.withColumn("b", F.col("c") + below(F.slice("cuts", F.col("c") + 1, F.lit(15)))).drop("cuts", "sixteenths", "c")
    within = Window.partitionBy("feature", "b").orderBy("v")
    sums = placed.groupBy("feature", "b").agg(F.sum("cp").alias("sp"), F.sum("cq").alias("sq"), F.min("v").alias("first"))
    over = Window.partitionBy("feature").orderBy("b")
    before = sums.select("feature", "b", (F.sum("sp").over(over) - F.col("sp")).alias("bp"), (F.sum("sq").over(over) - F.col("sq")).alias("bq"), F.lead("first").over(over).alias("then"))
    totals = sums.groupBy("feature").agg(F.sum("sp").alias("np"), F.sum("sq").alias("nq")).where("np > 0 and nq > 0")
    run = within.rowsBetween(Window.unboundedPreceding, 0)
    lines = placed.join(before, ["feature", "b"]).withColumn("next", F.coalesce(F.lead("v").over(within), F.col("then"))).withColumn("fp", F.sum("cp").over(run) + F.col("bp")).withColumn("fq", F.sum("cq").over(run) + F.col("bq"))
    return lines.join(F.broadcast(totals), "feature").select("feature", (F.col("next") - F.col("v")).alias("width"), (F.col("fp") / F.col("np")).alias("fp"), (F.col("fq") / F.col("nq")).alias("fq"))


def wasserstein(p: DataFrame, q: DataFrame, columns: list[str], buckets: int = 256) -> DataFrame:
    """feature, value: the area between the two distribution functions of each column."""
    return steps(p, q, columns, buckets).groupBy("feature").agg(F.coalesce(F.sum(F.abs(F.col("fp") - F.col("fq")) * F.col("width")), F.lit(0.0)).alias("value"))


#: Rows of a range of values, and rows that a task holds at a time, about.
AREA_ROWS = 1 << 20


def areas(p: DataFrame, q: DataFrame, columns: list[str], over: Callable[[np.ndarray], np.ndarray] | None, lines: np.ndarray | None = None, weight: str | None = None, most: int = AREA_ROWS) -> list[float | None]:
    """The integral of `over` the gap of the two distribution functions (0 where there is none), of each column, or of the rows'
    projections on each of the `lines` (columns x lines, rounded to 9 digits); None where a side has no value. Without `over`: the
    share of the pairs of rows in which p's value is the larger, ties for half.

    As `steps` finds them, for columns of mostly different values: a task sorts and counts what it holds of a column and sends it
    as one piece a value range, so pieces move, not values. A draw of the rows sets the ranges' bounds, which leave the result
    alone; the driver sees the counts by range, a range is integrated by itself.
    """
    w = F.col(weight) if weight else F.lit(1)
    side = lambda df, s: df.select(*(number(c).alias(f"x{i}") for i, c in enumerate(columns)), w.cast("long").alias("w"), F.lit(s).alias("side"))
    rows, d = side(p, 0).unionByName(side(q, 1)), len(columns)
    features = d if lines is None else lines.shape[1]

    def feature(x: np.ndarray, f: int) -> np.ndarray:
        # the distribution functions run over values, so a digit lost to the order of sums is no step
        return x[:, f] if lines is None else np.round(sum(x[:, i] * lines[i, f] for i in range(d)), 9)

    matrix = lambda b: np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(d)]).astype(float)

    def held(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        own, n = [], 0
        for batch in stream:
            own.append(batch)
            n += batch.num_rows
            if n >= most:
                yield joined(own)
                own, n = [], 0
        if n:
            yield joined(own)

    def joined(own: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.concatenate([matrix(b) for b in own]), *(np.concatenate([b.column(d + i).to_numpy() for b in own]) for i in (0, 1))

    n = rows.count()
    ranges = -(-n // most)
    cuts = [np.zeros(0)] * features
    if ranges > 1:
        drawn = rows.sample(min(1.0, 64 * ranges / n), 0).select(*(f"x{i}" for i in range(d))).toArrow().combine_chunks().to_batches()
        x = np.concatenate([matrix(b) for b in drawn]) if drawn else np.zeros((0, d))
        for f in range(features):
            v = feature(x, f)
            v = v[~np.isnan(v)]
            cuts[f] = np.unique(np.quantile(v, np.arange(1, ranges) / ranges, method="lower")) if len(v) else v

    def masses(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, features * ranges))
        for x, w, s in held(stream):
            for f in range(features):
                v = feature(x, f)
                own = ~np.isnan(v)
                at = f * ranges + np.searchsorted(cuts[f], v[own], "right")
                for k in (0, 1):
                    total[k] += np.bincount(at, w[own] * (s[own] == k), features * ranges)
        found = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(found), *(pa.array(t[found].astype(np.int64)) for t in total)], ["at", "cp", "cq"])

    counts = np.zeros((2, features, max(1, ranges)), np.int64)
    for r in rows.mapInArrow(masses, "at long, cp long, cq long").groupBy("at").agg(F.sum("cp").alias("cp"), F.sum("cq").alias("cq")).collect():  # a row a feature and range
        counts[:, r["at"] // ranges, r["at"] % ranges] = r["cp"], r["cq"]
    totals, before = counts.sum(2), counts.cumsum(2) - counts

    def pieces(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, w, s in held(stream):
            for f in range(features):
                v = feature(x, f)
                order = np.argsort(v)[: len(v) - np.isnan(v).sum()]  # nan comes last
                if not len(order):
                    continue
                v, own, of = v[order], w[order], s[order]
                first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
                v, by = v[first], [np.add.reduceat(own * (of == k), first) for k in (0, 1)]
                ends = np.concatenate(([0], np.searchsorted(v, cuts[f], "left"), [len(v)]))
                full = np.flatnonzero(ends[1:] > ends[:-1])
                cut = lambda a, ends=ends, full=full: pa.array([a[ends[b] : ends[b + 1]].tobytes() for b in full], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), f, np.int32)), pa.array(full.astype(np.int32)), cut(v), *map(cut, by)], ["feature", "range", "v", "cp", "cq"])

    def area(key: tuple, table: pa.Table) -> pa.Table:
        f, b = (k.as_py() for k in key)
        v, *by = (np.concatenate([np.frombuffer(piece.as_buffer(), t) for piece in table.column(c)]) for c, t in (("v", float), ("cp", np.int64), ("cq", np.int64)))
        order = np.argsort(v)
        v = v[order]
        if over is None:
            first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            ours, theirs = (np.add.reduceat(c[order], first) for c in by)
            value = float((ours * ((before[1, f, b] + theirs.cumsum() - theirs / 2) / totals[1, f])).sum() / totals[0, f])
            return pa.table({"feature": pa.array([f], pa.int32()), "range": pa.array([b], pa.int32()), "area": [value]})
        gap = [np.append(before[k, f, b], before[k, f, b] + by[k][order].cumsum()) / totals[k, f] for k in (0, 1)]
        edges = np.concatenate((cuts[f][b - 1 : b] if b else v[:1], v, cuts[f][b : b + 1] if b < len(cuts[f]) else v[-1:]))
        return pa.table({"feature": pa.array([f], pa.int32()), "range": pa.array([b], pa.int32()), "area": [float((over(gap[0] - gap[1]) * np.diff(edges)).sum())]})

    out: list[float | None] = [0.0 if totals[:, f].all() else None for f in range(features)]
    moved = rows.mapInArrow(pieces, "feature int, range int, v binary, cp binary, cq binary").where(F.col("feature").isin([f for f in range(features) if out[f] is not None]))
    for r in sorted(moved.groupBy("feature", "range").applyInArrow(area, "feature int, range int, area double").collect()):  # a row a feature and range
        out[r["feature"]] += r["area"]
    for f in range(features):  # ranges between two bounds without a value
        if over is not None and out[f] is not None:
            inner = np.arange(1, len(cuts[f]))
            inner = inner[counts[:, f, inner].sum(0) == 0]
            out[f] += float((over((before[0, f, inner] / totals[0, f]) - (before[1, f, inner] / totals[1, f])) * (cuts[f][inner] - cuts[f][inner - 1])).sum())
    return out


class Wasserstein(BaseDistance):
    name = "wasserstein"

    def frame(self, p, q):
        columns = common(p, q)
        if not columns:
            return p.sparkSession.range(1).select(F.lit(0.0).alias("value"))
        return wasserstein(p, q, columns).agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("value"))


class _Moment(BaseDistance):
    how = "mean"

    def statistic(self, x: Column) -> Column:
        raise NotImplementedError

    def frame(self, p, q):
        columns = common(p, q)
        if not columns:
            return p.sparkSession.range(1).select(F.lit(0.0).alias("value"))
        side = lambda s: F.array_compact(F.array(*(F.col(f"{c}_{s}") for c in range(len(columns)))))
        rows = both(p, q, columns).agg(*(self.statistic(F.when(F.col("_side") == s, F.col(f"`{c}`"))).alias(f"{i}_{s}") for i, c in enumerate(columns) for s in (0, 1)))
        return rows.select(F.abs(self.reduced(side(1)) - self.reduced(side(0))).alias("value"))

    def reduced(self, x: Column) -> Column:
        if self.how == "mean":
            value = F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / F.nullif(F.size(x), F.lit(0))
        elif self.how == "max":
            value = F.array_max(F.transform(x, self.sized))
        else:
            s, n = F.array_sort(x), F.size(x)
            value = F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)
        return F.coalesce(value, F.lit(0.0))

    @staticmethod
    def sized(x: Column) -> Column:
        return F.abs(x)


class SkewnessMean(_Moment):
    name = "skewness_mean"

    def statistic(self, x):
        return adjusted_skew(x)


class KurtosisMean(_Moment):
    name = "kurtosis_mean"

    def statistic(self, x):
        return adjusted_kurtosis(x)


class VarianceMean(_Moment):
    name = "variance_mean"

    def statistic(self, x):
        return F.var_samp(x)

    @staticmethod
    def sized(x):
        return x


def _variant(base: type, how: str) -> type:
    return type(f"{base.__name__[:-4]}{how.title()}", (base,), {"how": how, "name": base.name.replace("mean", how)})


SkewnessMax, SkewnessMedian = _variant(SkewnessMean, "max"), _variant(SkewnessMean, "median")
KurtosisMax, KurtosisMedian = _variant(KurtosisMean, "max"), _variant(KurtosisMean, "median")
VarianceMax, VarianceMedian = _variant(VarianceMean, "max"), _variant(VarianceMean, "median")


class CorrelationMatrix(BaseDistance):
    """Frobenius norm of the difference of the correlation matrices; an undefined entry is 0, the diagonal of constants too."""

    name = "correlation_matrix"

    def frame(self, p, q):
        columns = common(p, q)
        if not columns:
            return p.sparkSession.range(1).select(F.lit(0.0).alias("value"))
        one = lambda c, s: F.when(F.col("_side") == s, F.col(f"`{c}`"))
        exprs, terms = [], []
        for i, c in enumerate(columns):
            for s in (0, 1):
                exprs.append((F.coalesce(F.var_pop(one(c, s)), F.lit(0.0)) > 0).cast("double").alias(f"d{i}_{s}"))
            terms.append(F.pow(F.col(f"d{i}_1") - F.col(f"d{i}_0"), F.lit(2)))
        for i, (a, b) in enumerate(combinations(columns, 2)):
            for s in (0, 1):
                r = correlation(one(a, s), one(b, s))
                exprs.append(F.when(F.isnan(r), 0.0).otherwise(F.coalesce(r, F.lit(0.0))).alias(f"r{i}_{s}"))
            terms.append(2 * F.pow(F.col(f"r{i}_1") - F.col(f"r{i}_0"), F.lit(2)))
        return both(p, q, columns).agg(*exprs).select(F.sqrt(sum(terms[1:], terms[0])).alias("value"))


class MissingnessRatio(BaseDistance):
    name = "missingness"

    def frame(self, p, q):
        share = lambda df: df.agg((F.sum(sum((F.col(f"`{c}`").isNull().cast("long") for c in df.columns), F.lit(0))) / F.nullif(F.count(F.lit(1)) * len(df.columns), F.lit(0))).alias("s"))
        return share(p).withColumn("_side", F.lit(0)).unionByName(share(q).withColumn("_side", F.lit(1))).agg(F.abs(F.coalesce(F.max(F.when(F.col("_side") == 1, F.col("s"))), F.lit(0.0)) - F.coalesce(F.max(F.when(F.col("_side") == 0, F.col("s"))), F.lit(0.0))).alias("value"))


class RowCount(BaseDistance):
    name = "row_count"

    def frame(self, p, q):
        n = p.agg(F.count(F.lit(1)).alias("n")).withColumn("_side", F.lit(0)).unionByName(q.agg(F.count(F.lit(1)).alias("n")).withColumn("_side", F.lit(1)))
        of = lambda s: F.max(F.when(F.col("_side") == s, F.col("n")))
        return n.agg(F.coalesce(F.abs(of(1) - of(0)) / F.nullif(of(0), F.lit(0)), F.lit(0.0)).alias("value"))


DISTANCES = {d.name: d for d in (Wasserstein, KullbackLeibler, JensenShannon, ChiSquared, HistogramIntersection, HistogramCorrelation, SkewnessMean, SkewnessMax, SkewnessMedian, KurtosisMean, KurtosisMax, KurtosisMedian, VarianceMean, VarianceMax, VarianceMedian, CorrelationMatrix, MissingnessRatio, RowCount)}


def normalised_drift(reference: DataFrame, current: DataFrame, cap: float = 5.0) -> DataFrame:
    """Mean over columns of W1 over the reference's population deviation, each at most `cap`; constant columns are skipped."""
    columns = common(reference, current)
    w = wasserstein(reference, current, columns)
    spread = reference.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), number(c).alias("v")) for c in columns))).alias("e")).select("e.*").groupBy("feature").agg(F.stddev_pop("v").alias("sd"), F.count("v").alias("n"))
    return w.join(spread, "feature").where("sd > 0 and n > 1").agg(F.coalesce(F.avg(F.least(F.col("value") / F.col("sd"), F.lit(cap))), F.lit(0.0)).alias("value"))


def energy_distance(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Mean over columns of the energy distance, twice the integral of the squared difference of the distribution functions, and of its root."""
    by = steps(reference, current, common(reference, current)).groupBy("feature").agg(F.coalesce(F.sum(2 * (F.col("fp") - F.col("fq")) ** 2 * F.col("width")), F.lit(0.0)).alias("e"))
    return by.agg(F.coalesce(F.avg("e"), F.lit(0.0)).alias("value"), F.coalesce(F.avg(F.sqrt("e")), F.lit(0.0)).alias("root"))


def distortion(reference: DataFrame, current: DataFrame, weights: dict[str, float] | None = None) -> float:
    """A composite in [0, 1]: capped W1, base-2 Jensen-Shannon, correlation change, variance and skewness shift.

    The five component frames are one row each; only those rows reach the driver.
    """
    weights = weights or {"wasserstein": 0.30, "jensen_shannon": 0.25, "correlation": 0.20, "variance": 0.15, "skewness": 0.10}
    columns = common(reference, current)
    if not columns:
        return 0.0
    rows = both(reference, current, columns)
    one = lambda c, s: F.when(F.col("_side") == s, F.col(f"`{c}`"))
    m = rows.agg(*(e.alias(f"{k}_{i}_{s}") for i, c in enumerate(columns) for s in (0, 1) for k, e in (("var", F.var_pop(one(c, s))), ("skew", adjusted_skew(one(c, s)))))).first()
    w = {r.feature: r.value for r in wasserstein(reference, current, columns).collect()}  # a row a column
    mean = lambda v: sum(v) / len(v) if v else 1.0
    sd = {c: math.sqrt(m[f"var_{i}_0"] or 0.0) for i, c in enumerate(columns)}
    parts = {
        "wasserstein": mean([min(1.0, w.get(c, 0.0) / (3 * sd[c])) for c in columns if sd[c] > 0]),
        "jensen_shannon": min(1.0, JensenShannon().calculate(reference.select(columns), current.select(columns)) / math.sqrt(math.log(2))),
        "correlation": min(1.0, CorrelationMatrix().calculate(reference, current) / (2 * math.sqrt(len(columns)))),
        "variance": mean([min(1.0, abs(math.log(max(m[f"var_{i}_1"] or 0.0, TINY) / (m[f"var_{i}_0"]))) / 2) for i in range(len(columns)) if m[f"var_{i}_0"]]),
        "skewness": mean([min(1.0, abs(m[f"skew_{i}_1"] - m[f"skew_{i}_0"]) / (1 + abs(m[f"skew_{i}_0"]))) for i in range(len(columns)) if m[f"skew_{i}_0"] is not None and m[f"skew_{i}_1"] is not None]),
    }
    total = sum(weights.values())
    return min(1.0, max(0.0, sum(weights[k] / total * v for k, v in parts.items())))
