"""Learners that Spark's own library lacks: extremely randomised trees, forests that take one pass, and linear support vectors with
an L1 penalty.

All are loops of one or two aggregates whose size does not depend on the rows: extremely randomised trees grow by levels, all at
once; forests from sums by cell; the support vectors' quadratic model is summed over the rows within the margin, and its penalised
least found on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions.stats import number
from sievelake.operators.prior import counted
from sievelake.plans.shared import forget, spread, written

NODES = "kind string, at long, v double"


def summed(rows: DataFrame, gather, sizes: dict[str, tuple[int, ...]], least: tuple[str, ...] = ()) -> dict[str, np.ndarray]:
    """Arrays that gather(batches) sums in each task, added up; those named in `least` are minima."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, v in gather(stream).items():
            flat = v.ravel()
            at = np.flatnonzero(np.isfinite(flat) if name in least else flat)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(flat[at], pa.float64())], ["kind", "at", "v"])

    by = rows.mapInArrow(run, NODES).groupBy("kind", "at").agg(F.sum("v").alias("s"), F.min("v").alias("m"))
    out = {name: np.full(int(np.prod(size)), np.inf if name in least else 0.0) for name, size in sizes.items()}
    for r in by.collect():
        out[r["kind"]][r["at"]] = r["m"] if r["kind"] in least else r["s"]
    return {name: v.reshape(sizes[name]) for name, v in out.items()}


class ExtraTrees:
    """Trees whose nodes cut at a point drawn between the least and the largest value of a feature, the best of `max_features` drawn features.

    Every tree sees all rows. A level takes two aggregates: the ranges of the features at each open node, then the sums on either
    side of the cuts drawn in them. Draws follow tree, node and feature, so they do not depend on the partitions. `max_depth`
    bounds the statistics that a task holds: trees x open nodes x features.
    """

    def __init__(self, features: list[str], target: str, task: str = "classification", n_estimators: int = 50, max_depth: int = 10, max_features: str | int | None = "default", min_samples_split: int = 2, seed: int = 42):
        self.features, self.target, self.task, self.trees, self.max_depth, self.min_split, self.seed = features, target, task, n_estimators, max_depth, min_samples_split, seed
        p = len(features)
        default = max(1, int(np.sqrt(p))) if task == "classification" else p
        self.drawn_features = default if max_features == "default" else p if max_features is None else int(max_features)

    def rows(self, df: DataFrame) -> DataFrame:
        own = df.where(F.col(self.target).isNotNull())
        if self.task == "classification":
            self.classes = [r[0] for r in own.select(F.col(self.target).cast("string").alias("y")).distinct().orderBy("y").collect()]
            label = F.array_position(F.array(*map(F.lit, self.classes)), F.col(self.target).cast("string")).cast("double") - 1
        else:
            self.classes, label = [], number(self.target)
        return own.select(*(F.coalesce(number(c), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(self.features)), label.alias("y"))

    def counted(self, df: DataFrame) -> DataFrame:
        """Distinct rows and how many there are of each, written, as every level reads them twice."""
        rows = self.rows(df)
        return written(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("w")), "trees")

    def fit(self, df: DataFrame) -> ExtraTrees:
        rows, p, t = self.counted(df), len(self.features), self.trees
        k = len(self.classes) if self.task == "classification" else 3  # counts by class, or n, sum and sum of squares
        # heap numbering: node i has children 2i + 1 and 2i + 2; feature -1 is a leaf
        self.feature, self.cut, self.value = ({} for _ in range(3))
        self.gain = np.zeros(p)
        open_ = np.array([(tree, 0) for tree in range(t)], np.int64).reshape(-1, 2)
        for depth in range(self.max_depth + 1):
            if not len(open_):
                break
            place = {(int(a), int(b)): i for i, (a, b) in enumerate(open_)}
            n_open = len(open_)
            drawn = [(rng.random(p), rng.permutation(p)) for tree, node in open_.tolist() for rng in [np.random.default_rng([self.seed, tree, node])]]
            tables = self._tables()

            def located(x: np.ndarray, tables=tables, place=place, n_open=n_open) -> np.ndarray:
                """The open node of each row and tree, -1 where the row rests in a leaf."""
                return np.stack([walk(x, *tables[tree], {node: i for (a, node), i in place.items() if a == tree}) for tree in range(t)], 1)

            def ranges(stream, located=located, n_open=n_open) -> dict[str, np.ndarray]:
                low, high, stats = np.full((n_open, p), np.inf), np.full((n_open, p), np.inf), np.zeros((n_open, k))
                for batch in stream:
                    x, y = unpacked(batch, p)
                    at = located(x)
                    own = self._own(y, k) * batch.column(p + 1).to_numpy()[:, None]
                    for tree in range(t):
                        seen = at[:, tree] >= 0
                        np.minimum.at(low, at[seen, tree], x[seen])
                        np.minimum.at(high, at[seen, tree], -x[seen])
                        np.add.at(stats, at[seen, tree], own[seen])
                return {"low": low, "high": high, "stats": stats}

            got = summed(rows, ranges, {"low": (n_open, p), "high": (n_open, p), "stats": (n_open, k)}, ("low", "high"))
            low, high, stats = got["low"], -got["high"], got["stats"]
            count = stats.sum(1) if self.classes else stats[:, 0]
            for i, (tree, node) in enumerate(open_.tolist()):
                self.value[tree, node] = stats[i] / max(count[i], 1) if self.classes else stats[i, 1] / max(count[i], 1)
            varies = low < high
            impurity = self._impurity(stats)
            splits = (depth < self.max_depth) & (count >= self.min_split) & (impurity > 1e-12 * np.maximum(count, 1)) & varies.any(1)
            if not splits.any():
                break
            # the first of the drawn order that vary, as many as are to be drawn
            tried = np.zeros((n_open, p), bool)
            for i in np.flatnonzero(splits):
                tried[i, [f for f in drawn[i][1] if varies[i, f]][: self.drawn_features]] = True
            unit = np.array([u for u, _ in drawn])
            cuts = np.where(tried, low + unit * (np.where(tried, high, 0) - np.where(tried, low, 0)), np.inf)

            def sides(stream, located=located, n_open=n_open, cuts=cuts) -> dict[str, np.ndarray]:
                left = np.zeros((n_open, p, k))
                for batch in stream:
                    x, y = unpacked(batch, p)
                    at = located(x)
                    own = self._own(y, k) * batch.column(p + 1).to_numpy()[:, None]
                    for tree in range(t):
                        seen = np.flatnonzero(at[:, tree] >= 0)
                        node = at[seen, tree]
                        under = x[seen] <= cuts[node]
                        for f in range(p):
                            np.add.at(left[:, f], node[under[:, f]], own[seen[under[:, f]]])
                return {"left": left}

            left = summed(rows, sides, {"left": (n_open, p, k)})["left"]
            drop = impurity[:, None] - self._impurity(left) - self._impurity(stats[:, None] - left)
            drop = np.where(tried, drop, -np.inf)
            following = []
            for i in np.flatnonzero(splits):
                f = int((drop[i] >= drop[i].max() - 1e-9 * impurity[i]).argmax())  # of equal ones the first, whatever the order of the sums
                tree, node = open_[i].tolist()
                self.feature[tree, node], self.cut[tree, node] = f, float(cuts[i, f])
                self.gain[f] += max(0.0, drop[i, f])
                following += [(tree, 2 * node + 1), (tree, 2 * node + 2)]
            open_ = np.array(following, np.int64).reshape(-1, 2)
        forget(rows)
        return self

    def _own(self, y: np.ndarray, k: int) -> np.ndarray:
        return np.eye(k)[y.astype(int)] if self.classes else np.column_stack((np.ones(len(y)), y, y * y))

    def _impurity(self, stats: np.ndarray) -> np.ndarray:
        """Count times Gini impurity, or the squared error."""
        if self.classes:
            n = stats.sum(-1)
            return n - (stats**2).sum(-1) / np.maximum(n, 1e-300)
        return np.maximum(stats[..., 2] - stats[..., 1] ** 2 / np.maximum(stats[..., 0], 1e-300), 0.0)

    def _tables(self) -> list[tuple[dict, dict]]:
        out = [({}, {}) for _ in range(self.trees)]
        for (tree, node), f in self.feature.items():
            out[tree][0][node], out[tree][1][node] = f, self.cut[tree, node]
        return out

    @property
    def importances(self) -> np.ndarray:
        return self.gain / self.gain.sum() if self.gain.sum() > 0 else self.gain

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean over trees of the leaves' shares by class, or of their means."""
        total = 0.0
        for tree, (feature, cut) in enumerate(self._tables()):
            at = rest(x, feature, cut)
            total = total + np.array([self.value[tree, int(node)] for node in at])
        return total / self.trees

    def prediction(self, df_columns: list[Column]) -> Column:
        own = self

        @F.pandas_udf("double")
        def run(*series: pd.Series) -> pd.Series:
            x = np.column_stack([s.fillna(0.0).to_numpy(float) for s in series])
            found = own.predict(x)
            return pd.Series(found.argmax(1).astype(float) if own.classes else found)

        return run(*df_columns)


#: Chances that a row is drawn at most 0, 1, 2, ... times in a sample with replacement.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


def cuts_of(x: Column) -> Column:
    """For `ranges`: values at thousandths of an expression, those of a column of few values being all that are not very rare."""
    return F.percentile_approx(x, F.split(F.lit(" ".join(str(i / 1024) for i in range(1, 1024))), " ").cast("array<double>"), 10000)


def ranges(quantiles: list[float], bins: int = 32) -> np.ndarray:
    """At most bins - 1 upper ends: all of the values if they are so few, else equal shares."""
    own = np.unique(quantiles)
    return own if len(own) < bins else np.unique(np.quantile(quantiles, np.arange(1, bins) / bins, method="lower"))


class BinnedForest:
    """A random forest for a number that is grown from one aggregate: features are cut into ranges, at most 32 each.

    Trees split between ranges only, so all that they need of the rows are count, sum and sum of squares of those drawn in each
    cell (a range of every feature). One pass sums these for all trees, whatever their depth; trees are then grown in groups of
    `TOGETHER`, and the forest is a mean by cell. Rows are drawn with replacement, by a hash of `ident` that is the same in
    every fit. A third of the features is tried at a node. What a task holds is trees x cells: see `fits`.
    """

    #: Most trees x cells.
    MOST = 1 << 21
    TOGETHER = 10

    def __init__(self, features: list[str], target: str, cuts: list[np.ndarray], ident: str, n_estimators: int = 50, max_depth: int = 6, seed: int = 42):
        self.features, self.target, self.cuts, self.ident, self.trees, self.max_depth, self.seed = features, target, cuts, ident, n_estimators, max_depth, seed
        self.shape = tuple(len(c) + 1 for c in cuts)

    @property
    def fits(self) -> bool:
        return self.trees * math.prod(self.shape) <= self.MOST

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.ravel_multi_index([np.searchsorted(c, x[:, i]) for i, c in enumerate(self.cuts)], self.shape)

    def fit(self, df: DataFrame, centre: float = 0.0) -> BinnedForest:
        """`centre` is taken off the target while squares are summed."""
        p, size = len(self.features), math.prod(self.shape)

        def gather(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = None
            for batch in stream:
                x, y = unpacked(batch, p)
                if not len(y):
                    continue
                sums = np.zeros((self.trees, 3, size)) if sums is None else sums
                cell, y = self.cells(x), y - centre
                order = np.argsort(cell, kind="stable")
                own, starts = np.unique(cell[order], return_index=True)
                drawn, y = np.searchsorted(POISSON, counted(batch.column(p + 1).to_numpy()[order], self.trees, self.seed), "right").astype(float), y[order, None]
                for k, w in enumerate((drawn, drawn * y, drawn * y * y)):
                    sums[:, k, own] += np.add.reduceat(w, starts, axis=0).T
            if sums is not None:
                firsts = range(0, self.trees, self.TOGETHER)
                yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.int32()), pa.array([sums[i : i + self.TOGETHER].tobytes() for i in firsts], pa.binary())], ["first", "sums"])

        def grow(table: pa.Table) -> pa.Table:
            first = table["first"][0].as_py()
            sums = sum(np.frombuffer(s.as_py()) for s in table["sums"]).reshape(-1, 3, *self.shape)
            return pa.table({"first": pa.array([first], pa.int32()), "means": pa.array([self.grown(sums, first).tobytes()], pa.binary())})

        rows = df.where(F.col(f"`{self.target}`").isNotNull()).select(*(number(c).alias(f"x{i}") for i, c in enumerate(self.features)), number(self.target).alias("y"), self.ident)
        found = rows.mapInArrow(gather, "first int, sums binary").groupBy("first").applyInArrow(grow, "first int, means binary").collect()  # a row for every ten trees
        tables = [m for r in sorted(found) for m in np.frombuffer(r["means"]).reshape(-1, size) if not np.isnan(m).any()]
        self.means = centre + (np.mean(tables, axis=0) if tables else np.zeros(size))
        return self

    def grown(self, sums: np.ndarray, first: int = 0) -> np.ndarray:
        """Means by cell of the trees from the first on, grown a level at a time; NaN for one that drew no row."""
        p, whole = len(self.shape), sums.reshape(len(sums), 3, -1).sum(2)
        out = np.full((len(sums), *self.shape), np.nan)
        # running sums over all features: what is in a box follows from its corners
        running = np.pad(sums, [(0, 0), (0, 0)] + [(1, 0)] * p)
        for f in range(p):
            running = np.cumsum(running, f + 2)
        tree = np.flatnonzero(whole[:, 0])
        node, low, high = np.zeros(len(tree), np.int64), np.zeros((len(tree), p), np.int64), np.tile(self.shape, (len(tree), 1))
        for depth in range(self.max_depth + 1 if len(tree) else 0):
            m, least = len(node), whole[tree, 2]
            order = np.argsort(counted(node * self.trees + first + tree, p, self.seed + 1), 1)[:, : -(-p // 3)]
            best, where = np.zeros(m), np.full((m, 2), -1)
            for f in range(p):
                others = [g for g in range(p) if g != f]
                line = np.zeros((m, 3, self.shape[f] + 1))
                turned = np.moveaxis(running, (1, f + 2), (-2, -1))
                for corner in np.ndindex(*(2,) * (p - 1)):
                    line += (-1) ** (p - 1 - sum(corner)) * turned[(tree, *(np.where(side, high[:, g], low[:, g]) for side, g in zip(corner, others, strict=True)))]
                left = line - np.take_along_axis(line, low[:, None, [f]], 2)
                total = np.take_along_axis(left, high[:, None, [f]], 2)
                if not f:
                    stats = total[..., 0]
                right = total - left
                inside = (np.arange(left.shape[2]) > low[:, [f]]) & (np.arange(left.shape[2]) < high[:, [f]]) & (left[:, 0] > 0.5) & (right[:, 0] > 0.5) & (order == f).any(1)[:, None]
                gain = left[:, 1] ** 2 / np.maximum(left[:, 0], 1) + right[:, 1] ** 2 / np.maximum(right[:, 0], 1) - total[:, 1] ** 2 / np.maximum(total[:, 0], 1)
                gain = np.where(inside, gain, -np.inf)
                at = (gain >= gain.max(1, keepdims=True) - 1e-9 * least[:, None]).argmax(1)  # of equal ones the first, whatever the order of the sums
                gap = inside & (left[:, 0] == np.take_along_axis(left[:, 0], at[:, None], 1))  # ranges without a drawn row: cut in their midst
                at = at + (gap.sum(1) - 1 + ~inside.any(1)) // 2
                most = np.take_along_axis(gain, at[:, None], 1)[:, 0]
                better = most > np.maximum(best, 1e-10 * least)
                best, where = np.where(better, most, best), np.where(better[:, None], np.column_stack((np.full(m, f), at)), where)
            splits = (where[:, 0] >= 0) & (depth < self.max_depth)
            for i in np.flatnonzero(~splits):
                out[(tree[i], *map(slice, low[i], high[i]))] = stats[i, 1] / stats[i, 0]
            if not splits.any():
                break
            tree, node, low, high, (f, cut) = tree[splits], node[splits], low[splits], high[splits], where[splits].T
            mid_high, mid_low, own = high.copy(), low.copy(), np.arange(len(f))
            mid_high[own, f], mid_low[own, f] = cut, cut
            tree, node, low, high = np.concatenate((tree, tree)), np.concatenate((2 * node + 1, 2 * node + 2)), np.concatenate((low, mid_low)), np.concatenate((mid_high, high))
        return out.reshape(len(sums), -1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.means[self.cells(x)]

    def prediction(self, df_columns: list[Column]) -> Column:
        own = self

        @F.pandas_udf("double")
        def run(*series: pd.Series) -> pd.Series:
            return pd.Series(own.predict(np.column_stack([s.to_numpy(float) for s in series])))

        return run(*df_columns)


class CountedForest:
    """A random forest for classes that is grown from counts: features are cut into ranges, at most `bins` each.

    Trees split between ranges only, so rows of the same ranges and class are one with their count w, and a tree's sample with
    replacement holds it Poisson(w) times: as often as its copies together, were each drawn by itself. The draws follow the ranges
    and the class, so they do not depend on the partitions. Past the one pass that counts them a level is one aggregate, whose
    size is bounded by trees x open nodes x features x ranges x classes. A node tries the square root of the features.
    """

    def __init__(self, features: list[str], target: str, n_estimators: int = 100, max_depth: int = 5, bins: int = 32, seed: int = 42):
        self.features, self.target, self.trees, self.max_depth, self.bins, self.seed = features, target, n_estimators, max_depth, bins, seed

    def counted(self, df: DataFrame) -> DataFrame:
        """The ranges that occur, by class, and `w`, how many rows each has; written, as every level reads them."""
        x, y = [F.coalesce(number(c), F.lit(0.0)) for c in self.features], number(self.target)
        own = df.select(*(v.alias(f"x{i}") for i, v in enumerate(x)), y.alias("y")).where("y is not null")
        row = own.agg(F.sort_array(F.collect_set("y")).alias("classes"), *(cuts_of(F.col(f"x{i}")).alias(f"x{i}") for i in range(len(x)))).first()
        self.classes = np.array(row["classes"])
        p, cuts = len(x), [ranges(row[f"x{i}"] or [], self.bins) for i in range(len(x))]

        def place(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                at = [pa.array(np.searchsorted(c, batch.column(i).to_numpy()), pa.int32()) for i, c in enumerate(cuts)]
                yield pa.RecordBatch.from_arrays([*at, pa.array(np.searchsorted(self.classes, batch.column(p).to_numpy()), pa.int32())], [*(f"x{i}" for i in range(p)), "y"])

        placed = own.mapInArrow(place, ", ".join(f"x{i} int" for i in range(p)) + ", y int")
        return written(placed.groupBy(*placed.columns).agg(F.count(F.lit(1)).alias("w")), "counted-ranges")

    def fit(self, df: DataFrame) -> CountedForest:
        table, p, t = self.counted(df), len(self.features), self.trees
        rows = spread(table, 10_000)  # a small file, and all trees to walk for each row
        k, tried = len(self.classes), math.ceil(math.sqrt(p))
        self.feature, self.cut, gains = {}, {}, np.zeros((t, p))  # heap numbering: node i has children 2i + 1 and 2i + 2
        open_ = [(tree, 0) for tree in range(t)]
        for _ in range(self.max_depth):
            if not open_ or not k:
                break
            drawn = np.array([np.random.default_rng([self.seed, tree, node]).permutation(p)[:tried] for tree, node in open_])
            tables: list[tuple[dict, dict, dict]] = [({}, {}, {}) for _ in range(t)]
            for (tree, node), f in self.feature.items():
                tables[tree][0][node], tables[tree][1][node] = f, self.cut[tree, node]
            for i, (tree, node) in enumerate(open_):
                tables[tree][2][node] = i
            size = (len(open_), tried, self.bins, k)

            def count(stream, drawn=drawn, tables=tables, size=size) -> dict[str, np.ndarray]:
                out = np.zeros(math.prod(size))
                for batch in stream:
                    x, y = unpacked(batch, p)
                    w = batch.column(p + 1).to_numpy()
                    times = np.array([np.random.default_rng([self.seed, *map(int, own), int(label)]).poisson(n, t) for own, label, n in zip(x, y, w, strict=True)]).reshape(-1, t)
                    for tree, table in enumerate(tables):
                        at = walk(x, *table)
                        seen = np.flatnonzero((at >= 0) & (times[:, tree] > 0))
                        for j in range(tried):
                            np.add.at(out, np.ravel_multi_index((at[seen], np.full(len(seen), j), x[seen, drawn[at[seen], j]], y[seen]), size), times[seen, tree])
                return {"n": out}

            n = summed(rows, count, {"n": size})["n"]
            left = n.cumsum(2)[:, :, :-1]
            whole = n[:, :1].sum(2, keepdims=True)
            drop = _gini(whole) - _gini(left) - _gini(whole - left)
            drop = np.where((left.sum(-1) > 0) & ((whole - left).sum(-1) > 0), drop, 0.0).reshape(len(open_), -1)
            following = []
            for i, (tree, node) in enumerate(open_):
                most = drop[i].max(initial=0.0)
                if most <= 1e-9 * whole[i].sum():
                    continue
                j, cut = divmod(int((drop[i] >= most).argmax()), self.bins - 1)
                f = int(drawn[i, j])
                self.feature[tree, node], self.cut[tree, node] = f, cut
                gains[tree, f] += most
                following += [(tree, 2 * node + 1), (tree, 2 * node + 2)]
            open_ = following
        forget(table)
        own = gains[gains.sum(1) > 0]
        self.importances = (own / own.sum(1, keepdims=True)).mean(0) if len(own) else np.zeros(p)  # each tree's shares, and their mean
        return self


def _gini(n: np.ndarray) -> np.ndarray:
    """Count times Gini impurity."""
    total = n.sum(-1)
    return total - (n**2).sum(-1) / np.maximum(total, 1e-300)


def unpacked(batch: pa.RecordBatch, p: int) -> tuple[np.ndarray, np.ndarray]:
    return np.column_stack([batch.column(i).to_numpy() for i in range(p)]), batch.column(p).to_numpy()


def rest(x: np.ndarray, feature: dict[int, int], cut: dict[int, float]) -> np.ndarray:
    """The node in which each row comes to rest."""
    at = np.zeros(len(x), np.int64)
    groups = [(0, np.arange(len(x)))]
    while groups:
        node, own = groups.pop()
        at[own] = node
        if node in feature and len(own):
            under = x[own, feature[node]] <= cut[node]
            groups += [(2 * node + 1, own[under]), (2 * node + 2, own[~under])]
    return at


def walk(x: np.ndarray, feature: dict[int, int], cut: dict[int, float], place: dict[int, int]) -> np.ndarray:
    at = rest(x, feature, cut)
    nodes, back = np.unique(at, return_inverse=True)
    return np.array([place.get(int(n), -1) for n in nodes], np.int64)[back]


def l1_support_vectors(rows: DataFrame, features: list[str], positive: Column, c: float = 0.01, rounds: int = 50, tol: float = 1e-8) -> np.ndarray:
    """Weights (the bias last) with the least |w|_1 + c * sum max(0, 1 - y f(x))^2; the bias is penalised as a feature that is 1.

    Each round sums the products of the rows within the margin, takes the least of that penalised quadratic, and goes towards it
    as far as the whole function falls (a step and its halves are tried in one pass).
    """
    own = rows.select(*(F.coalesce(number(x), F.lit(0.0)).alias(f"x{i}") for i, x in enumerate(features)), F.when(positive, 1.0).otherwise(-1.0).alias("y"))
    p = len(features) + 1
    w, steps = np.zeros(p), 0.5 ** np.arange(12)
    best = None
    for _ in range(rounds):

        def quadratic(stream, w=w) -> dict[str, np.ndarray]:
            gram, product, loss = np.zeros((p, p)), np.zeros(p), np.zeros(1)
            for batch in stream:
                x, y = unpacked(batch, p - 1)
                x = np.column_stack((x, np.ones(len(x))))
                slack = 1 - y * (x @ w)
                near = slack > 0
                gram += x[near].T @ x[near]
                product += x[near].T @ y[near]
                loss += (slack[near] ** 2).sum()
            return {"gram": gram, "product": product, "loss": loss}

        got = summed(own, quadratic, {"gram": (p, p), "product": (p,), "loss": (1,)})
        value = np.abs(w).sum() + c * float(got["loss"][0])
        # |v| + c (v'Gv - 2 v'b): coordinates in turn
        v, gram, product = w.copy(), 2 * c * got["gram"] + 1e-12 * np.eye(p), 2 * c * got["product"]
        for _ in range(1000):
            was = v.copy()
            for j in range(p):
                rho = product[j] - gram[j] @ v + gram[j, j] * v[j]
                v[j] = np.sign(rho) * max(abs(rho) - 1, 0.0) / gram[j, j]
            if np.abs(v - was).max() <= 1e-12 * max(1.0, np.abs(v).max()):
                break
        lines = w + steps[:, None] * (v - w)

        def tried(stream, lines=lines) -> dict[str, np.ndarray]:
            loss = np.zeros(len(lines))
            for batch in stream:
                x, y = unpacked(batch, p - 1)
                far = np.column_stack((x, np.ones(len(x)))) @ lines.T
                loss += (np.maximum(1 - y[:, None] * far, 0.0) ** 2).sum(0)
            return {"loss": loss}

        values = np.abs(lines).sum(1) + c * summed(own, tried, {"loss": (len(lines),)})["loss"]
        best = int(values.argmin())
        if not values[best] < value - tol * max(1.0, abs(value)):
            return w if values[best] >= value else lines[best]
        w = lines[best]
    return w
