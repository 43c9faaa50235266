"""Mutual information of numbers with a discrete target, by the distances to nearest neighbours.

For every value the distance r to the k-th neighbour of its own class is found, and the m values of any class that are nearer than
r are counted; the estimate is psi(N) + mean psi(k) - mean psi(class size) - mean psi(m), not below 0. Values are counted by class
first, then ranged by (column, value), so a partition holds a contiguous stretch of one or more columns. The k nearest on either
side may lie beyond it: the k outermost values of every class and partition, some rows each, give it these. Windows that end
within the partition are counted there; the others send their two ends to the partitions where they lie, and the counts of whole
partitions between are sums known beforehand. Nothing is approximated, and the ranges do not change the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions.stats import hash_unit, number
from sievelake.plans.shared import forget, written

#: Distinct (column, value, class) of a partition, about.
RANGE_ROWS = 1 << 18
SUMS = "feature int, n long, s_k double, s_c double, s_m double, x double, r double, w long"
HALO = "array<struct<v: double, w: long>>"


def digamma(x: np.ndarray) -> np.ndarray:
    """psi by its recurrence up to 10 and the asymptotic series from there on."""
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (low := x < 10).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y * (1 / 132 - y * 691 / 32760)))))


def reach(v: np.ndarray, w: np.ndarray, first: int, last: int, k: int) -> np.ndarray:
    """For the values first..last of a class (sorted and distinct, with counts) the distance to the k-th of all others."""
    at = np.arange(first, last)
    steps = np.concatenate((np.arange(-k, 0), np.arange(1, k + 1)))
    to = at[:, None] + steps
    there = (to >= 0) & (to < len(v))
    to = np.clip(to, 0, len(v) - 1)
    far = np.where(there, np.abs(v[to] - v[at][:, None]), np.inf)
    order = np.argsort(far, axis=1, kind="stable")
    far = np.take_along_axis(far, order, 1)
    reached = np.cumsum(np.take_along_axis(np.where(there, w[to], 0), order, 1), 1) + (w[at] - 1)[:, None]
    found = far[np.arange(len(at)), (reached >= k).argmax(1)]
    return np.where(w[at] > k, 0.0, found)


def below(values: np.ndarray, x: np.ndarray, r: np.ndarray, right: bool) -> np.ndarray:
    """How many of the sorted values lie left of the window's end: nearer to x than r, or equal to x for r = 0.

    The end is judged by differences, as x + r may be rounded to either side of a value.
    """
    same = r == 0
    if right:
        out = np.where(same, np.searchsorted(values, x, "right"), np.searchsorted(values, x + r, "left"))
        within = lambda i: values[i] - x < r
    else:
        out = np.where(same, np.searchsorted(values, x, "left"), np.searchsorted(values, x - r, "right"))
        within = lambda i: x - values[i] >= r
    if not len(values):
        return out
    while True:  # a step or two of a value each, where rounding went astray
        up = ~same & (out < len(values)) & within(np.minimum(out, len(values) - 1))
        down = ~same & (out > 0) & ~within(np.maximum(out - 1, 0))
        if not (up | down).any():
            return out
        out = np.where(up, np.searchsorted(values, values[np.minimum(out, len(values) - 1)], "right"), out)
        out = np.where(down & ~up, np.searchsorted(values, values[np.maximum(out - 1, 0)], "left"), out)


def jittered(df: DataFrame, columns: list[str], key: list[str], size: float, seed: int) -> DataFrame:
    """Columns with noise of `size` of their spread, drawn by a hash of the key, so that equal values are told apart alike on any cluster."""
    row = df.agg(*(e for i, c in enumerate(columns) for e in (F.stddev_pop(number(c)).alias(f"s{i}"), F.avg(F.abs(number(c))).alias(f"m{i}")))).first()
    scale = {c: size * max(row[f"s{i}"] or 0.0, row[f"m{i}"] or 0.0) for i, c in enumerate(columns)}
    return df.withColumns({c: number(c) + (2 * hash_unit(*key, seed=seed + i) - 1) * F.lit(scale[c]) for i, c in enumerate(columns)})


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """Rows over tasks of about `rows` each by their place in the input, which needs no sort; values that hardly repeat fill a task's
    map of counts with every one of them, and a task of a scan has as many rows as its bytes hold."""
    n = df.count()
    return df.withColumn("_i", F.monotonically_increasing_id()).repartition(-(-n // rows), "_i").drop("_i") if n > rows else df


def mutual_information(df: DataFrame, columns: list[str], target: str, neighbours: int = 3, range_rows: int = RANGE_ROWS) -> dict[str, float | None]:
    """By column; None where no class has two values. Rows where the column or the target is null take no part, nor do classes of one row."""
    k = neighbours
    entries = F.explode(F.array(*(F.struct(F.lit(i).alias("feature"), F.col(f"x{i}").alias("v")) for i in range(len(columns)))))
    known = dealt(df.where(F.col(f"`{target}`").isNotNull()).select(F.col(f"`{target}`").alias("y"), *(number(c).alias(f"x{i}") for i, c in enumerate(columns))), max(1, 4 * range_rows // len(columns)))
    rows = known.select("y", entries.alias("e")).select("y", "e.*").where("v is not null")
    counts = written(rows.groupBy("feature", "v", "y").agg(F.count(F.lit(1)).alias("w")), "value-counts")
    classes = counts.groupBy("feature", "y").agg(F.sum("w").alias("size"), F.count(F.lit(1)).alias("distinct")).where("size > 1")
    classes = written(classes.withColumn("c", F.dense_rank().over(Window.partitionBy("feature").orderBy("y"))), "classes")
    n = classes.agg(F.sum("distinct")).first()[0]
    if not n:
        return dict.fromkeys(columns)
    parts = max(1, -(-n // range_rows))
    placed = counts.join(classes.drop("distinct"), ["feature", "y"]).select("feature", "v", "c", "w", "size")
    placed = written(placed.repartitionByRange(parts, "feature", "v").withColumn("part", F.spark_partition_id()), "ranged-values")
    forget(counts)

    # first and last value and the count of every stretch of a column: a row for each, some more than there are partitions
    stretches = placed.groupBy("feature", "part").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("w").alias("w")).orderBy("feature", "lo").collect()
    los = {f: np.array([s.lo for s in stretches if s.feature == f]) for f in range(len(columns))}
    ids = {f: np.array([s.part for s in stretches if s.feature == f]) for f in range(len(columns))}
    before = {f: np.concatenate(([0], np.cumsum([s.w for s in stretches if s.feature == f])))[:-1] for f in range(len(columns))}

    own, outer = Window.partitionBy("feature", "c", "part"), Window.partitionBy("feature", "c").orderBy("part", "v")
    value = F.struct("v", "w")
    # as many partitions as ranges, whatever few bytes their rows take: what a task sorts does not grow with the input
    ranked = placed.repartition(parts, "feature", "c", "part").withColumns({"up": F.row_number().over(own.orderBy("v")), "down": F.row_number().over(own.orderBy(F.desc("v")))})
    edge = written(ranked.where((F.col("up") <= k) | (F.col("down") <= k)).select("feature", "c", "part", "v", "w", "up", "down"), "edges")
    left = edge.where(F.col("down") <= k).withColumn("left", F.collect_list(value).over(outer.rowsBetween(-k, -1))).withColumn("r", F.row_number().over(own.orderBy("v"))).where("r = 1").select("feature", "c", "part", "left")
    right = edge.where(F.col("up") <= k).withColumn("right", F.collect_list(value).over(outer.rowsBetween(1, k))).withColumn("r", F.row_number().over(own.orderBy(F.desc("v")))).where("r = 1").select("feature", "c", "part", "right")
    halo = left.join(right, ["feature", "c", "part"])

    def measure(table: pa.Table, halos: pa.Table) -> pa.Table:
        around = {(h["feature"], h["c"]): h for h in halos.to_pylist()}
        feature, v, c, w, size = (table[x].to_numpy() for x in ("feature", "v", "c", "w", "size"))
        found: dict[str, list] = {x: [] for x in ("feature", "n", "s_k", "s_c", "s_m", "x", "r", "w")}

        def note(*values) -> None:
            for x, y in zip(found.values(), values, strict=True):
                x.append(y)

        for f in np.unique(feature):
            mine = np.flatnonzero(feature == f)
            mine = mine[np.lexsort((c[mine], v[mine]))]
            vs, ws, cs = v[mine], w[mine], c[mine]
            r, ks = np.zeros(len(mine)), np.zeros(len(mine))
            for label in np.unique(cs):
                at = np.flatnonzero(cs == label)
                h = around[int(f), int(label)]
                sides = [(np.array([e["v"] for e in h[s]], float), np.array([e["w"] for e in h[s]], np.int64)) for s in ("left", "right")]
                own_k = min(k, int(size[mine[at[0]]]) - 1)
                line, weight = (np.concatenate((sides[0][i], x, sides[1][i])) for i, x in enumerate((vs[at], ws[at])))
                r[at] = reach(line, weight, len(sides[0][0]), len(sides[0][0]) + len(at), own_k)
                ks[at] = own_k
            sums = np.concatenate(([0], np.cumsum(ws)))
            inside = (vs - r > vs[0]) & (vs + r < vs[-1]) | (r == 0)  # all that is nearer than r is in this partition
            m = (sums[below(vs, vs, r, True)] - sums[below(vs, vs, r, False)])[inside]
            psi = float((digamma(m) * ws[inside]).sum()) if inside.any() else 0.0
            note(int(f), int(ws.sum()), float((digamma(ks) * ws).sum()), float((digamma(size[mine]) * ws).sum()), psi, None, None, None)
            for i in np.flatnonzero(~inside):
                note(int(f), 0, 0.0, 0.0, 0.0, float(vs[i]), float(r[i]), int(ws[i]))
        kinds = (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
        return pa.table({x: pa.array(y, t) for (x, y), t in zip(found.items(), kinds, strict=True)})

    measured = written(placed.repartition(parts, "part").groupBy("part").cogroup(halo.groupBy("part")).applyInArrow(measure, SUMS), "neighbours")
    asked = written(measured.where("x is not null").select("feature", "x", "r", "w", F.monotonically_increasing_id().alias("id")), "far-windows")

    def route(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            feature, x, r, w, ident = (batch.column(i).to_numpy() for i in range(5))
            part, base = np.zeros((2, len(x)), np.int64), np.zeros((2, len(x)), np.int64)
            for f in np.unique(feature):
                own_f = feature == f
                for side, end in enumerate((x - r, x + r)):
                    at = np.clip(np.searchsorted(los[f], end[own_f], "right") - 1, 0, None)
                    part[side, own_f], base[side, own_f] = ids[f][at], before[f][at]
            for side in (0, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), batch.column(4), pa.array(part[side], pa.int64()), pa.array(base[side]), pa.array(np.full(len(x), side), pa.int32())], ["feature", "x", "r", "w", "id", "part", "base", "side"])

    ends = asked.mapInArrow(route, "feature int, x double, r double, w long, id long, part long, base long, side int")

    def count(table: pa.Table, queries: pa.Table) -> pa.Table:
        got = np.zeros(queries.num_rows, np.int64)
        if queries.num_rows:
            feature, x, r, base, side = (queries[c].to_numpy() for c in ("feature", "x", "r", "base", "side"))
            of, v, w = (table[c].to_numpy() for c in ("feature", "v", "w"))
            for f in np.unique(feature):
                mine = np.flatnonzero(of == f)
                mine = mine[np.argsort(v[mine], kind="stable")]
                sums = np.concatenate(([0], np.cumsum(w[mine])))
                for s in (0, 1):
                    at = np.flatnonzero((feature == f) & (side == s))
                    got[at] = (2 * s - 1) * (base[at] + sums[below(v[mine], x[at], r[at], s == 1)])
        return pa.table({"feature": queries["feature"], "id": queries["id"], "w": queries["w"], "m": pa.array(got)})

    counted = placed.select("part", "feature", "v", "w").withColumn("part", F.col("part").cast("long")).repartition(parts, "part").groupBy("part").cogroup(ends.groupBy("part")).applyInArrow(count, "feature int, id long, w long, m long")
    windows = counted.groupBy("feature", "id", "w").agg(F.sum("m").alias("m"))

    def psi_of(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digamma(batch.column(3).to_numpy()) * batch.column(2).to_numpy())], ["feature", "s_m"])

    far = {x.feature: x.s for x in windows.mapInArrow(psi_of, "feature int, s_m double").groupBy("feature").agg(F.sum("s_m").alias("s")).collect()}
    out: dict[str, float | None] = dict.fromkeys(columns)
    for x in measured.groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("n", "s_k", "s_c", "s_m"))).collect():
        total = float(digamma(np.array([x.n]))[0]) + (x.s_k - x.s_c - x.s_m - far.get(x.feature, 0.0)) / x.n
        out[columns[x.feature]] = max(0.0, total)
    forget(placed, edge, measured, asked, classes)
    return out
