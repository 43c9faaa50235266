"""Whitening of embeddings by their covariance, accumulated in double-double.

Sums of whole numbers give exact means. Each row is centred on the mean as a pair of doubles; its outer product is taken with
error-free transformations (the product of two doubles as a pair) and added to a running pair, so a task's covariance carries some
106 bits. Tasks send their high and low parts, which meet in rounds of `MERGE` to one, in the same arithmetic. Only that one matrix
reaches the driver. It is solved there by LAPACK's divide and conquer of the tridiagonal form (`numpy.linalg.eigh`), and the
components are refined in extended precision against the covariance that double-double kept.

Defined results: a vector that is null, or holds a null or non-finite entry, takes no part; a shorter vector counts as zero beyond
its end, an empty one as zeros; entries beyond 2^52 / scale count as that; rows may repeat; a component whose eigenvalue is zero to
the precision of doubles (constant or dependent dimensions, a single row) has a null `whitened` and takes no part in
`identity_error`, which is null if none is left; `explained` is null without variance; a `deviation` beyond 64 bits is kept as a
decimal of 38 digits; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import batches, written

#: Partial covariances that meet in a task of one round, and products that are summed as a block.
MERGE, BLOCK = 32, 1 << 16
SPLIT = 134217729.0  # 2^27 + 1 halves the 53 bits of a double
MOST = float(1 << 52)

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a, b) -> Pair:
    """a + b and its rounding error, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a, b) -> Pair:
    """a * b and its rounding error, exactly."""
    p = a * b
    c, d = SPLIT * a, SPLIT * b
    high_a, high_b = c - (c - a), d - (d - b)
    low_a, low_b = a - high_a, b - high_b
    return p, ((high_a * high_b - p) + high_a * low_b + low_a * high_b) + low_a * low_b


def add(x: Pair, y: Pair) -> Pair:
    s, e = two_sum(x[0], y[0])
    t, f = two_sum(x[1], y[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def folded(x: Pair) -> Pair:
    """The sum over the first axis, by halves."""
    high, low = x
    while len(high) > 1:
        if len(high) % 2:
            high, low = (np.concatenate((part, np.zeros((1, *part.shape[1:])))) for part in (high, low))
        high, low = add((high[::2], low[::2]), (high[1::2], low[1::2]))
    return high[0], low[0]


def outer(centred: Pair, pairs: Pair) -> Pair:
    """The sum over rows of products of columns, for the given pairs of columns."""
    total = (np.zeros(len(pairs[0])), np.zeros(len(pairs[0])))
    step = max(1, BLOCK // len(total[0]))
    for at in range(0, len(centred[0]), step):
        high, low = centred[0][at : at + step], centred[1][at : at + step]
        a, b, c, d = high[:, pairs[0]], high[:, pairs[1]], low[:, pairs[0]], low[:, pairs[1]]
        p, e = two_product(a, b)
        total = add(total, folded(two_sum(p, e + (a * d + b * c))))
    return total


def mean_of(sums: list[int], n: int) -> Pair:
    """Exact sums over n as pairs."""
    high = np.array([s / n for s in sums], dtype=float)
    low = [float(Fraction(s, n) - Fraction(h)) for s, h in zip(sums, high.tolist(), strict=True)]
    return high, np.array(low, dtype=float)


def centre(rows: np.ndarray, mean: Pair) -> Pair:
    """Rows less the mean, as pairs; `rows` are doubles that hold their values exactly."""
    s, e = two_sum(rows, -mean[0])
    return two_sum(s, e - mean[1])


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of one width, zero beyond a list's end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy()
    flat, lengths = column.values.to_numpy(zero_copy_only=False), np.diff(ends)
    if len(lengths) and (lengths == width).all():
        return flat[ends[0] : ends[-1]].reshape(-1, width).astype(float)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat[ends[0] : ends[-1]]
    return out


def whole(vectors: np.ndarray, scale: float, offset: int) -> np.ndarray:
    """floor(scale * entry) + offset, as longs."""
    return np.clip(np.floor(scale * vectors), -MOST, MOST).astype(np.int64) + offset


def usable(vector: str) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def covariance(rows: DataFrame, read: Callable[[pa.RecordBatch], np.ndarray], mean: Pair, n: int, kind: str) -> Pair:
    """The covariance (divisor n) of read(batch), one row of doubles a row, as a pair of square matrices."""
    width = len(mean[0])
    pairs = np.triu_indices(width)
    partial = "part long, high array<double>, low array<double>"

    def as_batch(part: int, total: Pair) -> pa.RecordBatch:
        lists = [pa.array([x], pa.list_(pa.float64())) for x in total]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *lists], ["part", "high", "low"])

    def gather(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = (np.zeros(len(pairs[0])), np.zeros(len(pairs[0])))
        for batch in stream:
            total = add(total, outer(centre(read(batch), mean), pairs))
        yield as_batch(TaskContext.get().partitionId(), total)

    def meet(table: pa.Table) -> pa.Table:
        parts = [(np.array(h), np.array(v)) for h, v in zip(table["high"].to_pylist(), table["low"].to_pylist(), strict=True)]
        total = folded(tuple(np.stack(x) for x in zip(*parts, strict=True)))
        return pa.Table.from_batches([as_batch(table["bucket"][0].as_py(), total)])

    found = written(rows.mapInArrow(gather, partial), kind)
    parts = found.agg(F.max("part")).first()[0] + 1
    while parts > 1:
        found = written(found.withColumn("bucket", F.expr(f"part div {MERGE}")).groupBy("bucket").applyInArrow(meet, partial), kind)
        parts = -(-parts // MERGE)
    row = found.first()
    out = []
    for part in (np.array(row["high"]), np.array(row["low"])):
        square = np.zeros((width, width))
        square[pairs] = part
        out.append(square + np.triu(square, 1).T)
    total = tuple(out)
    # a pair over n: the quotient of the high part, and the remainder of that division with the low part
    high = total[0] / n
    p, e = two_product(high, np.full_like(high, float(n)))
    return two_sum(high, ((total[0] - p) - e + total[1]) / n)


def components(cov: Pair, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest `count` eigenvalues, falling, and their unit eigenvectors as columns; eigenvalues that are zero to the precision of doubles as 0.

    One matrix of dimensions squared: its size does not depend on the rows.
    """
    values, vectors = np.linalg.eigh(cov[0])  # Householder tridiagonal form, then divide and conquer
    exact, x = cov[0].astype(np.longdouble) + cov[1], vectors.astype(np.longdouble)
    for _ in range(2):  # each round squares the error of what is well apart
        r = np.eye(len(x), dtype=np.longdouble) - x.T @ x
        s = x.T @ exact @ x
        own = np.diag(s) / (1 - np.diag(r))
        apart = 2 * (np.abs(s - np.diag(own)).max() + np.abs(exact).max() * np.abs(r).max())
        gap = own[None, :] - own[:, None]
        near = np.abs(gap) <= apart
        x = x + x @ np.where(near, r / 2, (s + own[None, :] * r) / np.where(near, 1, gap))
        values = own
    x /= np.sqrt((x * x).sum(0))
    order = np.argsort(-values, kind="stable")[:count]
    least = len(x) * np.finfo(float).eps * np.abs(np.diag(cov[0])).max(initial=0)
    found = np.where(values[order] > least, values[order], 0).astype(float)
    return found, x[:, order].astype(float)


@dataclass
class Whitening:
    """What a fit knows: the count, exact sums, the mean and covariance as pairs, eigenvalues and components as columns."""

    n: int
    sums: list[int]
    mean: Pair
    cov: Pair
    values: np.ndarray
    vectors: np.ndarray
    scale: float
    offset: int

    @property
    def explained(self) -> list[float | None]:
        trace = float(np.trace(self.cov[0]))
        return [float(v) / trace if trace > 0 else None for v in self.values]


def fit(rows: DataFrame, vector: str, count: int, scale: float = 1.0, offset: int = 0) -> Whitening | None:
    """None if no row is usable. Vectors become floor(scale * entry) + offset."""
    spark = rows.sparkSession
    batches(spark)
    own = rows.where(usable(vector)).select(F.col(f"`{vector}`").cast("array<double>").alias("v"))
    n, width = own.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n or not width:
        return None

    def sums(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=object)
        for batch in stream:
            x = whole(matrix(batch.column(0), width), scale, offset)
            # a batch has at most a thousand rows, yet entries may be near 2^52
            total += (x >> 26).sum(0).astype(object) * (1 << 26) + (x & ((1 << 26) - 1)).sum(0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([str(int(t)) for t in total])], ["dim", "s"])

    # a row for each dimension and task, summed before it reaches the driver
    by_dim = own.mapInArrow(sums, "dim int, s string").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    total = [int(r["s"]) for r in sorted(by_dim, key=lambda r: r["dim"])]
    mean = mean_of(total, n)
    cov = covariance(own, lambda b: whole(matrix(b.column(0), width), scale, offset).astype(float), mean, n, "whitening-covariance")
    values, vectors = components(cov, count)
    return Whitening(n, total, mean, cov, values, vectors, scale, offset)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sum over dimensions of (n * x - S)^2, exactly."""
    if n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, sums), default=0) >= 1 << 62:
        return [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    d = n * x - np.array(sums, np.int64)
    if int(np.abs(d).max(initial=0)) >= 1 << 52 or x.shape[1] > 1024:
        return [sum(v * v for v in row) for row in d.tolist()]
    a, b = d >> 26, d & ((1 << 26) - 1)
    return [(p << 52) + (q << 27) + r for p, q, r in zip(*((y.sum(1).tolist()) for y in (a * a, a * b, b * b)), strict=True)]


def transform(rows: DataFrame, model: Whitening, id_column: str, vector: str) -> DataFrame:
    """A row for each usable vector: id, deviation decimal(38,0), whitened array<double> by component."""
    n, sums, mean, width = model.n, model.sums, model.mean, len(model.sums)
    scale, offset = model.scale, model.offset
    root, vectors = np.sqrt(model.values), model.vectors
    kind = rows.schema[id_column].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            x = whole(matrix(batch.column(1), width), scale, offset)
            high, low = centre(x.astype(float), mean)
            with np.errstate(divide="ignore", invalid="ignore"):
                w = (high @ vectors + low @ vectors) / root
            lists = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel(), mask=np.tile(root == 0, len(w))), len(root)).cast(pa.list_(pa.float64()))
            far = [d if abs(d) < 10**38 else None for d in deviations(x, n, sums)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if d is None else Decimal(d) for d in far], pa.decimal128(38, 0)), lists], ["id", "deviation", "whitened"])

    own = rows.where(usable(vector)).select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return own.mapInArrow(run, f"id {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(found: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the whitened rows' covariance less the identity, over components that are not null."""
    kept = np.flatnonzero(model.values)
    if not len(kept):
        return None
    own = found.select("whitened")
    # the means of doubles are sums of a few numbers a task; their own error is far below that of the covariance
    means = own.agg(*(F.avg(F.element_at("whitened", int(i) + 1)) for i in kept)).first()
    width = len(model.values)
    cov = covariance(own, lambda b: matrix(b.column(0), width)[:, kept], (np.array(means, float), np.zeros(len(kept))), model.n, "whitening-check")
    return float(np.abs((cov[0] - np.eye(len(kept))) + cov[1]).max())


def whiten(rows: DataFrame, id_column: str, vector: str, count: int = 8, scale: float = 1.0, offset: int = 0) -> DataFrame:
    """A row for each usable vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    kind = rows.schema[id_column].dataType.simpleString()
    model = fit(rows, vector, count, scale, offset)
    if model is None:
        return rows.sparkSession.createDataFrame([], f"`{id_column}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    found = written(transform(rows, model, id_column, vector), "whitening-rows")
    error = F.lit(identity_error(found, model)).cast("double")
    explained = F.array(*(F.lit(v).cast("double") for v in model.explained))
    out = found.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(F.col("id").alias(id_column), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("at") + 1).alias("explained"), error.alias("identity_error"))
