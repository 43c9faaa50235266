"""Exact interpolated quantiles in bounded memory, of any number of expressions at once.

A sketch brackets the two values around each rank; one aggregate then counts what lies below the bracket and within it. Brackets
of few values are collected by value, others are bracketed again within themselves, which shrinks them some thousandfold a pass.
What reaches the driver is bounded by `most` values for each quantile; no task holds the distinct values of a column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.plans.shared import forget, written

#: Relative rank error of the sketch is one over this; values of a bracket that are collected.
ACCURACY, MOST = 10_000, 10_000


@dataclass
class Quantiles:
    """Shares of a column's values that are not null, for `Action.stat_exprs`; one share gives a number, a list of them a list."""

    x: Column
    shares: list[float]
    single: bool = False


@dataclass
class _Rank:
    """The value of one rank (from 0) of one expression: between low and high, `below` values under low and `inside` between."""

    name: str
    rank: int
    inside: int
    below: int = 0
    low: float = -math.inf
    high: float = math.inf
    value: float | None = None


def exact_quantiles(df: DataFrame, wanted: dict[str, Quantiles], most: int = MOST, accuracy: int = ACCURACY) -> dict[str, list[float] | float | None]:
    """By name; None for a column without a value."""
    if not wanted:
        return {}
    rows = df.select(*(q.x.cast("double").alias(f"x{i}") for i, q in enumerate(wanted.values())))
    at = {name: F.col(f"x{i}") for i, name in enumerate(wanted)}
    n = dict(zip(at, rows.agg(*(F.count(x).alias(f"n{i}") for i, x in enumerate(at.values()))).first(), strict=True))
    place = {(name, s): s * (n[name] - 1) for name, q in wanted.items() if n[name] for s in q.shares}
    ranks = {(name, k): _Rank(name, k, n[name]) for (name, _), p in place.items() for k in (math.floor(p), math.ceil(p))}
    while open_ := [r for r in ranks.values() if r.value is None]:
        if wide := [r for r in open_ if r.inside > most]:
            _bracket(rows, at, wide, accuracy)
        if narrow := [r for r in open_ if r.value is None and r.inside <= most]:
            _collect(rows, at, narrow)

    def quantile(name: str, share: float) -> float:
        p = place[name, share]
        a, b = ranks[name, math.floor(p)], ranks[name, math.ceil(p)]
        # the formula of Spark's own exact percentile, to the last digit
        return a.value if a.rank == b.rank or a.value == b.value else (b.rank - p) * a.value + (p - a.rank) * b.value

    found = {name: [quantile(name, s) for s in q.shares] if n[name] else None for name, q in wanted.items()}
    return {name: v[0] if v and wanted[name].single else v for name, v in found.items()}


def _bracket(rows: DataFrame, at: dict[str, Column], ranks: list[_Rank], accuracy: int) -> None:
    """Narrow the brackets, each by two values of a sketch of what is in it and the counts that go with them."""
    within = [F.when((at[r.name] >= F.lit(r.low)) & (at[r.name] <= F.lit(r.high)), at[r.name]) for r in ranks]
    shares = [[min(1.0, max(0.0, (r.rank - r.below) / max(1, r.inside - 1) + d)) for d in (-2 / accuracy, 2 / accuracy)] for r in ranks]
    ends = rows.agg(*(F.percentile_approx(x, s, accuracy).alias(str(i)) for i, (x, s) in enumerate(zip(within, shares, strict=True)))).first()
    counts = []
    for i, x in enumerate(within):
        low, high = map(F.lit, ends[i])
        counts += [F.count(F.when(x < low, 1)).alias(f"under{i}"), F.count(F.when(x == low, 1)).alias(f"low{i}"), F.count(F.when((x > low) & (x < high), 1)).alias(f"inside{i}"), F.count(F.when((x == high) & (high > low), 1)).alias(f"high{i}")]
    got = rows.agg(*counts).first()
    for i, r in enumerate(ranks):
        low, high = ends[i]
        # the bracket's parts in order; one of them has the rank
        parts = [("", r.low, math.nextafter(low, -math.inf), got[f"under{i}"]), ("is", low, low, got[f"low{i}"]), ("", math.nextafter(low, math.inf), math.nextafter(high, -math.inf), got[f"inside{i}"]), ("is", high, high, got[f"high{i}"])]
        parts.append(("", math.nextafter(high, math.inf), r.high, r.inside - sum(p[3] for p in parts)))
        for kind, first, last, count in parts:
            if r.rank < r.below + count:
                r.low, r.high, r.inside = first, last, count
                r.value = first if kind else None
                break
            r.below += count


def _collect(rows: DataFrame, at: dict[str, Column], ranks: list[_Rank]) -> None:
    """The values of narrow brackets with their counts."""
    within = [F.when((at[r.name] >= F.lit(r.low)) & (at[r.name] <= F.lit(r.high)), at[r.name]) for r in ranks]
    seen = rows.where(reduce(lambda a, b: a | b, (x.isNotNull() for x in within)))
    entries = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), x.alias("v")) for i, x in enumerate(within)))).alias("e")
    by: dict[int, list[tuple[float, int]]] = {}
    for c in seen.select(entries).select("e.*").where("v is not null").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).collect():
        by.setdefault(c["i"], []).append((c["v"], c["n"]))
    for i, r in enumerate(ranks):
        place = r.below
        for v, n in sorted(by.get(i, [])):
            if place <= r.rank < place + n:
                r.value = v
            place += n


def quantile_grid(df: DataFrame, x: Column, shares: list[float]) -> list[float] | None:
    """Many quantiles of one expression: its distinct values are counted, ranged and numbered, and those of the wanted ranks are taken."""
    from sievelake.operators.evaluate import running_counts

    counts = df.select(x.cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    runs = written(running_counts(counts, [], "v", "c"), "value-ranks")
    n = runs.agg(F.max("_run")).first()[0]
    if not n:
        return None
    place = [s * (n - 1) for s in shares]
    ranks = sorted({k for p in place for k in (math.floor(p), math.ceil(p))})
    hit = F.filter(F.array(*(F.lit(k).cast("long") for k in ranks)), lambda k: (k < F.col("_run")) & (k >= F.col("_run") - F.col("c")))
    value = {r["k"]: r["v"] for r in runs.select("v", F.explode(hit).alias("k")).collect()}
    forget(runs)
    return [value[a] if a == b or value[a] == value[b] else (b - p) * value[a] + (p - a) * value[b] for p in place for a, b in [(math.floor(p), math.ceil(p))]]
