"""Sketches of distinct counts, quantiles and frequencies as tables of numbers, which merge by sums and maxima.

A sketch is rows (group, column, kind, slot, v): for `distinct` the register of a hash and the longest run of zeros seen there, for
`quantile` the logarithmic bucket of a value and its count, for `frequency` a cell of one of `DEPTH` hash rows and its count. They
are stored and merged as any table: up a cube, over days, on a stream. What is merged equals what is made in one go, to the bit.

Errors: a distinct count has a standard error of 1.04 / sqrt(2^PRECISION), 1.6 %; a quantile is within ALPHA, 1 %, of a value at
its rank; a frequency is at least the true one, and over it by more than e / WIDTH of all with probability exp(-DEPTH) at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the sketches: those of different ones do not merge.
PRECISION, ALPHA, WIDTH, DEPTH = 12, 0.01, 2048, 5
GAMMA = (1 + ALPHA) / (1 - ALPHA)
#: Magnitudes under this are one bucket with 0.
LEAST = 1e-9
_SIDE = 1 << 20


def _bucket(x: Column) -> Column:
    size = F.ceil(F.log(F.abs(x)) / math.log(GAMMA)).cast("long") + F.lit(_SIDE // 2)
    return F.when(F.abs(x) < LEAST, F.lit(0).cast("long")).otherwise(F.when(x < 0, -size).otherwise(size))


def bucket_value(slot: Column) -> Column:
    """The middle, in ratio, of a bucket."""
    size = 2 * F.pow(F.lit(GAMMA), F.abs(slot) - F.lit(_SIDE // 2)) / (GAMMA + 1)
    return F.when(slot == 0, F.lit(0.0)).otherwise(F.when(slot < 0, -size).otherwise(size))


def _frequency_slots(x: Column) -> Column:
    return F.array(*(F.lit(d * WIDTH).cast("long") + F.pmod(F.xxhash64(x, F.lit(d)), F.lit(WIDTH)) for d in range(DEPTH)))


def sketch(df: DataFrame, by: list[str], distinct: list[str] = (), quantile: list[str] = (), frequency: list[str] = ()) -> DataFrame:
    """by, column, kind, slot, v: one pass over the rows, pre-aggregated; nulls take no part."""
    entries = []
    for c in distinct:
        h = F.xxhash64(F.col(f"`{c}`").cast("string"))
        rest = F.shiftrightunsigned(h, PRECISION)
        zeros = F.lit(64 - PRECISION + 1) - F.length(F.when(rest > 0, F.conv(rest.cast("string"), 10, 2)).otherwise(F.lit("")))
        entries.append((c, "distinct", F.array(F.pmod(h, F.lit(1 << PRECISION))), zeros.cast("long")))
    for c in quantile:
        x = F.col(f"`{c}`").cast("double")
        entries.append((c, "quantile", F.array(_bucket(F.when(~F.isnan(x), x))), F.lit(1).cast("long")))
    for c in frequency:
        entries.append((c, "frequency", _frequency_slots(F.col(f"`{c}`").cast("string")), F.lit(1).cast("long")))

    def rows(c: str, kind: str, slots: Column, v: Column) -> Column:
        return F.transform(slots, lambda s: F.struct(F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.when(F.col(f"`{c}`").isNotNull(), s).alias("slot"), v.alias("v")))

    long = df.select(*by, F.explode(F.concat(*(rows(*e) for e in entries))).alias("e")).select(*by, "e.*").where("slot is not null")
    return merge(long, by)


def _merged() -> Column:
    return F.when(F.col("kind") == "distinct", F.max("v")).otherwise(F.sum("v")).alias("v")


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Stored sketches by fewer columns, or of several tables under one another."""
    return sketches.groupBy(*by, "column", "kind", "slot").agg(_merged())


def merge_cube(sketches: DataFrame, by: list[str], how: str = "cube") -> DataFrame:
    """Sketches of every subset of the columns (`cube`) or the leading ones (`rollup`), from the finest alone; `level` tells which."""
    subsets = [[c for i, c in enumerate(by) if not level >> (len(by) - 1 - i) & 1] for level in range(1 << len(by))] if how == "cube" else [by[:i] for i in range(len(by), -1, -1)]
    out = None
    for own in subsets:
        level = sum(1 << (len(by) - 1 - i) for i, c in enumerate(by) if c not in own)
        one = merge(sketches, own).select(*(F.col(c) if c in own else F.lit(None).cast(sketches.schema[c].dataType).alias(c) for c in by), "column", "kind", "slot", "v", F.lit(level).alias("level"))
        out = one if out is None else out.unionByName(one)
    return out


def distinct_counts(sketches: DataFrame, by: list[str]) -> DataFrame:
    """by, column, distinct: harmonic mean of the registers, by empty registers where few are filled."""
    m = 1 << PRECISION
    own = sketches.where("kind = 'distinct'").groupBy(*by, "column").agg(F.count(F.lit(1)).alias("filled"), F.sum(F.pow(F.lit(2.0), -F.col("v"))).alias("s"))
    raw = F.lit(0.7213 / (1 + 1.079 / m) * m * m) / (F.col("s") + (F.lit(m) - F.col("filled")))
    few = F.lit(float(m)) * F.log(F.lit(float(m)) / F.greatest(F.lit(m) - F.col("filled"), F.lit(1)))
    return own.select(*by, "column", F.when((raw <= 2.5 * m) & (F.col("filled") < m), few).otherwise(raw).alias("distinct"))


def quantiles(sketches: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """by, column, n, quantiles: an array in the order of the shares. A group has as many rows as buckets, a few thousand at most."""
    own = sketches.where("kind = 'quantile'").groupBy(*by, "column").agg(F.sum("v").alias("n"), F.sort_array(F.collect_list(F.struct("slot", "v"))).alias("all"))
    runs = F.transform("all", lambda e, i: F.struct(e["slot"].alias("slot"), F.aggregate(F.slice("all", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x["v"]).alias("run")))
    place = lambda share: F.get(F.filter("runs", lambda e: e["run"] > F.floor(F.lit(share) * (F.col("n") - 1))), F.lit(0))["slot"]
    at = [place(s) for s in shares]
    return own.withColumn("runs", runs).select(*by, "column", "n", F.array(*map(bucket_value, at)).alias("quantiles"))


def frequencies(sketches: DataFrame, by: list[str], column: str, values: DataFrame, value: str) -> DataFrame:
    """by, value, n for each of the values (a frame with a column of them): the least of its cells."""
    asked = values.select(F.col(value).cast("string").alias(value)).distinct().withColumn("slot", F.explode(_frequency_slots(F.col(value))))
    own = sketches.where((F.col("kind") == "frequency") & (F.col("column") == column))
    return own.join(asked, "slot").groupBy(*by, value).agg(F.when(F.count(F.lit(1)) == DEPTH, F.min("v")).otherwise(0).alias("n"))
