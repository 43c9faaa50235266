"""Controlled errors. Cells and rows are picked by hashes of their key, so a run repeats on any cluster."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions.quantiles import Quantiles, exact_quantiles
from sievelake.functions.stats import correlation, hash_unit, number, numeric_columns
from sievelake.plans.shared import written


@dataclass(frozen=True)
class ErrorProfile:
    error_type: str  # none, mcar, mar, outliers, duplicates, label_noise
    rate: float = 0.1
    k: float = 3.0
    seed: int = 42


def _picked(key: list[str], what: str, rate: float, seed: int) -> Column:
    return hash_unit(*key, F.lit(what), seed=seed) < rate


def _own(df, key, columns):
    return list(columns) if columns else [c for c in numeric_columns(df) if c not in key]


def inject_mcar(df: DataFrame, rate: float, key: list[str], columns: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Each numeric cell becomes null with the given probability."""
    return df.withColumns({c: F.when(~_picked(key, c, rate, seed), F.col(c)) for c in _own(df, key, columns)})


def numbered(df: DataFrame, key: list[str], name: str = "_row") -> DataFrame:
    """Rows with their places, from 0, in the order of the key: places within ranges of keys, and the ranges' sizes before them."""
    ranged = written(df.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_m", 33)
    sizes = ranged.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    before = sizes.select("_p", "_first", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row a partition
    return ranged.withColumn("_p", part).join(before, "_p").withColumn(name, F.col("_m") - F.col("_first") + F.col("_before")).drop("_m", "_p", "_first", "_before")


def inject_mcar_cells(df: DataFrame, rate: float, key: list[str], columns: list[str] | None = None, seed: int = 42) -> DataFrame:
    """max(1, round(rows * columns * rate)) cells, drawn with replacement, become null.

    Draw i hits the cell that a hash of i names, so every cell is as likely as any other and a run repeats; a cell that is drawn
    twice is null once. Keys are unique.
    """
    own = _own(df, key, columns)
    rows = numbered(df, key)
    n = rows.count()
    if not n or not own or rate <= 0:
        return df
    draws = max(1, round(n * len(own) * rate))
    cell = F.floor(hash_unit("id", seed=seed) * (n * len(own)))
    hits = df.sparkSession.range(draws).select(cell.alias("c")).groupBy(F.expr(f"c div {len(own)}").alias("_row")).agg(F.collect_set((F.col("c") % len(own)).cast("int")).alias("_hit"))  # a row has as many cells as columns
    out = rows.join(hits, "_row", "left")
    return out.withColumns({c: F.when(~F.coalesce(F.array_contains("_hit", i), F.lit(False)), F.col(c)) for i, c in enumerate(own)}).select(df.columns)


def inject_mar(df: DataFrame, rate: float, key: list[str], anchor: str | None = None, columns: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Nulls in the column that correlates most with the anchor, where the anchor lies over its third quartile.

    Without an anchor the most correlated pair is taken; below two numeric columns it is MCAR.
    """
    own = _own(df, key, columns)
    if len(own) < 2:
        return inject_mcar(df, rate, key, own, seed)
    pairs = [(anchor, c) for c in own if c != anchor] if anchor else list(combinations(own, 2))
    row = df.agg(*(F.abs(correlation(number(a), number(b))).alias(str(i)) for i, (a, b) in enumerate(pairs))).first()
    a, b = pairs[max(range(len(pairs)), key=lambda i: row[str(i)] or 0.0)]
    limit = exact_quantiles(df, {"q": Quantiles(number(a), [0.75], True)})["q"]
    # a quarter of the rows qualifies, so the rate among them is four times the rate among all
    hit = (number(a) > F.lit(limit)) & _picked(key, b, min(1.0, rate * 4), seed)
    return df.withColumn(b, F.when(F.coalesce(~hit, F.lit(True)), F.col(b)))


def inject_outliers(df: DataFrame, rate: float, key: list[str], k: float = 3.0, columns: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Cells become mean -+ k deviations plus noise of a tenth of a deviation; constant columns stay."""
    own = _own(df, key, columns)
    row = df.agg(*(e for c in own for e in (F.avg(number(c)).alias(f"m_{c}"), F.stddev_samp(number(c)).alias(f"s_{c}")))).first()
    out = {}
    for c in own:
        mean, sd = row[f"m_{c}"], row[f"s_{c}"]
        if not sd:
            continue
        sign = F.when(hash_unit(*key, F.lit(c), seed=seed + 1) < 0.5, F.lit(-1.0)).otherwise(1.0)
        u, v = hash_unit(*key, F.lit(c), seed=seed + 2), hash_unit(*key, F.lit(c), seed=seed + 3)
        noise = F.sqrt(-2 * F.log(1 - u)) * F.cos(v * 6.283185307179586)
        out[c] = F.when(_picked(key, c, rate, seed), F.lit(mean) + sign * k * sd + noise * (sd / 10)).otherwise(number(c))
    return df.withColumns(out)


def inject_duplicates(df: DataFrame, rate: float, key: list[str], seed: int = 42) -> DataFrame:
    """Picked rows stand a second time."""
    return df.unionByName(df.where(_picked(key, "row", rate, seed)))


def inject_label_noise(df: DataFrame, rate: float, key: list[str], target: str, seed: int = 42) -> DataFrame:
    """Labels flip to another class, each other class alike; the classes are few, so they become literals."""
    classes = sorted(r[0] for r in df.select(target).where(F.col(target).isNotNull()).distinct().collect())
    if len(classes) < 2:
        return df
    every = F.array(*map(F.lit, classes))
    others = F.array_remove(every, F.col(target))
    place = F.floor(hash_unit(*key, F.lit("class"), seed=seed + 1) * (len(classes) - 1)).cast("int")
    return df.withColumn(target, F.when(_picked(key, "label", rate, seed) & F.col(target).isNotNull(), F.get(others, place)).otherwise(F.col(target)))


def inject_cluster_missing(df: DataFrame, rate: float, key: list[str], columns: list[str] | None = None, clusters: int = 4, seed: int = 42) -> DataFrame:
    """MCAR within the smaller half of k-means clusters only."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    own = _own(df, key, columns)
    filled = df.withColumns({f"_x_{c}": F.coalesce(number(c), F.lit(0.0)) for c in own})
    rows = VectorAssembler(inputCols=[f"_x_{c}" for c in own], outputCol="_x").transform(filled)
    model = KMeans(k=clusters, seed=seed, featuresCol="_x", predictionCol="_cluster").fit(rows)
    small = [i for i, _ in sorted(enumerate(model.summary.clusterSizes), key=lambda x: x[1])[: max(1, clusters // 2)]]
    named = model.transform(rows)
    return named.withColumns({c: F.when(~(F.col("_cluster").isin(small) & _picked(key, c, rate, seed)), F.col(c)) for c in own}).select(df.columns)


def apply_error_profile(df: DataFrame, profile: ErrorProfile, key: list[str], target: str | None = None) -> DataFrame:
    p = profile
    columns = [c for c in numeric_columns(df) if c not in (*key, target)]
    made = {
        "none": lambda: df,
        "mcar": lambda: inject_mcar(df, p.rate, key, columns, p.seed),
        "mar": lambda: inject_mar(df, p.rate, key, None, columns, p.seed),
        "outliers": lambda: inject_outliers(df, p.rate, key, p.k, columns, p.seed),
        "duplicates": lambda: inject_duplicates(df, p.rate, key, p.seed),
        "label_noise": lambda: inject_label_noise(df, p.rate, key, target, p.seed),
    }
    if p.error_type not in made:
        raise ValueError(f"unknown error type {p.error_type}")
    return made[p.error_type]()


def generate_all_profiles(seed: int = 42) -> list[ErrorProfile]:
    """None, and each kind over its grid of rates and strengths: fourteen profiles."""
    rates = (0.05, 0.1, 0.2)
    return [ErrorProfile("none", 0.0, seed=seed), *(ErrorProfile(t, r, seed=seed) for t in ("mcar", "mar", "duplicates") for r in rates), *(ErrorProfile("outliers", r, k, seed) for r, k in ((0.05, 3.0), (0.05, 5.0), (0.1, 3.0), (0.1, 5.0)))]
