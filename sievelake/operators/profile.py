"""Profiles and observers: one or two aggregate passes, a row per column or one row."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from sievelake.functions.stats import aggregated, adjusted_kurtosis, adjusted_skew, correlation, number, numeric_columns, quantiles
from sievelake.operators.distance import normalised_drift


def duplicate_ratios(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: share of rows in groups of several (keep none), and share beyond each group's first."""
    groups = df.groupBy(*(columns or df.columns)).agg(F.count(F.lit(1)).alias("n"))
    total = F.nullif(F.sum("n"), F.lit(0))
    return groups.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))) / total, F.lit(0.0)).alias("members"), F.coalesce((F.sum("n") - F.count(F.lit(1))) / total, F.lit(0.0)).alias("surplus"))


def distinct_counts(df: DataFrame, columns: dict[str, Column]) -> dict[str, int]:
    """Distinct values of each column, nulls aside: values of all columns are counted as groups of one narrow table, each combined before it moves."""
    if not columns:
        return {}
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), x.cast("string").alias("v")) for i, x in enumerate(columns.values())))).alias("e")
    found = {r.i: r["count"] for r in df.select(cells).select("e.*").where("v is not null").distinct().groupBy("i").count().collect()}  # a row a column
    return {c: found.get(i, 0) for i, c in enumerate(columns)}


def profile_columns(df: DataFrame) -> DataFrame:
    """A row per column: column, missing, distinct, distinct_ratio, and for numbers iqr_rate, z_rate and abs_skew (0 below four rows)."""
    numeric = numeric_columns(df)
    exprs = {"n": F.count(F.lit(1))}
    for c in df.columns:
        x = number(c) if c in numeric else F.col(f"`{c}`")
        exprs[f"k_{c}"] = F.count(x)
        if c in numeric:
            exprs |= {f"m_{c}": F.avg(x), f"s_{c}": F.stddev_samp(x), f"q_{c}": quantiles(x, [0.25, 0.75]), f"w_{c}": adjusted_skew(x)}
    first = aggregated(df, exprs)
    # adding 0.0 makes one of the two zeros
    distinct = distinct_counts(df, {c: number(c) + F.lit(0.0) if c in numeric else F.col(f"`{c}`") for c in df.columns})
    rates = {}
    if numeric:
        out = []
        for c in numeric:
            x, q = number(c), first[f"q_{c}"]
            low, high = (q[0] - 1.5 * (q[1] - q[0]), q[1] + 1.5 * (q[1] - q[0])) if q and q[0] is not None else (0.0, 0.0)
            sd = first[f"s_{c}"]
            out.append(F.count(F.when((x < low) | (x > high), 1)).alias(f"i_{c}"))
            out.append((F.count(F.when(F.abs((x - first[f"m_{c}"]) / sd) > 3, 1)) if sd else F.lit(0)).alias(f"z_{c}"))
        rates = df.agg(*out).first().asDict()
    n, rows = first["n"], []
    for c in df.columns:
        known = first[f"k_{c}"]
        enough = c in numeric and known > 3
        rows.append(Row(column=c, missing=1 - known / n if n else 0.0, distinct=distinct[c], distinct_ratio=distinct[c] / n if n else 0.0, iqr_rate=float(rates[f"i_{c}"] / known) if enough else 0.0, z_rate=float(rates[f"z_{c}"] / known) if enough else 0.0, abs_skew=abs(first[f"w_{c}"] or 0.0) if enough else 0.0, numeric=c in numeric))
    return df.sparkSession.createDataFrame(rows, "column string, missing double, distinct long, distinct_ratio double, iqr_rate double, z_rate double, abs_skew double, numeric boolean")


@dataclass(frozen=True)
class DataQualityReport:
    n_rows: int
    n_columns: int
    missing: float
    duplicates: float
    iqr_rate: float
    z_rate: float
    skew: float
    cardinality: float
    class_imbalance: float
    columns: list[Row] = field(default_factory=list, compare=False)

    def to_state_vector(self) -> list[float]:
        return [float(self.n_rows), float(self.n_columns), self.missing, self.duplicates, self.iqr_rate, self.z_rate, self.skew, self.cardinality, self.class_imbalance]

    def relevant_action_groups(self, least: float = 0.005) -> list[str]:
        """Which kinds of operators the data call for."""
        wants = {"imputation": self.missing, "deduplication": self.duplicates, "outlier_detection": max(self.iqr_rate, self.z_rate), "scaling": self.skew}
        return [k for k, v in wants.items() if v > least]

    def summary(self) -> str:
        return f"{self.n_rows} rows, {self.n_columns} columns: missing {self.missing:.3f}, duplicates {self.duplicates:.3f}, outliers {self.iqr_rate:.3f}/{self.z_rate:.3f}, skew {self.skew:.3f}"


class DataProfiler:
    def profile(self, df: DataFrame, target: str | None = None) -> DataQualityReport:
        features = df.drop(target) if target else df
        rows = profile_columns(features).collect()  # a row a column
        numeric = [r for r in rows if r.numeric]
        mean = lambda k, own: sum(r[k] for r in own) / len(own) if own else 0.0
        imbalance = 0.0
        if target:
            n = df.groupBy(target).count().agg((1 - F.max("count") / F.sum("count")).alias("v")).first()[0]
            imbalance = n or 0.0
        return DataQualityReport(df.count(), len(features.columns), mean("missing", rows), duplicate_ratios(features).first().members, mean("iqr_rate", numeric), mean("z_rate", numeric), mean("abs_skew", numeric), mean("distinct_ratio", rows), imbalance, rows)


class BaseObserver:
    """`frame` is one row; `observe` takes it and keeps the history."""

    def __init__(self):
        self.history: list[list[float]] = []

    def frame(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def observe(self, df: DataFrame) -> list[float]:
        self.history.append([float(v or 0.0) for v in self.frame(df).first()])
        return self.history[-1]

    def reset(self) -> None:
        self.history = []


class DataStatsObserver(BaseObserver):
    """Rows, columns, nulls, numeric columns, other columns."""

    def frame(self, df):
        n, p = len(numeric_columns(df)), len(df.columns)
        nulls = F.sum(sum((F.col(f"`{c}`").isNull().cast("long") for c in df.columns), F.lit(0)))
        return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(p).alias("columns"), F.coalesce(nulls, F.lit(0)).alias("nulls"), F.lit(n).alias("numeric"), F.lit(p - n).alias("others"))


class AdvancedStatsObserver(BaseObserver):
    """Mean population skewness and excess kurtosis, mean absolute correlation of pairs, share of zeros, minority class share."""

    def __init__(self, target: str | None = None):
        super().__init__()
        self.target = target

    def frame(self, df):
        columns = [c for c in numeric_columns(df) if c != self.target]
        pairs = list(combinations(columns, 2))
        clean = lambda x: F.coalesce(F.when(~F.isnan(x), x), F.lit(0.0))
        mean = lambda xs: sum(xs[1:], xs[0]) / len(xs) if xs else F.lit(0.0)
        cells = sum((F.count(number(c)) for c in columns), F.lit(0))
        zeros = sum((F.count(F.when(number(c) == 0, 1)) for c in columns), F.lit(0))
        row = df.agg(
            mean([clean(F.skewness(number(c))) for c in columns]).alias("skew"),
            mean([clean(F.kurtosis(number(c))) for c in columns]).alias("kurtosis"),
            mean([F.abs(clean(correlation(number(a), number(b)))) for a, b in pairs]).alias("correlation"),
            F.coalesce(zeros / F.nullif(cells, F.lit(0)), F.lit(0.0)).alias("zeros"),
        )
        if self.target and self.target not in numeric_columns(df):
            minority = df.groupBy(self.target).count().agg((F.min("count") / F.sum("count")).alias("minority"))
            return row.join(minority)  # one row beside one row
        return row.withColumn("minority", F.lit(0.0))


class DataQualityObserver(BaseObserver):
    """Row and column ratios to the reference, mean and largest missing share, duplicate share, class ratio, mean absolute skewness,
    kurtosis, and capped drift. Without numeric columns the last three are 0."""

    def __init__(self, reference: DataFrame, target: str | None = None):
        super().__init__()
        self.reference, self.target = reference, target
        self.size = (reference.count(), len(reference.columns))

    def frame(self, df):
        features = [c for c in df.columns if c != self.target]
        numeric = [c for c in numeric_columns(df) if c != self.target]
        missing = [F.avg(F.col(f"`{c}`").isNull().cast("double")) for c in features]
        mean = lambda xs: sum(xs[1:], xs[0]) / len(xs) if xs else F.lit(0.0)
        row = df.agg(
            (F.count(F.lit(1)) / max(1, self.size[0])).alias("row_ratio"), F.lit(len(df.columns) / max(1, self.size[1])).alias("column_ratio"),
            mean(missing).alias("missing_mean"), (F.greatest(*missing) if len(missing) > 1 else mean(missing)).alias("missing_max"),
            mean([F.abs(F.coalesce(adjusted_skew(number(c)), F.lit(0.0))) for c in numeric]).alias("skew"),
            mean([F.coalesce(adjusted_kurtosis(number(c)), F.lit(0.0)) for c in numeric]).alias("kurtosis"),
        )
        duplicates = duplicate_ratios(df.select(*(f"`{c}`" for c in features))).first().surplus
        ratio = 1.0
        if self.target:
            got = df.groupBy(self.target).count().agg(F.min("count"), F.max("count")).first()
            ratio = got[0] / got[1] if got[1] else 0.0
        drift = normalised_drift(self.reference.select(numeric), df.select(numeric)).first()[0] if numeric and self.size[0] else 0.0
        return row.select("row_ratio", "column_ratio", "missing_mean", "missing_max", F.lit(float(duplicates)).alias("duplicates"), F.lit(float(ratio)).alias("class_ratio"), "skew", "kurtosis", F.lit(float(drift)).alias("drift"))


def summary(df: DataFrame) -> DataFrame:
    """A row per column: type, missing, distinct values (null counts as one), population skewness and kurtosis."""
    numeric = numeric_columns(df)
    exprs = []
    for c in df.columns:
        x = F.col(f"`{c}`")
        exprs.append(F.struct(F.lit(c).alias("column"), F.lit(dict(df.dtypes)[c]).alias("type"), F.count(F.when(x.isNull(), 1)).alias("missing"), (F.count_distinct(x) + F.max(x.isNull().cast("long"))).alias("distinct"), (F.skewness(number(c)) if c in numeric else F.lit(None).cast("double")).alias("skewness"), (F.kurtosis(number(c)) if c in numeric else F.lit(None).cast("double")).alias("kurtosis")))
    return df.agg(F.array(*exprs).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def quality_components(clean: DataFrame, dirty: DataFrame) -> DataFrame:
    """One row about the numbers of a cleaned frame: retention (rows of the dirty one that are left), uniqueness (rows that are no
    repetition at 6 decimals), outlier_free (cells within 3 population deviations), composite (their mean), and observer_quality
    (completeness times 1 less the mean drift of a column from the dirty frame, in deviations of the dirty one, at most 1).

    An empty frame is unique and free of outliers; a frame without numbers has them all at 1 but retention.
    """
    from sievelake.operators.distance import common, wasserstein

    columns = numeric_columns(clean)
    stats = clean.agg(F.count(F.lit(1)).alias("n"), *(e for i, c in enumerate(columns) for e in (F.avg(number(c)).alias(f"m{i}"), F.stddev_pop(number(c)).alias(f"s{i}"), F.count(number(c)).alias(f"k{i}")))).first()
    n, rows = stats["n"], dirty.count()
    far = [F.count(F.when(F.abs((number(c) - F.lit(stats[f"m{i}"])) / F.lit((stats[f"s{i}"] or 0.0) + 1e-9)) > 3, 1)) for i, c in enumerate(columns) if stats[f"k{i}"]]
    outliers = sum(clean.agg(*far).first()) if far else 0
    distinct = clean.select(*(F.round(number(c), 6).alias(c) for c in columns)).distinct().count() if columns else n
    shared = common(clean, dirty)
    drift = 0.0
    if shared:
        spread = dirty.agg(*(e for i, c in enumerate(shared) for e in (F.stddev_pop(number(c)).alias(f"s{i}"), F.count(number(c)).alias(f"k{i}")))).first()
        known = {c: i for i, c in enumerate(shared) if spread[f"k{i}"] > 1 and stats[f"k{columns.index(c)}"] > 1}
        moved = {r.feature: r.value / (spread[f"s{known[r.feature]}"] + 1e-9) for r in wasserstein(clean, dirty, list(known)).collect()} if known else {}  # a row a column
        drift = sum(moved.values()) / len(moved) if moved else 0.0
    completeness = 1 - sum(1 - stats[f"k{i}"] / n for i in range(len(columns))) / len(columns) if columns and n else 1.0
    retention, uniqueness, free = n / max(rows, 1), distinct / n if n else 1.0, 1 - outliers / (n * len(columns)) if n and columns else 1.0
    row = Row(retention=float(retention), uniqueness=float(uniqueness), outlier_free=float(free), composite=float((retention + uniqueness + free) / 3), observer_quality=float(completeness * (1 - min(drift, 1.0))))
    return clean.sparkSession.createDataFrame([row], "retention double, uniqueness double, outlier_free double, composite double, observer_quality double")
