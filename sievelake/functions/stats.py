"""Aggregate expressions for fitting and measuring: each is one term of a single distributed pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.functions.quantiles import Quantiles, exact_quantiles


def is_numeric(field: T.StructField, bool_is_numeric: bool = True) -> bool:
    return isinstance(field.dataType, T.NumericType) or (bool_is_numeric and isinstance(field.dataType, T.BooleanType))


def numeric_columns(df: DataFrame, bool_is_numeric: bool = False) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f, bool_is_numeric)]


def number(name: str) -> Column:
    """A column as double, NaN as null; booleans count as 0 and 1."""
    x = F.col(f"`{name}`")
    x = x.cast("double")
    return F.when(~F.isnan(x), x)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN would poison means and win every maximum; sources call this once."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*(F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns))


def quantiles(x: Column, shares: list[float], accuracy: int | None = None) -> Column | Quantiles:
    """Interpolated exact quantiles, or one sketch if an accuracy is given (values that are there, one pass)."""
    return F.percentile_approx(x, shares, accuracy) if accuracy else Quantiles(x, shares)


def aggregated(df: DataFrame, exprs: dict[str, Column | Quantiles]) -> dict:
    """Values by name: one pass for aggregates, a few for exact quantiles."""
    plain = {k: e for k, e in exprs.items() if not isinstance(e, Quantiles)}
    out = df.agg(*(e.alias(k) for k, e in plain.items())).first().asDict() if plain else {}
    return out | exact_quantiles(df, {k: e for k, e in exprs.items() if isinstance(e, Quantiles)})


def adjusted_skew(x: Column) -> Column:
    """Bias-corrected skewness: null below 3 values, 0 for a constant column."""
    n = F.count(x).cast("double")
    g = F.coalesce(F.skewness(x), F.lit(0.0))
    return F.when(n > 2, F.when(F.var_pop(x) == 0, F.lit(0.0)).otherwise(g * F.sqrt(n * (n - 1)) / (n - 2)))


def adjusted_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis: null below 4 values, 0 for a constant column."""
    n = F.count(x).cast("double")
    g = F.coalesce(F.kurtosis(x), F.lit(0.0))
    return F.when(n > 3, F.when(F.var_pop(x) == 0, F.lit(0.0)).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6)))


def correlation(a: str | Column, b: str | Column) -> Column:
    """Pearson's r over rows that have both; null for a constant side, where the built-in one would raise."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def mode(name: str) -> Column:
    """The most frequent value; of several the smallest."""
    return F.mode(F.col(f"`{name}`"), True)


def hash_unit(*parts: str | Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the parts and the seed only, so it is the same on every run and cluster.

    The first 48 bits of an MD5 of the parts as text, which any engine can work out again.
    """
    text = F.concat_ws("|", *(F.coalesce((F.col(x) if isinstance(x, str) else x).cast("string"), F.lit("")) for x in parts), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)
