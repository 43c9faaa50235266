"""Sources: each gives a frame with NaN as null, and can say where it came from; and sinks."""

from __future__ import annotations

import os
from abc import ABC, abstractmethod
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.functions.quantiles import Quantiles, exact_quantiles
from sievelake.functions.stats import hash_unit, nan_to_null

_READ_OPTIONS = {"sep": "sep", "encoding": "encoding", "quotechar": "quote", "escapechar": "escape", "comment": "comment"}


def csv_options(read_csv_kwargs: dict[str, Any] | None) -> dict[str, Any]:
    """Reader options by their usual names; `header=None` means there is none."""
    given = dict(read_csv_kwargs or {})
    given.pop("na_values", None)
    return {"header": given.pop("header", 0) is not None, "inferSchema": True} | {_READ_OPTIONS.get(k, k): v for k, v in given.items()}


def read_csv(spark: SparkSession, path: str, read_csv_kwargs: dict[str, Any] | None) -> DataFrame:
    """A csv whose `na_values`, one or several, are null: with several the fields are read as text, nulled, and typed after that."""
    options, na = csv_options(read_csv_kwargs), (read_csv_kwargs or {}).get("na_values")
    if na is None or isinstance(na, str) or len(set(na)) == 1:
        return spark.read.options(**options, **({"nullValue": na if isinstance(na, str) else next(iter(na))} if na else {})).csv(path)
    marks = sorted({str(x) for x in na})
    texts = spark.read.options(**(options | {"inferSchema": False})).csv(path)
    first = spark.read.options(**(options | {"inferSchema": True, "nullValue": marks[0]})).csv(path).schema
    nulled = texts.select(*(F.when(~F.col(f"`{c}`").isin(marks), F.col(f"`{c}`")).alias(c) for c in texts.columns))
    open_ = [f.name for f in first.fields if isinstance(f.dataType, T.StringType)]
    # a column that another mark made text is of the narrowest type that all its other fields have
    kinds = ("boolean", "int", "bigint", "double", "date", "timestamp")
    fits = nulled.agg(*(F.coalesce(F.bool_and(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").try_cast(k).isNotNull()), F.lit(False)).alias(f"{i}_{k}") for i, c in enumerate(open_) for k in kinds)).first() if open_ else None
    kind = {f.name: f.dataType.simpleString() for f in first.fields}
    kind |= {c: next((k for k in kinds if fits[f"{i}_{k}"]), "string") for i, c in enumerate(open_)}
    return nulled.select(*(F.col(f"`{c}`").try_cast(kind[c]).alias(c) for c in nulled.columns))


class DatasetLoader(ABC):
    def __init__(self, spark: SparkSession, target_col: str | None = None):
        self.spark, self.target_col = spark, target_col

    @abstractmethod
    def load(self) -> DataFrame: ...

    @abstractmethod
    def get_source_info(self) -> dict[str, Any]: ...


class CSVLoader(DatasetLoader):
    """Exactly one of a file path and a frame."""

    def __init__(self, spark, target_col=None, file_path: str | None = None, dataset: DataFrame | None = None, read_csv_kwargs: dict[str, Any] | None = None):
        super().__init__(spark, target_col)
        if (file_path is None) == (dataset is None):
            raise ValueError("give exactly one of file_path and dataset")
        self.file_path, self.dataset, self.kwargs = file_path, dataset, read_csv_kwargs

    def load(self):
        if self.dataset is not None:
            return nan_to_null(self.dataset)
        if "://" not in self.file_path and not os.path.exists(self.file_path):
            raise FileNotFoundError(self.file_path)
        return nan_to_null(read_csv(self.spark, self.file_path, self.kwargs))

    def get_source_info(self):
        return {"type": "csv", "path": self.file_path, "target": self.target_col}


class TableLoader(DatasetLoader):
    """csv (a separator is needed), json, parquet or orc by suffix or name; a leading index column `Unnamed: 0` goes."""

    def __init__(self, spark, path: str, target_col=None, kind: str | None = None, sep: str | None = None, encoding: str | None = None):
        super().__init__(spark, target_col)
        self.path, self.kind, self.sep, self.encoding = path, kind or path.rsplit(".", 1)[-1], sep, encoding

    def load(self):
        if self.kind == "csv":
            if self.sep is None:
                raise ValueError("a csv source needs its separator")
            df = CSVLoader(self.spark, file_path=self.path, read_csv_kwargs={"sep": self.sep} | ({"encoding": self.encoding} if self.encoding else {})).load()
        elif self.kind in ("json", "parquet", "orc"):
            df = nan_to_null(getattr(self.spark.read, self.kind)(self.path))
        else:
            raise ValueError(f"no reader for {self.kind}")
        return df.drop("Unnamed: 0", "_c0") if self.kind == "csv" else df.drop("Unnamed: 0")

    def get_source_info(self):
        return {"type": self.kind, "path": self.path, "target": self.target_col}


class LocalDatasetLoader(DatasetLoader):
    """One split of a dataset folder (parquet files, or a sub-folder per split)."""

    def __init__(self, spark, path: str, target_col=None, name: str | None = None, split: str | None = None, revision: str | None = None, load_kwargs: dict[str, Any] | None = None):
        super().__init__(spark, target_col)
        if split is None or "+" in split or split == "all":
            raise ValueError("name one split")
        self.path, self.name, self.split, self.revision, self.kwargs = path, name, split, revision, load_kwargs or {}
        if self.kwargs.get("streaming"):
            raise ValueError("a streaming dataset is not a table")

    def load(self):
        return nan_to_null(self.spark.read.parquet("/".join(x for x in (self.path, self.name, self.split) if x)))

    def get_source_info(self):
        return {"type": "dataset", "path": self.path, "name": self.name, "split": self.split, "revision": self.revision, "target": self.target_col}


class DownloadedCSVLoader(DatasetLoader):
    """A CSV of a dataset that was downloaded before (there is no network)."""

    def __init__(self, spark, dataset_id: str, download_dir: str, filename: str, target_col=None, read_csv_kwargs=None):
        super().__init__(spark, target_col)
        self.dataset_id, self.path, self.kwargs = dataset_id, f"{download_dir.rstrip('/')}/{filename}", read_csv_kwargs

    def load(self):
        return CSVLoader(self.spark, file_path=self.path, read_csv_kwargs=self.kwargs).load()

    def get_source_info(self):
        return {"type": "downloaded", "dataset": self.dataset_id, "path": self.path, "target": self.target_col}


class CachedTableLoader(DatasetLoader):
    """A named table from a parquet cache: chosen zeros become null, strings ordinal codes, the target class codes, rows at most `most` per class."""

    def __init__(self, spark, name: str, cache_dir: str, target_col: str = "__target__", zero_as_null: tuple[str, ...] = (), preprocess: bool = True, most: int | None = None, key: list[str] | None = None):
        super().__init__(spark, target_col)
        self.name, self.path, self.zeros, self.preprocess, self.most, self.key = name, f"{cache_dir.rstrip('/')}/{name}.parquet", zero_as_null, preprocess, most, key

    def load(self):
        from sievelake.operators.scale import LabelEncoder

        df = nan_to_null(self.spark.read.parquet(self.path))
        if not self.preprocess:
            return df
        df = df.withColumns({c: F.nullif(F.col(c), F.lit(0)) for c in self.zeros if c in df.columns})
        texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        df = LabelEncoder(columns=texts).transform(df) if texts else df
        if self.most:
            df = stratified_cap(df, self.target_col, self.most, self.key or df.columns)
        return df

    def get_source_info(self):
        return {"type": "cache", "name": self.name, "path": self.path, "target": self.target_col}


def stratified_cap(df: DataFrame, target: str, most: int, key: list[str], seed: int = 42) -> DataFrame:
    """About `most` rows in proportion to the classes: a rate by hash, so nothing is sorted."""
    n = df.count()
    return df if n <= most else df.where(hash_unit(*key, seed=seed) < most / n)


def load_all(loaders: dict[str, DatasetLoader]) -> dict[str, DataFrame]:
    """Those that load; failures are logged and left out."""
    import logging

    out = {}
    for name, loader in loaders.items():
        try:
            out[name] = loader.load()
        except Exception as error:  # one missing dataset does not stop the others
            logging.getLogger(__name__).warning("%s: %s", name, error)
    return out


def concat_tables(frames: list[DataFrame], drop: tuple[str, ...] = (), numbers: tuple[str, ...] = ()) -> DataFrame:
    """Tables stacked by column name, leak columns dropped, the named columns as numbers where they are."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.drop(*drop).withColumns({c: F.col(c).try_cast("double") for c in numbers})


def list_to_columns(df: DataFrame, column: str, share: float = 0.9) -> DataFrame:
    """<column>_item1 ... _itemk, k the given quantile of list lengths."""
    k = int(exact_quantiles(df, {"k": Quantiles(F.when(F.col(column).isNotNull(), F.size(column)), [share], True)})["k"] or 0)
    return df.select("*", *(F.get(column, F.lit(i)).alias(f"{column}_item{i + 1}") for i in range(k))).drop(column)


def date_features(df: DataFrame, column: str) -> DataFrame:
    """Seconds since 2017-01-01, year, month, day, weekday (Monday is 0) and hour with its fraction."""
    t = F.to_timestamp(F.col(column)) if dict(df.dtypes)[column] != "string" else F.try_to_timestamp(F.col(column))
    made = {"TIMESTAMP": (F.unix_timestamp(t) - 1483228800).cast("double"), "YEAR": F.year(t), "MONTH": F.month(t), "DAY": F.dayofmonth(t), "DAYOFWEEK": F.weekday(t), "HOUR": F.hour(t) + F.minute(t) / 60.0 + F.second(t) / 3600.0}
    return df.withColumns({f"{column}_{k}": v for k, v in made.items()}).drop(column)


def convert_columns(df: DataFrame) -> DataFrame:
    """String columns that are all numbers become double; those that are all times become date features."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    row = df.agg(*(e for c in texts for e in (F.count(c).alias(f"n_{c}"), F.count(F.col(c).try_cast("double")).alias(f"d_{c}"), F.count(F.try_to_timestamp(c)).alias(f"t_{c}")))).first()
    for c in texts:
        if row[f"n_{c}"] and row[f"d_{c}"] == row[f"n_{c}"]:
            df = df.withColumn(c, F.col(c).cast("double"))
        elif row[f"n_{c}"] and row[f"t_{c}"] == row[f"n_{c}"]:
            df = date_features(df, c)
    return df


def infer_task(df: DataFrame, target: str | None) -> str:
    """Classification for two classes or text, regression for other numbers, clustering without a target."""
    if target is None or target not in df.columns:
        return "clustering"
    if isinstance(df.schema[target].dataType, T.StringType):
        return "classification"
    return "classification" if df.select(target).where(F.col(target).isNotNull()).distinct().limit(3).count() <= 2 else "regression"


def train_test(df: DataFrame, other: DataFrame | None = None, key: list[str] | None = None, target: str | None = None, test: float = 0.33, seed: int = 42) -> dict[str, Any]:
    """One frame: split by hash of the key. Two: their common columns in sorted order; the one without the target is the test part."""
    task = infer_task(df, target)
    if other is None:
        side = hash_unit(*(key or df.columns), seed=seed) < test
        return {"train": df.where(~side), "test": df.where(side), "target": target, "task": task}
    if target and target in other.columns and target not in df.columns:
        df, other = other, df
        task = infer_task(df, target)
    shared = sorted(set(df.columns) & set(other.columns) - {target})
    return {"train": df.select(*shared, *([target] if target and target in df.columns else [])), "test": other.select(*shared), "target": target, "task": task}


def write_table(df: DataFrame, folder: str, name: str, tag: str = "", kind: str = "parquet", mode: str = "overwrite") -> str:
    path = f"{folder.rstrip('/')}/{name}{'_' + tag if tag else ''}.{kind}"
    getattr(df.write.mode(mode).options(**({"header": True} if kind == "csv" else {})), kind)(path)
    return path


