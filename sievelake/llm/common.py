"""What the training-data operators share: inputs, folds, batch sizes, file access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.plans.shared import ROOT, Sieve, forget, fresh_dir, written

__all__ = ["Sieve", "batches", "crc_mod", "filesystem", "forget", "fresh_dir", "held_out", "table", "written"]

#: Rows of an Arrow batch handed to Python; with a byte bound beside it a batch of very long texts stays small.
BATCH_ROWS = "1000"
BATCH_BYTES = str(8 << 20)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; read through Spark, so any store that Spark reads will do."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by rows and bytes, as texts differ by a factor of 10,000."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)


def crc_mod(id_column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as 1, so that it is never held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % n, F.lit(1)).cast("int")


def held_out(id_column: str = "doc_id", n: int = 5) -> Column:
    return (crc_mod(id_column, n) == 0).alias("held_out")


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; works on executors for any store that pyarrow knows."""
    from pyarrow import fs

    if "://" not in uri:  # Hadoop writes file:/path, and a bare path is a local one
        uri = f"file://{uri.removeprefix('file:')}"
    return fs.FileSystem.from_uri(uri)
