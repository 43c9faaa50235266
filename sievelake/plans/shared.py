"""The folder that driver and executors share, and tables written there to cut a plan's lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where workers on this machine find the package; a cluster gets it by --py-files.
ROOT = str(Path(__file__).resolve().parents[2])


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of one's own only in a local session that sets none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='sievelake-')}")
    return spark.sparkContext.getCheckpointDir()


def _forget(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended before the interpreter does
        pass


def fresh_dir(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared one, removed when the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def forget(*frames: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_written", None):
            _forget(df.sparkSession, path)


#: Rows of a task of a model that holds its rows, about.
TASK_ROWS = 50_000


def spread(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """Rows dealt over tasks by their number.

    Partitions of files go by bytes, so a small file of many rows is a task or two, however many rows a learner then holds there
    for its trees.
    """
    n = df.count()
    return df.repartition(-(-n // rows)) if n > rows else df


#: Shuffle files of an ended execution go at once, not when the driver's garbage is next collected.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, kind: str = "stage") -> DataFrame:
    """Cut the lineage with a table in the shared folder: an executor's loss then costs no recomputation."""
    spark = df.sparkSession
    path, schema = fresh_dir(spark, kind), df.schema
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")  # the plan is run this once
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(schema).parquet(path)
    out._written = path
    return out


#: Words of 64 bits of a sieve, at most.
SIEVE_WORDS = 1 << 20


class Sieve:
    """A bit for the hash of each id of a table of one column, as rows (_word, _bits).

    There are as many rows as ids, `SIEVE_WORDS` at most, so it can be broadcast however many ids there are: rows of a wide table
    that have none of them are told without being moved, and only the others go on to the exact join. Beyond some 10^7 ids it lets
    ever more rows through; it never holds one back.
    """

    def __init__(self, ids: DataFrame, words: int = SIEVE_WORDS):
        self.words = max(1, min(ids.count(), words))
        word, bit = self._place(F.col(ids.columns[0]))
        self.table = written(ids.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")), "sieve")

    def _place(self, key: Column) -> tuple[Column, Column]:
        h = F.xxhash64(key.cast("long"))
        return F.pmod(F.shiftright(h, 6), F.lit(self.words)), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))

    def _join(self, df: DataFrame, key: Column, how: str) -> DataFrame:
        word, bit = self._place(key)
        return df.join(F.broadcast(self.table), (word == self.table["_word"]) & (self.table["_bits"].bitwiseAND(bit) != 0), how)

    def through(self, df: DataFrame, key: Column) -> DataFrame:
        """Rows whose key may be one of the ids: all that are, and few others."""
        return self._join(df, key, "left_semi")

    def held_back(self, df: DataFrame, key: Column) -> DataFrame:
        """The other rows: none of them has one of the ids."""
        return self._join(df, key, "left_anti")
