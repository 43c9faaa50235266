"""Fitted operators on streams: transforms of a fitted operator are stateless projections, so they run on readStream as they are."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from sievelake.operators.base import Action
from sievelake.plans.shared import fresh_dir


def read_table_stream(spark, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def apply_fitted(stream: DataFrame, actions: Sequence[Action]) -> DataFrame:
    """Only operators that were fitted on a batch: a stream has no whole to take statistics from."""
    for action in actions:
        if action.fitted_columns is None:
            raise RuntimeError(f"{action.name} is not fitted")
        stream = action.transform(stream)
    return stream


def deduplicate(stream: DataFrame, keys: list[str], time: str, lateness: str = "10 minutes") -> DataFrame:
    """The first row of each key; state is dropped once the watermark has passed."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def windowed_quality(stream: DataFrame, time: str, value: str, width: str = "1 hour", lateness: str = "10 minutes", by: Sequence[str] = ()) -> DataFrame:
    """Per window: rows, nulls, mean, deviation: tumbling windows with a watermark."""
    x = F.col(value).cast("double")
    return stream.withWatermark(time, lateness).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(x.isNull(), 1)).alias("nulls"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))


def windowed_drift(stream: DataFrame, time: str, value: str, low: float, high: float, reference: list[float], width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Chi-squared distance of each window's histogram to a reference one: counts per bin are columns, so one aggregation does."""
    bins = len(reference)
    x = F.col(value).cast("double")
    place = F.greatest(F.lit(0), F.least(F.floor((x - low) / ((high - low) or 1.0) * bins), F.lit(bins - 1)))
    counts = stream.where(x.isNotNull()).withWatermark(time, lateness).groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(place == i, 1)).alias(f"b{i}") for i in range(bins)))
    terms: list[Column] = []
    for i, r in enumerate(reference):
        p = F.col(f"b{i}") / F.col("n")
        terms.append((p - r) * (p - r) / (p + r + 1e-10))
    return counts.select(F.col("window.start").alias("start"), "n", (sum(terms[1:], terms[0]) / 2).alias("drift"))


def sessions(stream: DataFrame, time: str, user: str, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, lateness).groupBy(F.session_window(time, gap), user).agg(F.count(F.lit(1)).alias("n"))


STATE = "n long, mean double, m2 double, least double, most double, last long"


def running_profiles(stream: DataFrame, key: str, time: str, value: str, lateness: str = "10 minutes", idle: str = "1 hour") -> DataFrame:
    """key, n, mean, sd, least, most, closed: the profile of each key's values so far, a row a key and batch that has rows of it.

    State is six numbers a key. A key whose latest row lies `idle` behind the watermark gives its last profile as closed and is
    forgotten; rows later than `lateness` are dropped, and a row of a forgotten key begins anew. A null value is no value. The latest profile of a key is the one of most rows.
    """
    width = int(pd.Timedelta(idle).total_seconds() * 1000)
    kind = stream.schema[key].dataType.simpleString()
    own = stream.withWatermark(time, lateness).select(F.col(key).alias("k"), F.col(time).alias("t"), F.unix_millis(F.col(time).cast("timestamp")).alias("ms"), F.col(value).cast("double").alias("v"))

    def profile(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2, least, most, last = state.get if state.exists else (0, 0.0, 0.0, None, None, 0)
        closed = state.hasTimedOut
        if closed:
            state.remove()
        else:
            mark = max(0, state.getCurrentWatermarkMs())
            for frame in frames:
                frame = frame[frame["ms"] >= mark]
                last = max([last, *map(int, frame["ms"])])
                x = frame["v"].dropna().to_numpy()
                if len(x):  # two parts' counts, means and squares make those of both
                    more, middle = len(x), float(x.mean())
                    m2 += float(((x - middle) ** 2).sum()) + (middle - mean) ** 2 * n * more / (n + more)
                    mean += (middle - mean) * more / (n + more)
                    n += more
                    least, most = (float(f(x if y is None else [y, *x])) for f, y in ((min, least), (max, most)))
            state.update((n, mean, m2, least, most, last))
            state.setTimeoutTimestamp(max(last + width, mark + 1))
        yield pd.DataFrame({"k": [name[0]], "n": [n], "mean": [mean if n else None], "sd": [math.sqrt(m2 / (n - 1)) if n > 1 else None], "least": [least], "most": [most], "closed": [closed]}).astype({"mean": float, "sd": float, "least": float, "most": float})

    found = own.groupBy("k").applyInPandasWithState(profile, f"k {kind}, n long, mean double, sd double, least double, most double, closed boolean", STATE, "update", "EventTimeTimeout")
    return found.withColumnRenamed("k", key)


@udtf(returnType="place int, value double")
class Items:
    """A list's entries as rows, numbered from 0; a null list has none, a null entry is null."""

    def eval(self, values: list):
        for i, v in enumerate(values if values is not None else ()):
            yield i, None if v is None else float(v)


def items(df: DataFrame, column: str, name: str = "sievelake_items") -> DataFrame:
    """df's other columns with place and value for each entry of a list column, by the table function beside each row."""
    spark = df.sparkSession
    spark.udtf.register(name, Items)
    df.createOrReplaceTempView(f"{name}_rows")
    rest = ", ".join(f"r.`{c}`" for c in df.columns if c != column)
    return spark.sql(f"SELECT {rest}, i.place, i.value FROM {name}_rows r, LATERAL {name}(r.`{column}`) i")


def run_to_memory(stream: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """All that is available now, into an in-memory table of that name (for tests and small results)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """All that is available now, into a table in the shared folder: the last state of a `complete` stream, every row of another.

    Offsets and state are checkpointed beside it, so a run that is cut off goes on where it was.
    """
    spark, folder = stream.sparkSession, fresh_dir(stream.sparkSession, "stream")
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/rows")

    def put(batch: DataFrame, nth: int) -> None:
        at = f"{folder}/rows" if mode == "complete" else f"{folder}/rows/batch={nth}"
        batch.write.mode("overwrite").parquet(at)  # a batch that runs again replaces itself

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
