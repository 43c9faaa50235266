"""Labelled rows to learn from: a bounded sample, drawn by hash, joined with the documents it speaks of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(labels: DataFrame, label: str, where: Column, most: int, id_column: str = "doc_id", seed: int = 1) -> DataFrame:
    """(id, label 0 or 1) of at most `most` labelled ids, those of smallest hash; contradicting labels of an id count as 1."""
    own = labels.where(where & F.col(label).isNotNull() & F.col(id_column).isNotNull())
    n = own.count()
    drawn = own.where(F.pmod(F.xxhash64(id_column, F.lit(seed)), F.lit(1 << 30)) <= int(min(1.0, 1.2 * most / max(1, n)) * (1 << 30)))
    one = drawn.groupBy(F.col(id_column).cast("long").alias("_id")).agg((F.max(label) > 0).cast("int").alias("_label"))
    return one.orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(most)


def labelled(docs: DataFrame, sampled: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text, label) of the sampled documents; the sample is bounded, so it is sent to the documents."""
    return docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text_column).cast("string").alias("_text")).join(F.broadcast(sampled), "_id").select("_id", "_text", "_label")
