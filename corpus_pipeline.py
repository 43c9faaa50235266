"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is written as
Parquet and reread as the next stage's docs. All but the last return the columns of `documents`; extra columns ride along, whatever their names,
up to packing. Null texts go with the first stage, as they have no letter; repeated rows are one after the second. Empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm import decontaminate, language_id, near_dedup, packing, substring_dedup
from sievelake.llm.common import crc_mod, table, written
from sievelake.llm.queries import tokenizer_path

#: A bar that no text of the four languages' model falls under: two families and two languages in each give a score of 0.25 at
#: least. It bites only with three or more families, or languages in a family.
LEAST_LANGUAGE_SCORE = 0.25


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter go; a missing lang is filled in. Texts in a language that was not learned, and junk of letters, stay."""
    model = language_id.fit(docs.where(crc_mod("doc_id", 5) != 0))
    found = language_id.predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def near_deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class stays, that of the smallest id; rows without an id stay."""
    return near_dedup.keep_first(docs)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of repeated sentences go from all but the first document that has them; a text of which nothing is left goes."""
    cut = substring_dedup.remove(docs, substring_dedup.repeats(docs)).where("text <> ''")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a passage of a benchmark item go. A row is told by id and text: one without an id goes too, and of an id with
    several texts only those that hold a passage."""
    told = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    found = decontaminate.passages(told, table(spark, sf_dir, "benchmark", "item_id", "text"), id_column="_row")
    return told.join(found.select(F.col("doc_id").alias("_row")).distinct(), "_row", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, lambda: packing.word_encoder(tokenizer_path()))


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", near_deduplicate),
    ("substring_dedup", deduplicate_lines),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Language ID, alignment and packing are not expressible in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None
