"""Substring deduplication by hashing the sentences of lines.

A line is cut after each run of sentence ends (. ! ?), and every piece is a unit: its words (lower case, letters and digits)
are hashed to 128 bits, digests are grouped over all documents, and the occurrence that comes first by (document id, text
digest, offset) is kept. Neighbouring units of a text that are all later occurrences make a run; a run is removed if its units of
`least_unit` words or more have `least_words` words together, so a short sentence that two texts share by chance stays.
A whole repeated line is a run of its sentences, and so is a passage that stands inside longer lines or is broken into
lines elsewhere. Offsets are those of the original text, in characters.

Defined results: null and empty texts hold no unit; rows that repeat a document id and a text are one text, of which all rows
stay or lose the same spans; rows with one id, or none, and different texts are documents of their own, those without an id first;
a passage that repeats within its document stays once; empty tables give no rows; extra columns are ignored by `repeats` and
kept by `remove`, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import batches, written

UNIT = re.compile(r"[^.!?\n]*[.!?]*[ \t\n\r\f]*")
WORD = re.compile(r"[^\W_]+")
UNITS = "doc_id long, text_key long, nth int, start int, end int, words int, digest binary"
SPANS = "array<struct<start: int, end: int, words: int, kept_doc_id: long, kept_start: int>>"


def pieces(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of each unit with a word; units and their white space tile the text."""
    for m in UNIT.finditer(text):
        if words := WORD.findall(m.group().lower()):
            yield m.start(), m.end(), words


def units(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    batches(docs.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for frame in frames:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for doc, key, text in zip(*(frame.column(k).to_pylist() for k in range(3)), strict=True):
                for nth, (start, end, words) in enumerate(pieces(text or "")):
                    for column, x in zip(out, (doc, key, nth, start, end, len(words), xxh3_128_digest(" ".join(words).encode("utf-8", "replace"))), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "text_key", "nth", "start", "end", "words", "digest"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(F.col(text_column)).alias("text_key"), F.col(text_column).alias("text")).mapInArrow(run, UNITS)


def runs(found: list[dict], least_words: int, least_unit: int) -> list[dict]:
    """Spans to remove, from the later occurrences of one text in order."""
    out: list[dict] = []
    evidence, last = 0, None
    own: list[dict] = []
    for unit in [*found, None]:
        if own and (unit is None or unit["nth"] != last + 1):
            if evidence >= least_words:
                out.append({"start": own[0]["start"], "end": own[-1]["end"], "words": sum(u["words"] for u in own), "kept_doc_id": own[0]["kept_doc_id"], "kept_start": own[0]["kept_start"]})
            own, evidence = [], 0
        if unit is not None:
            own.append(unit)
            evidence += unit["words"] if unit["words"] >= least_unit else 0
            last = unit["nth"]
    return out


def repeats(docs: DataFrame, least_words: int = 10, least_unit: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text_key (a hash of the text), spans: what is removed of each text that loses anything, in order.

    A span's kept_doc_id and kept_start are where the first unit of it is kept.
    """
    found = written(units(docs, id_column, text_column), "units")
    place = F.struct("doc_id", "text_key", "start")
    # the keepers' side is a table with one row a digest, so a digest that fills a partition can be split on the other side
    first = written(found.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first-units")
    later = found.join(first, "digest").where(~place.eqNullSafe(F.col("first")))
    unit = F.struct("nth", "start", "end", "words", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"))
    by_text = later.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(unit)).alias("units"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            spans = [runs(x, least_words, least_unit) for x in frame.column(2).to_pylist()]
            keep = [k for k, x in enumerate(spans) if x]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("kept_doc_id", pa.int64()), ("kept_start", pa.int32())]))
            yield pa.RecordBatch.from_arrays([frame.column(0).take(pa.array(keep, pa.int64())), frame.column(1).take(pa.array(keep, pa.int64())), pa.array([spans[k] for k in keep], kind)], names=["doc_id", "text_key", "spans"])

    return by_text.mapInArrow(run, f"doc_id long, text_key long, spans {SPANS}")


def cut(text: str, spans: list[dict]) -> str:
    kept, end = [], 0
    for span in spans:
        kept.append(text[end : span["start"]])
        end = span["end"]
    out = "".join(kept) + text[end:]
    return out if out.strip() else ""


def remove(docs: DataFrame, spans: DataFrame, id_column: str = "doc_id", text_column: str = "text", spans_column: str | None = None) -> DataFrame:
    """docs without the spans that `repeats` found; a text left blank becomes empty. With `spans_column` the spans stay, as its value."""
    batches(docs.sparkSession)
    names = docs.columns
    own = spans.select(F.col("doc_id").alias("_of_id"), F.col("text_key").alias("_of_text"), F.col("spans").alias("_spans"))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])  # so that no name of theirs clashes
    ident, text = f"c{names.index(id_column)}", f"c{names.index(text_column)}"
    joined = rows.join(own, F.col(ident).cast("long").eqNullSafe(F.col("_of_id")) & (F.xxhash64(text) == F.col("_of_text")), "left").drop("_of_id", "_of_text")
    at = names.index(text_column)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = [cut(t, s) if t and s else t for t, s in zip(frame.column(at).to_pylist(), frame.column(len(names)).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*frame.columns[:at], pa.array(texts, pa.string()), *frame.columns[at + 1 :]], names=frame.schema.names)

    out = joined.mapInArrow(run, joined.schema)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], *([F.col("_spans").alias(spans_column)] if spans_column else []))
