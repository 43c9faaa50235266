"""Hierarchical language identification: the family first, then the language within it.

Both levels are one-versus-one linear support vector machines over hashed byte 1- to 3-grams of the lower-cased text.
They are fitted on at most `per_language` documents of each language (a documented bound, chosen by hash); every whole
text is scored where it lies, with nothing but the weights (`buckets` x pairs) sent to the executors.

Defined results: a null text, or one without a letter, is `und` with score 0; with nothing to learn from, every text is
`und`; repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import batches
from sievelake.llm.linear import OneVersusOne

#: Language families by ISO 639-1 code. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "yi", "lb", "fy"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "sl", "bs"),
    "baltic": ("lt", "lv"),
    "celtic": ("ga", "gd", "cy", "br"),
    "finnic": ("fi", "et"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "indic": ("hi", "bn", "ur", "pa", "gu", "mr", "ne", "si"),
    "semitic": ("ar", "he", "mt", "am"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
BUCKETS = 4096

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:0x80] = 0x20
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)


def gram_counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Square roots of the hashed counts of byte 1- to 3-grams, of unit length; what is no letter counts as a space."""
    b = _FOLD[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    b = b[np.concatenate(([True], (b[1:] != 0x20) | (b[:-1] != 0x20)))]  # runs of spaces are one
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(257) + b[2:]
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    mixed = np.concatenate([(g * np.uint32(2654435769) + np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) >> shift for k, g in enumerate((b, two, three))])
    counts = np.sqrt(np.bincount(mixed, minlength=buckets).astype(np.float32))
    return counts / max(float(np.linalg.norm(counts)), 1e-9)


class LanguageModel:
    def __init__(self, langs: list[str], x: np.ndarray, families: dict[str, str] = FAMILY_OF):
        names = sorted(set(langs))
        family = [families.get(n, n) for n in names]
        self.families = sorted(set(family))
        of = np.array([self.families.index(families.get(n, n)) for n in langs])
        self.top = OneVersusOne(self.families, x, of)
        self.within = []
        for f in range(len(self.families)):
            own = [n for n, g in zip(names, family, strict=True) if g == self.families[f]]
            rows = of == f
            self.within.append(OneVersusOne(own, x[rows], np.array([own.index(n) for n in np.array(langs, object)[rows]])))
        machines = [self.top, *self.within]
        self.weights = np.concatenate([m.weights for m in machines], axis=1)
        self.bias = np.concatenate([m.bias for m in machines])
        self.ends = np.cumsum([len(m.pairs) for m in machines])

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        margins = np.split(gram_counts(text) @ self.weights + self.bias, self.ends)
        f, p = self.top.predict(margins[0])
        c, q = self.within[f].predict(margins[f + 1])
        return self.within[f].classes[c], p * q


def fit(labelled: DataFrame, per_language: int = 400, most_languages: int = 200, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", seed: int = 8) -> LanguageModel | None:
    """Learn from (text, language) rows: of each language the `per_language` with the smallest hash at most.

    The `most_languages` codes with most rows are learned (of equally many rows the first in order), so that a column of junk
    codes bounds the machines, too. Counts over all rows give each language's sampling rate; the sample is drawn by hash and holds at most
    2 * per_language * languages rows of 4 * BUCKETS bytes on the driver.
    """
    batches(labelled.sparkSession)
    rows = labelled.select(F.col(id_column).alias("i"), F.col(text_column).alias("t"), F.col(lang_column).alias("l")).where("l is not null and t is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(most_languages).collect()}
    rows = rows.where(F.col("l").isin(*counts))
    if not counts:
        return None
    rate = F.element_at(F.create_map(*(F.lit(x) for l, n in counts.items() for x in (l, min(1.0, 1.5 * per_language / n)))), F.col("l"))
    drawn = F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(1_000_000)) / 1e6 < rate

    def features(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            made = [gram_counts(t).astype(np.float16).tobytes() if any(map(str.isalpha, t)) else None for t in frame.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(made, pa.binary()), frame.column(2)], names=["h", "x", "l"])

    sample = rows.where(drawn).select(F.xxhash64("i", "t", F.lit(seed)).alias("h"), "t", "l").mapInArrow(features, "h long, x binary, l string").where("x is not null")
    got = sample.orderBy("h", "l").limit(2 * per_language * len(counts)).collect()
    taken: dict[str, int] = {}
    kept = [r for r in got if taken.setdefault(r.l, 0) < per_language and not taken.update({r.l: taken[r.l] + 1})]
    if not kept:
        return None
    return LanguageModel([r.l for r in kept], np.stack([np.frombuffer(r.x, np.float16) for r in kept]).astype(np.float32))


def predict(docs: DataFrame, model: LanguageModel | None, text_column: str = "text") -> DataFrame:
    """All columns of docs, and lang_pred and score after them (a column of docs by such a name is replaced)."""
    batches(docs.sparkSession)
    rest = docs.drop("lang_pred", "score")
    at = rest.columns.index(text_column)
    names = [*rest.columns, "lang_pred", "score"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            found = [model.predict(t) if model else ("und", 0.0) for t in frame.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=names)

    from pyspark.sql import types as T

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
