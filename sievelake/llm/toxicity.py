"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a fixed lexicon and of words and word stems learned from labelled documents, how
near they stand to the second person, capitals, punctuation, and obfuscation. Three disjoint folds of labelled
documents, each of at most `most` rows (a documented bound, drawn by hash), teach the lexicon, the trees and the calibration.

Defined results: null and empty texts have all-zero features and are scored like any other; without labels of both kinds the score
is the share of toxic labels (0 without labels); repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm.boosting import BoostedTrees, Isotonic
from sievelake.llm.common import batches, crc_mod
from sievelake.llm.labelled import labelled, sample

#: Common insults.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb dumbass fool loser losers scum trash garbage pathetic worthless disgusting clown jerk creep freak "
    "ugly liar coward imbecile cretin bastard bitch asshole ass crap damn hell shit fuck fucking shut hate kill die vermin filth filthy parasite "
    "connard connasse salope merde putain imbécile crétin abruti débile arschloch scheiße idiotin dummkopf trottel depp mistkerl idiota imbécil "
    "estúpido estúpida tonto puta puto mierda cabrón gilipollas".split()
)
#: Second-person words.
SECOND_PERSON = frozenset("you your yours yourself yourselves ur tu toi te ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer tú ti tus usted ustedes vosotros".split())
#: Signs that stand for letters.
SIGNS = str.maketrans("013457@$!|+", "oieastasiit")

WORD = re.compile(r"[^\W\d_]+")
OBFUSCATED = re.compile(r"(?<!\S)[^\W\d_]+[\d@$!*._|+-]+[^\W\d_][\w@$!*.|+-]*")
REPEATED_SIGNS = re.compile(r"([!?.*#$%&])\1+")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
STEMS = (7, 6, 5, 4)
NAMES = ("insults", "learned", "stems", "weight", "hits", "second", "near", "capitals", "shouted", "exclaimed", "asked", "signs", "sign_runs", "obfuscated", "obfuscated_hits", "stretched", "length", "burst")


class Lexicon:
    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems, self.openings = words, stems, {h[:4] for h in stems}

    def features(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * len(NAMES)
        words = WORD.findall(text.lower())
        n, size = max(1, len(words)), len(text)
        insults = learned = stems = 0
        weight, at = 0.0, []
        known, heads, openings = self.words, self.stems, self.openings
        for i, w in enumerate(words):
            hit = False
            if w in INSULTS:
                insults += 1
                hit = True
            if (v := known.get(w)) is not None:
                learned += 1
                weight += v
                hit = True
            elif (v := next((heads[h] for k in STEMS if (h := w[:k]) in heads), None) if len(w) > 4 and w[:4] in openings else None) is not None:
                stems += 1
                weight += v
                hit = True
            if hit:
                at.append(i)
        second = [i for i, w in enumerate(words) if w in SECOND_PERSON] if at else []
        near = 0
        if second:
            s = np.array(second)
            where = np.searchsorted(s, at)
            gap = np.minimum(np.abs(s[np.minimum(where, len(s) - 1)] - at), np.abs(s[np.maximum(where - 1, 0)] - at))
            near = int((gap <= 4).sum())
        burst = max((j + 1 - i for i, j in _windows(at)), default=0)
        letters = max(1, sum(map(len, words)))
        hidden = OBFUSCATED.findall(text)
        bare = [re.sub(r"[\W\d_]", "", h.lower().translate(SIGNS)) for h in hidden]
        signs = len(re.findall(r"[^\w\s]", text))
        return [
            insults / n, learned / n, stems / n, weight / n, math.log1p(len(at)),
            sum(w in SECOND_PERSON for w in words) / n, near / n,
            (len(text) - len(re.sub(r"[A-ZÀ-ÖØ-Þ]", "", text))) / letters, sum(len(w) > 1 for w in re.findall(r"\b[A-ZÀ-ÖØ-Þ]+\b", text)) / n,
            text.count("!") / size, text.count("?") / size, signs / size, len(REPEATED_SIGNS.findall(text)) / size,
            len(hidden) / n, sum(b in INSULTS or b in known for b in bare) / n, len(STRETCHED.findall(text)) / n, math.log1p(n), burst,
        ]


def _windows(at: list[int], width: int = 50) -> Iterator[tuple[int, int]]:
    """(first, last) places in `at` that lie within `width` words of each other, for each last."""
    i = 0
    for j, x in enumerate(at):
        while x - at[i] >= width:
            i += 1
        yield i, j


def learn_lexicon(docs: DataFrame, most_terms: int = 20000) -> Lexicon:
    """Words and stems that fill far more of toxic documents and stand in more of them; from (id, text, label) rows, a bounded sample.

    A stem counts the longer words that begin with it, so inflected and run-on insults are met too.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rates, seen = (Counter(), Counter()), (Counter(), Counter())
        for frame in frames:
            for text, label in zip(frame.column(1).to_pylist(), frame.column(2).to_pylist(), strict=True):
                words = WORD.findall((text or "").lower())
                own: Counter = Counter()
                for w, c in Counter(words).items():
                    if len(w) > 2:
                        own[w] += c
                        for k in STEMS:
                            if len(w) > k:
                                own[w[:k] + "*"] += c
                n = max(20, len(words))
                for term, c in own.items():
                    rates[label][term] += c / n
                seen[label].update(own.keys())
        terms = list(seen[0].keys() | seen[1].keys())
        columns = [pa.array(terms, pa.string())] + [pa.array([c[t] for t in terms], pa.float64()) for c in (*rates, *seen)]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "clean_rate", "toxic_rate", "clean", "toxic"])

    counts = docs.mapInArrow(run, "term string, clean_rate double, toxic_rate double, clean double, toxic double").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("clean_rate", "toxic_rate", "clean", "toxic")))
    n = {r[0]: r[1] for r in docs.groupBy("_label").count().collect()}
    clean, toxic = max(1, n.get(0, 0)), max(1, n.get(1, 0))
    odds = F.log(F.col("toxic_rate") / toxic + 1e-5) - F.log(F.col("clean_rate") / clean + 1e-5)
    sure = (F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))) / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    found = counts.where("toxic >= 3").select("term", F.round(odds, 6).alias("odds"), F.round(sure, 6).alias("sure")).where("odds >= 2 and sure >= 3").orderBy(F.desc("sure"), "term").limit(most_terms).collect()
    return Lexicon({r.term: r.odds for r in found if not r.term.endswith("*")}, {r.term[:-1]: r.odds for r in found if r.term.endswith("*")})


class Model:
    def __init__(self, lexicon: Lexicon, trees: BoostedTrees | None, calibration: Isotonic | None, share: float):
        self.lexicon, self.trees, self.calibration, self.share = lexicon, trees, calibration, share

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        if not texts:
            return np.zeros(0)
        return self.calibration(self.trees.margin(np.array([self.lexicon.features(t) for t in texts])))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 12000, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Of the ids whose crc32 modulo 5 is not 0: remainders 1 and 2 teach the lexicon, 3 the trees, 4 the calibration."""
    batches(docs.sparkSession)
    fold = crc_mod(id_column, 5)
    lexicon = learn_lexicon(labelled(docs, sample(labels, label, fold.isin(1, 2), most, id_column), id_column, text_column))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            made = [np.array(lexicon.features(t)).tobytes() for t in frame.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(2), pa.array(made, pa.binary())], names=["i", "y", "x"])

    def rows(remainder: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
        got = labelled(docs, sample(labels, label, fold == remainder, bound, id_column), id_column, text_column).mapInArrow(run, "i long, y int, x binary").orderBy("i", "y", "x").collect()
        return np.array([np.frombuffer(r.x) for r in got]).reshape(len(got), len(NAMES)), np.array([r.y for r in got], float)

    (x, y), (cx, cy) = rows(3, most), rows(4, most)
    every = np.concatenate((y, cy))
    share = float(every.mean()) if len(every) else 0.0
    if not len(y) or y.min() == y.max() or not len(cy):
        return Model(lexicon, None, None, share)
    trees = BoostedTrees(x, y)
    return Model(lexicon, trees, Isotonic(trees.margin(cx), cy), share)


def score(docs: DataFrame, model: Model, *keep: str | Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The kept columns (the id by default) and score of every row."""
    batches(docs.sparkSession)
    rows = docs.select(*(keep or (id_column,)), F.col(text_column).cast("string").alias("_text"))
    names = [*rows.columns[:-1], "score"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            yield pa.RecordBatch.from_arrays([*frame.columns[:-1], pa.array(model.scores(frame.column(len(names) - 1).to_pylist()), pa.float64())], names=names)

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", score double")
