"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Every word n-gram of the test items is counted over the whole corpus. In each stretch of `stretch` neighbouring n-grams of
an item the rarest is a seed, so that no unbroken run of n + stretch - 1 shared words goes unseen, however common its
words; of an item of under `SHORT` words every n-gram is one, and one is enough, as edits leave few of them. Places in documents where seeds of one item gather are aligned with the item word by word; a passage is
contaminated when its alignment score reaches `threshold` of what the item would score against itself.

The items' table is the small side. Up to `most_bytes` of its text ride to the executors with the code (checked against its real
size); beyond that the items are taken in blocks of that size, each with its own passes over the corpus.

Defined results: null and empty texts and items match nothing; an item shorter than n words is compared as a whole run
of words; repeated rows are reported once per (document, item), with their best passage, and documents without an id together,
as rows of one; items without an id are left out; empty tables give no rows; extra columns are ignored by `passages`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import batches

WORD = re.compile(r"[^\W_]+")
FOUND = "doc_id long, item_id long, similarity double, matches int, start int, end int"
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items of fewer words have all their n-grams as seeds.
SHORT = 24


def words(text: str) -> list[str]:
    low = text.lower()
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


def places(text: str) -> list[tuple[int, int]]:
    """(start, end) of each word in the text as it is; lower case may be longer."""
    return [m.span() for m in WORD.finditer(text)]


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(score, first, last) of the best local alignment of two sequences of word numbers; places in the passage, inclusive."""
    n, m = len(item), len(passage)
    columns = np.arange(m + 1)
    score, begin = np.zeros(m + 1, np.int64), columns.copy()
    best, span = 0, (0, -1)
    for i in range(n):
        step = np.where(passage == item[i], MATCH, MISMATCH)
        new, own = np.zeros(m + 1, np.int64), columns.copy()
        across, down = score[:-1] + step, score[1:] + GAP
        new[1:] = np.maximum(across, down)
        own[1:] = np.where(across >= down, begin[:-1], begin[1:])
        fresh = new <= 0
        new[fresh], own[fresh] = 0, columns[fresh]
        # gaps along the passage: the best of all cells to the left, each less its distance
        lifted = new - GAP * columns
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, columns, 0))
        along = top + GAP * columns
        better = along > new
        score, begin = np.where(better, along, new), np.where(better, own[source], own)
        if (peak := int(score.max())) > best:
            at = int(score.argmax())
            best, span = peak, (int(begin[at]), at - 1)
    return best, *span


class Items:
    """Test items as word numbers, and their n-grams as sorted 64-bit keys."""

    def __init__(self, rows: list[tuple[int, str]], n: int):
        self.n = n
        self.numbers: dict[str, int] = {}
        self.ids, self.items = [], []
        for item_id, text in rows:
            own = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)]
            if own:
                self.ids.append(item_id)
                self.items.append(np.array(own, np.int64))
        self.grams = np.unique(np.concatenate([self.keys(x) for x in self.items] or [np.zeros(0, np.uint64)]))

    def keys(self, numbers: np.ndarray) -> np.ndarray:
        """Keys of the n-grams of a sequence; an n-gram with a word that no item has gets key 0."""
        n = min(self.n, len(numbers)) if len(numbers) else self.n
        own = numbers.astype(np.uint64)
        if len(own) < self.n:
            own = np.concatenate((own, np.zeros(self.n - len(own), np.uint64)))
        size = len(own) - self.n + 1
        key, known = np.zeros(size, np.uint64), np.ones(size, bool)
        for k in range(self.n):
            part = own[k : k + size]
            key = key * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(1)
            known &= (part > 0) | (k >= n)
        return np.where(known, key ^ (key >> np.uint64(29)), np.uint64(0))

    def number(self, text: str) -> np.ndarray:
        get = self.numbers.get
        return np.array([get(w, 0) for w in words(text)], np.int64)

    def places(self, numbers: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, index in grams) of a text's n-grams that are among the sorted `grams`."""
        if len(numbers) == 0 or len(grams) == 0 or np.count_nonzero(numbers) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = self.keys(numbers)
        at = np.flatnonzero(keys)
        index = np.minimum(np.searchsorted(grams, keys[at]), len(grams) - 1)
        hit = grams[index] == keys[at]
        return at[hit], index[hit]


def counted(docs: DataFrame, items: Items) -> Counter:
    """How often each of the items' n-grams stands in the corpus: at most as many rows as the items have n-grams."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(items.grams), np.int64)
        for frame in frames:
            for text in frame.column(0).to_pylist():
                if text:
                    total += np.bincount(items.places(items.number(text), items.grams)[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

    if not len(items.grams):
        return Counter()
    return Counter({r.gram: r.n for r in docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()})


def seeds(items: Items, counts: Counter, stretch: int) -> dict[int, list[tuple[int, int]]]:
    """Gram index to the (item, position) pairs of which it is a seed."""
    out: dict[int, list[tuple[int, int]]] = {}
    for k, own in enumerate(items.items):
        span = 1 if len(own) < SHORT else stretch
        grams = np.searchsorted(items.grams, items.keys(own)).tolist()
        chosen = {min(range(a, min(a + span, len(grams))), key=lambda p: (counts[grams[p]], p)) for a in range(max(1, len(grams) - span + 1))}
        for p in chosen:
            out.setdefault(grams[p], []).append((k, p))
    return out


def align(items: Items, numbers: np.ndarray, found: dict[int, list[int]], least: int, threshold: float) -> Iterator[tuple[int, float, int, int, int]]:
    """(item, similarity, matched words, first word, last word) of the best passage of each item whose seeds gather."""
    for k, starts in found.items():
        item = items.items[k]
        n, best = len(item), None
        starts = sorted(starts)
        i = 0
        while i < len(starts):  # seeds whose item would begin at nearby places are one passage
            j = i
            while j + 1 < len(starts) and starts[j + 1] - starts[j] <= max(4, n // 2):
                j += 1
            if j - i + 1 >= (1 if n < SHORT else least):
                a, b = max(0, starts[i] - n // 2), min(len(numbers), starts[j] + n + n // 2)
                passage = numbers[a:b]
                # no alignment can match more words than the two have in common
                if 2 * np.isin(item, passage).sum() >= threshold * MATCH * n:
                    score, first, last = smith_waterman(item, passage)
                    if score >= threshold * MATCH * n and (best is None or score > best[0]):
                        best = (score, a + first, a + last)
            i = j + 1
        if best:
            own = numbers[best[1] : best[2] + 1]
            yield k, best[0] / (MATCH * n), int(np.isin(own, item).sum()), best[1], best[2]


def passages(docs: DataFrame, benchmark: DataFrame, n: int = 3, stretch: int = 4, least: int = 2, threshold: float = 0.5, most_bytes: int = 16 << 20, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, matches, start, end: the best contaminated passage of each document and item, in characters."""
    spark = docs.sparkSession
    batches(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    tests = benchmark.select(F.col(item_column).cast("long").alias("item_id"), F.col(item_text_column).alias("text")).where("item_id is not null and text is not null")
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // most_bytes))
    out = None
    for block in range(blocks):
        own = tests.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else tests
        part = _passages(rows, Items([(r.item_id, r.text) for r in own.orderBy("item_id", "text").collect()], n), stretch, least, threshold)
        out = part if out is None else out.unionByName(part)
    # repeated rows of a document or an item: the best passage stands for them
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", "matches", "start", "end")).alias("b")).select("doc_id", "item_id", "b.*")


def _passages(rows: DataFrame, items: Items, stretch: int, least: int, threshold: float) -> DataFrame:
    chosen = seeds(items, counted(rows, items), stretch)
    grams = items.grams[np.array(sorted(chosen), np.int64)] if chosen else np.zeros(0, np.uint64)
    of = [chosen[g] for g in sorted(chosen)]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            out = []
            for doc, text in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                numbers = items.number(text)
                positions, index = items.places(numbers, grams)
                if not len(positions):
                    continue
                found: dict[int, list[int]] = {}
                for p, g in zip(positions.tolist(), index.tolist(), strict=True):
                    for k, q in of[g]:
                        found.setdefault(k, []).append(p - q)
                spans = None
                for k, similarity, matches, first, last in align(items, numbers, found, least, threshold):
                    spans = spans or places(text)
                    out.append((doc, items.ids[k], similarity, matches, spans[first][0], spans[last][1]))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "similarity", "matches", "start", "end"])

    return rows.mapInArrow(run, FOUND)
