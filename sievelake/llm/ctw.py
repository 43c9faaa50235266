"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions. For each of them every context of 0 to `depth` preceding bytes keeps a
Krichevsky-Trofimov estimate, and a node weighs its own estimate against its children's product by one half each. KT block
probabilities depend on counts alone, so the weighted tree is computed from corpus counts: bottom up the block
probabilities, top down the mixture of all depths' estimates for each (context, byte).

What is gathered is a count of each (context, byte) per chunk of documents, so it follows the corpus; nothing of it is
pruned, sampled or broadcast. A chunk deals its contexts to `FAN` parts by their two latest bytes. While there are more
than `FAN` groups of chunks, the counts of `FAN` of them are merged part by part, and each part is dealt to `FAN` finer
ones: groups become fewer as parts become more, so the rows of a chunk, and what a task merges, stay as they are however
large the corpus is. Only the nodes of depth 1 and 0, at most 256 * 255 rows, are finished on the driver. Probabilities
travel back the same way, each group answering those it was merged from, to the chunks that score their documents.

The text that is scored is the sequence of its lower-cased words, each with a space after it, and an end mark; contexts
before a text's start hold the end mark. Words are told apart by 64-bit hashes. A context that training never met adds no estimate, so its parents' mixture
stands.

Defined results: null and empty texts are the end mark alone; repeated rows are scored (and learned) each; without
training documents every bit has probability 1/2; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import batches, written

LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
END = 0xFF  # no byte of UTF-8
#: Parts that a chunk, or a part of merged chunks, is dealt to; groups whose counts meet in a task.
FAN = 32
#: Bytes that are worked on at once.
STEP = 1 << 20
_LETTER = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)
_LETTER[[0x20, END]] = 0
_FACTOR = 0x9E3779B97F4A7C15
_TABLE = 1024
_HALVES = np.array([math.lgamma(n + 0.5) for n in range(_TABLE)])
_WHOLES = np.array([math.lgamma(n + 1.0) for n in range(_TABLE)])


def log_gamma(n: np.ndarray, plus: float, table: np.ndarray) -> np.ndarray:
    """log Gamma(n + plus) of whole numbers: the table of the small ones, then Stirling's series."""
    x = np.maximum(n, _TABLE) + plus
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < _TABLE, table[np.minimum(n, _TABLE - 1)], series)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the KT probability of n0 zeros and n1 ones in any order."""
    return log_gamma(n0, 0.5, _HALVES) + log_gamma(n1, 0.5, _HALVES) - math.log(math.pi) - log_gamma(n0 + n1, 1.0, _WHOLES)


class Batch:
    """The bytes that are scored of some texts, one text after another: words with a space after each, and an end mark."""

    def __init__(self, texts: list[str | None], depth: int):
        raw = [bytes([END]) * depth + (t or "").encode("utf-8", "replace") + bytes([0x20, END]) for t in texts]
        whole = LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        space = SPACE[whole]
        keep = ~space
        keep[1:] |= keep[:-1] & (whole[:-1] != END)  # of white space, what stands right after a word
        starts = np.concatenate(([0], np.cumsum([len(x) for x in raw])[:-1])).astype(np.int64)
        self.depth = depth
        self.sizes = np.add.reduceat(keep, starts, dtype=np.int64) - depth
        whole[space] = 0x20
        self.padded = whole[keep]  # with the end marks before each text
        own = np.ones(len(self.padded), bool)
        at = np.concatenate(([0], np.cumsum(self.sizes + depth)[:-1]))
        own[(at[:, None] + np.arange(depth)).ravel()] = False
        self.places = np.flatnonzero(own)
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)

    def keys(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, key) of each byte; a key is its contexts, the latest byte first, then the byte itself."""
        for a in range(0, len(self.places), STEP):
            at = self.places[a : a + STEP]
            key = np.zeros(len(at), np.int64)
            for d in range(1, self.depth + 1):
                key = key << 8 | self.padded[at - d]
            yield self.doc[a : a + STEP], key << 8 | self.padded[at]

    def words(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, 64-bit hash) of each word: a polynomial in its bytes."""
        raw = self.padded[self.places]
        ends = np.flatnonzero((raw == 0x20) | (raw == END))
        starts = np.concatenate(([0], ends[:-1] + 1))
        sizes = ends + 1 - starts
        power = np.full(int(sizes.max(initial=1)), _FACTOR, np.uint64).cumprod(dtype=np.uint64)
        cuts = np.unique(np.searchsorted(starts, np.arange(0, len(raw) + STEP, STEP)))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            first, n = starts[a:b], sizes[a:b]
            part = raw[first[0] : first[0] + n.sum()]
            place = np.arange(len(part)) - np.repeat(first - first[0], n)
            found = np.add.reduceat(_LETTER[part] * power[place], first - first[0])
            found = (found ^ found >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
            word = raw[ends[a:b]] == 0x20
            yield self.doc[ends[a:b][word]], (found ^ found >> np.uint64(32)).view(np.int64)[word]


def in_batches(*columns: list) -> Iterator[tuple[list, ...]]:
    """Rows of (text, ...) together up to STEP characters; a longer text is a batch of its own."""
    rows: list[tuple] = []
    size = 0
    for row in zip(*columns, strict=True):
        if rows and size + len(row[0] or "") > STEP:
            yield tuple(map(list, zip(*rows, strict=True)))
            rows, size = [], 0
        rows.append(row)
        size += len(row[0] or "") + 16
    if rows:
        yield tuple(map(list, zip(*rows, strict=True)))


def summed(of: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct values of `of`, ascending, the place of each row's value, and sums of the columns by it."""
    distinct, place = np.unique(of, return_inverse=True)
    return distinct, place, *(np.bincount(place, c, len(distinct)) if c.dtype.kind == "f" else np.bincount(place, c, len(distinct)).round().astype(np.int64) for c in columns)


class Tree:
    """Nodes (context, decision) of depths `top` to `depth` over distinct keys and their training counts."""

    def __init__(self, key: np.ndarray, count: np.ndarray, depth: int, top: int):
        self.depth, self.top = depth, top
        byte = key & 255
        at = np.arange(8)
        self.bit = (byte[:, None] >> (7 - at)) & 1
        node = (1 << at) | (byte[:, None] >> (8 - at))
        leaf = (key >> 8)[:, None] << 8 | node
        ones = np.where(self.bit, count[:, None], 0)
        self.levels: list[tuple] = []
        ids, self.leaf, n1, n = summed(leaf.ravel(), ones.ravel(), np.broadcast_to(count[:, None], ones.shape).ravel())
        n0, weighted = n - n1, None
        for d in range(depth, top - 1, -1):
            own = log_kt(n0, n1)
            total = own if weighted is None else np.logaddexp(own, weighted) - math.log(2)
            stay = np.ones(len(own)) if weighted is None else np.exp(np.minimum(own - math.log(2) - total, 0))
            if d > top:
                up = (ids >> 16) << 8 | ids & 255
                parents, place, p0, p1, sums = summed(up, n0, n1, total)
                self.levels.append((ids, n0, n1, total, stay, place))
                ids, n0, n1, weighted = parents, p0, p1, sums
            else:
                self.levels.append((ids, n0, n1, total, stay, None))

    def summary(self) -> tuple[np.ndarray, ...]:
        """(node, zeros, ones, log weighted probability) of the top level."""
        return self.levels[-1][:4]

    def log10(self, carried: np.ndarray, weight: np.ndarray, last: np.ndarray) -> np.ndarray:
        """log10 probability of each key's byte; the arguments are the state above the top level's nodes.

        carried: the mixture so far of P(bit = 1); weight: what is left for deeper contexts; last: the estimate of the
        deepest context met.
        """
        for _, n0, n1, _, stay, up in reversed(self.levels):
            if up is not None:  # from the parents
                carried, weight, last = carried[up], weight[up], last[up]
            carried, weight, last = advance(carried, weight, last, n0, n1, stay)
        one = np.clip(carried + weight * last, 1e-12, 1 - 1e-12)[self.leaf].reshape(self.bit.shape)
        return np.log10(np.where(self.bit, one, 1 - one)).sum(axis=1)


def advance(carried: np.ndarray, weight: np.ndarray, last: np.ndarray, n0: np.ndarray, n1: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, ...]:
    met = n0 + n1 > 0
    own = (n1 + 0.5) / (n0 + n1 + 1)
    return np.where(met, carried + weight * stay * own, carried), np.where(met, weight * (1 - stay), weight), np.where(met, own, last)


# ---- the corpus in chunks and parts


def planes(x: np.ndarray) -> bytes:
    """An array byte plane by byte plane, so that sorted numbers compress in the shuffle."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplaned(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def part_of_key(key: np.ndarray, depth: int, parts: int) -> np.ndarray:
    """A context's part follows its two latest bytes, so that a part holds whole trees from depth 2 on; finer parts lie within coarser ones."""
    return (key >> 8 * (depth - 1)) * 40503 % 65521 * parts // 65521


def part_of_word(word: np.ndarray, parts: int) -> np.ndarray:
    return (word >> 16 & 0x7FFFFFFF) * parts >> 31


class _Counts:
    """Distinct keys and their training counts, gathered in steps of bounded size."""

    def __init__(self, step: int = 1 << 21):
        self.step, self.pending, self.size = step, ([], []), 0
        self.key, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, key: np.ndarray, learn: bool) -> None:
        self.pending[learn].append(key)
        self.size += len(key)
        if self.size >= self.step:
            self.settle()

    def settle(self) -> None:
        met = [_distinct(np.concatenate(x)) if x else (np.zeros(0, np.int64),) * 2 for x in self.pending]
        self.pending, self.size = ([], []), 0
        self.key, self.count = merged([(self.key, self.count), (met[0][0], np.zeros(len(met[0][0]), np.int64)), met[1]])


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.sort(key)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.diff(np.concatenate((first, [len(key)])))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts: one sort for all parts."""
    key = np.concatenate([np.zeros(0, np.int64), *(k for k, _ in parts)])
    n = np.concatenate([np.zeros(0, np.int64), *(c for _, c in parts)]).astype(np.int64)
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _gather(table: pa.Table, depth: int, parts: int) -> pa.Table:
    """A row for each part that the chunk has something for: its distinct keys and words with their training counts."""
    counts, word_counts, ends = _Counts(), _Counts(), 0
    for texts, learn in in_batches(table["text"].to_pylist(), table["learn"].to_pylist()):
        batch, learned = Batch(texts, depth), np.array(learn, bool)
        ends += int(learned.sum())
        for into, found in ((counts, batch.keys()), (word_counts, batch.words())):
            for doc, x in found:
                for learns in (False, True):
                    into.add(x[learned[doc] == learns], learns)
    counts.settle()
    word_counts.settle()
    return _dealt(table["chunk"][0].as_py(), (counts.key, counts.count), (word_counts.key, word_counts.count), ends, depth, 0, parts, parts)


COUNTS = "chunk long, part long, keys binary, counts binary, words binary, word_counts binary, ends long"


def _dealt(chunk: int, keys: tuple[np.ndarray, np.ndarray], words: tuple[np.ndarray, np.ndarray], ends: int, depth: int, first: int, parts: int, whole: int) -> pa.Table:
    """A row for each of the parts from `first` on, of `whole` in all, that keys or words fall in; the end marks go with the first."""
    split = []
    for (key, n), part in ((keys, part_of_key(keys[0], depth, whole)), (words, part_of_word(words[0], whole))):
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], first + np.arange(parts + 1))
        # four bytes a count where they are enough; how many there are tells which it was
        split.append((key[order], n[order].astype(np.int32 if n.max(initial=0) < 1 << 31 else np.int64), bounds))
    rows = []
    for p in range(parts):
        own = [x[bounds[p] : bounds[p + 1]] for key, n, bounds in split for x in (key, n)]
        if p == 0 or len(own[0]) or len(own[2]):
            rows.append((chunk, first + p, *map(planes, own), ends if p == 0 else 0))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.int64()), strict=True)], names=["chunk", "part", "keys", "counts", "words", "word_counts", "ends"])


def _merged(table: pa.Table, keys: str, counts: str) -> tuple[np.ndarray, np.ndarray]:
    pairs = ((k.as_py(), n.as_py()) for k, n in zip(table[keys], table[counts], strict=True))
    return merged([(unplaned(k, "i8"), unplaned(n, "i4" if 2 * len(n) == len(k) else "i8")) for k, n in pairs])


def _merger(depth: int, fan: int, parts: int) -> Callable[[pa.Table], pa.Table]:
    """One coarse part of up to `fan` groups as `fan` finer parts, of `parts` in all."""

    def run(table: pa.Table) -> pa.Table:
        first = table["part"][0].as_py() * fan
        return _dealt(table["group"][0].as_py(), _merged(table, "keys", "counts"), _merged(table, "words", "word_counts"), sum(table["ends"].to_pylist()), depth, first, fan, parts)

    return run


ANSWERS = "chunk long, part long, keys binary, log10 binary, words binary, word_counts binary"


def _answered(asked: pa.Table, key: np.ndarray, log10: np.ndarray, names: np.ndarray, of_words: np.ndarray) -> pa.Table:
    """Probabilities and word counts of each row's own keys and words; key and names ascend and have all of them."""
    out = []
    for chunk, part, raw, words in zip(asked["chunk"].to_pylist(), asked["part"].to_pylist(), asked["keys"], asked["words"], strict=True):
        mine, own = unplaned(raw.as_py(), "i8"), unplaned(words.as_py(), "i8")
        out.append((chunk, part, raw.as_py(), planes(log10[np.searchsorted(key, mine)]) if len(mine) else b"", words.as_py(), planes(of_words[np.searchsorted(names, own)]) if len(own) else b""))
    columns = zip(*out, strict=True) if out else [[]] * 6
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=["chunk", "part", "keys", "log10", "words", "word_counts"])


def score(docs: DataFrame, learns: Column, depth: int = 5, chunk_bytes: int = 32 << 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row; `learns` marks the training rows.

    bits_per_byte is the code length of the text's bytes, its end mark among them, over their number.
    """
    spark = docs.sparkSession
    batches(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), F.coalesce(learns, F.lit(False)).alias("learn"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    fan, groups, parts = FAN, chunks, FAN
    steps = [written(chunked.groupBy("chunk").applyInArrow(lambda t: _gather(t, depth, fan), COUNTS), "ctw-counts")]
    while groups > fan:
        parts *= fan
        steps.append(written(steps[-1].withColumn("group", F.expr(f"chunk div {fan}")).groupBy("group", "part").applyInArrow(_merger(depth, fan, parts), COUNTS), "ctw-counts"))
        groups = -(-groups // fan)
    gathered = steps[-1]

    def top(table: pa.Table) -> pa.Table:
        """Additive shares of the nodes of depth 1, and of the token totals (node -1)."""
        key, count = _merged(table, "keys", "counts")
        _, of_words = _merged(table, "words", "word_counts")
        ends = sum(table["ends"].to_pylist())
        out = [(-1, int(of_words.sum()) + ends, int(np.count_nonzero(of_words)), float(ends))]
        if len(key):
            node, n0, n1, weighted = Tree(key, count, depth, min(2, depth)).summary()
            up, _, n0, n1, sums = summed((node >> 16) << 8 | node & 255, n0, n1, weighted)
            out += zip(up.tolist(), n0.tolist(), n1.tolist(), sums.tolist(), strict=True)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["node", "n0", "n1", "weighted"])

    shares = gathered.groupBy("part").applyInArrow(top, "node long, n0 long, n1 long, weighted double")
    above = {r[0]: r[1:] for r in shares.groupBy("node").agg(F.sum("n0"), F.sum("n1"), F.sum("weighted")).collect()}  # at most 256 * 255 + 1 rows
    tokens, known, ends = above.pop(-1, (0, 0, 0.0))
    ends = int(ends)
    known += ends > 0
    state = _top_state(above)

    def answer(left: pa.Table) -> pa.Table:
        """Probabilities and word counts for each chunk's own keys and words."""
        key, count = _merged(left, "keys", "counts")
        names, of_words = _merged(left, "words", "word_counts")
        if len(key):
            tree = Tree(key, count, depth, min(2, depth))
            node = tree.levels[-1][0]
            at = np.searchsorted(state[0], (node >> 16) << 8 | node & 255)
            log10 = tree.log10(*(x[at] for x in state[1:]))
        return _answered(left, key, log10 if len(key) else np.zeros(0), names, of_words)

    def pass_on(below: pa.Table, above: pa.Table) -> pa.Table:
        """What a merged group knows by now, to the groups it was merged from."""
        whole = lambda name, kind: np.concatenate([np.zeros(0, kind), *(unplaned(x.as_py(), kind) for x in above[name])])
        key, log10, names, of_words = whole("keys", "i8"), whole("log10", "f8"), whole("words", "i8"), whole("word_counts", "i8")
        by_key, by_name = np.argsort(key), np.argsort(names)
        return _answered(below, key[by_key], log10[by_key], names[by_name], of_words[by_name])

    answers = gathered.groupBy("part").applyInArrow(answer, ANSWERS)
    for below in reversed(steps[:-1]):
        # names of their own above: a cogroup takes shared ones of one plan for the left side's
        above = answers.select(F.col("chunk").alias("group"), F.expr(f"part div {fan}").alias("own"), "keys", "log10", "words", "word_counts")
        asked = below.select(F.expr(f"chunk div {fan}").alias("in_group"), "chunk", "part", "keys", "words")
        answers = asked.groupBy("in_group", "part").cogroup(above.groupBy("group", "own")).applyInArrow(pass_on, ANSWERS)
    unit = math.log10(tokens + 0.1 * (known + 1)) if tokens else math.log10(0.1 * (known + 1))

    def final(left: pa.Table, right: pa.Table) -> pa.Table:
        import pandas as pd

        whole = lambda name, kind: np.concatenate([np.zeros(0, kind), *(unplaned(x.as_py(), kind) for x in right[name])])
        index, log10 = pd.Index(whole("keys", "i8")), whole("log10", "f8")
        names, n = pd.Index(whole("words", "i8")), whole("word_counts", "i8")
        logs, met = np.log10(n + 0.1) - unit, n > 0
        end = math.log10(ends + 0.1) - unit
        out: list[tuple] = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0),) * 3]
        for texts, docs in in_batches(left["text"].to_pylist(), left["doc_id"].to_pylist()):
            batch, k = Batch(texts, depth), len(texts)
            tokens_of, known_of, base, got = np.ones(k, np.int64), np.full(k, int(ends > 0)), np.full(k, end), np.zeros(k)
            for doc, word in batch.words():
                at = names.get_indexer(word)
                tokens_of += np.bincount(doc, minlength=k)
                known_of += np.bincount(doc, met[at], k).astype(np.int64)
                base += np.bincount(doc, logs[at], k)
            for doc, key in batch.keys():
                got += np.bincount(doc, log10[index.get_indexer(key)], k)
            out.append((docs, tokens_of, known_of, np.full(k, tokens), base, got, -got * math.log2(10) / batch.sizes))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        return pa.Table.from_arrays([pa.chunked_array([pa.array(x, t) for x in c], t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    return chunked.drop("learn").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(final, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def _top_state(above: dict[int, tuple]) -> tuple[np.ndarray, ...]:
    """Ascending nodes of depth 1, and what `Tree.log10` carries on from them."""
    ids = np.array(sorted(above), np.int64)
    n0, n1 = (np.array([above[i][k] for i in ids.tolist()], np.int64) for k in (0, 1))
    below = np.array([above[i][2] for i in ids.tolist()])
    own = log_kt(n0, n1)
    total = np.logaddexp(own, below) - math.log(2)
    stay = np.exp(np.minimum(own - math.log(2) - total, 0))
    root, place, r0, r1, sums = summed(ids & 255, n0, n1, total)
    root_own = log_kt(r0, r1)
    root_stay = np.exp(np.minimum(root_own - math.log(2) - (np.logaddexp(root_own, sums) - math.log(2)), 0))
    k = len(root)
    carried, weight, last = advance(np.zeros(k), np.ones(k), np.full(k, 0.5), r0, r1, root_stay)
    return (ids, *advance(carried[place], weight[place], last[place], n0, n1, stay))
