"""Best-fit packing by a linear grouping scheme.

Tokens are counted once per document; what the driver plans with is the histogram of piece lengths, at most
`capacity` rows at any corpus size. The plan is a list of seats (length, ranks, sequence, offset): large lengths are
rounded up within groups of equal cardinality, a configuration linear program over those few sizes is solved by column
generation and rounded down, actual lengths take the places of the rounded ones, and everything left (the small
lengths among it) goes best-fit into the gaps. Pieces find their seat by their rank among pieces of their length.

Defined results: a null text is an empty document (its end token alone); a repeated row is a document of its own; an
empty table gives no rows; columns other than the id and text columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.llm.common import batches, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
#: Bytes of strings and token ids that a worker keeps, what an entry takes besides, and the longest string kept; a full table is emptied.
KEPT, ENTRY, LONGEST_KEPT = 96 << 20, 190, 64
#: Strings for which Python's re splits as the tokenizer's own pattern does: visible ASCII and the Latin-1 letters.
SIMPLE = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
PRE_TOKENS = re.compile(r"[a-zà-öø-ÿß]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\sa-zà-öø-ÿß0-9]+")


class _Kept(dict):
    """A string's token ids as bytes, made when first asked for; bounded by what strings and ids measure together."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.size = make, 0

    def __missing__(self, word: str) -> bytes:
        ids = self.make(word)
        if len(word) <= LONGEST_KEPT:
            self.size += ENTRY + len(word) + len(ids)
            if self.size > KEPT:
                self.clear()
                self.size = ENTRY + len(word) + len(ids)
            self[word] = ids
        return ids


_encoders: dict[str, Callable[[list[str]], list[bytes]]] = {}


def word_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Texts to little-endian unsigned 32-bit token ids, by the tokenizer at `path` (lower case, words with ends), as it is loaded.

    The tokenizer never joins across white space, nor its model across pre-tokens; so strings between spaces, and their
    pre-tokens, are encoded once in a worker process and kept, in one table: a pre-token alone is a string of one. Texts that
    hold one of the tokenizer's special tokens, which it looks for first, are encoded whole.
    """
    if path in _encoders:  # one table for all tasks of a worker process
        return _encoders[path]
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = Tokenizer.from_file(path)
    added = tokenizer.get_added_tokens_decoder().values()
    raw_tokens, folded_tokens = [t.content for t in added if not t.normalized], [t.content.lower() for t in added if t.normalized]

    def special(text: str) -> bool:
        """Whether the tokenizer may find one of its own tokens before it splits the text: as it stands, or in lower case."""
        if any(t in text for t in raw_tokens):
            return True
        low = text.lower() if folded_tokens else ""
        return any(t in low for t in folded_tokens)

    level = ByteLevel(add_prefix_space=False, use_regex=False)
    # the sign of each byte above ASCII is the last one of a character that ends in that byte
    marks = {b: level.pre_tokenize_str(bytes([0xC3, b]).decode())[0][0][-1] for b in range(0x80, 0xC0)}
    marks[0xC3] = level.pre_tokenize_str("à")[0][0][0]

    def of_pre_token(word: str) -> bytes:
        raw = word if word.isascii() else word.encode().decode("latin-1").translate(marks)
        return array("I", [t.id for t in tokenizer.model.tokenize(raw)]).tobytes()

    def whole(text: str) -> bytes:
        return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def of_string(text: str) -> bytes:
        if SIMPLE.fullmatch(text):
            own = PRE_TOKENS.findall(text.lower())
            return b"".join(kept[w] for w in own) if len(own) > 1 else b"".join(map(of_pre_token, own))
        return whole(text)

    kept = _Kept(of_string)

    def encode(texts: list[str]) -> list[bytes]:
        found = [whole(t) if special(t) else b"".join(map(kept.__getitem__, t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))) for t in texts]
        return found if sys.byteorder == "little" else [np.frombuffer(x, ">u4").astype("<u4").tobytes() for x in found]

    _encoders[path] = encode
    return encode


def cut(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[bytes]]], capacity: int, end_id: int, id_column: str, text_column: str) -> DataFrame:
    """One row per piece. part and nth number the pieces of a length within the task that made them."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, end = encoder(), TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        seen = np.zeros(capacity + 1, np.int64)
        for frame in frames:
            ids, rows = frame.column(0).to_pylist(), []
            for doc, raw in zip(ids, encode([t or "" for t in frame.column(1).to_pylist()]), strict=True):
                raw += end
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    own = raw[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((doc, piece, at // 4, n, zlib.crc32(own), part, int(seen[n])))
                    seen[n] += 1
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, PIECES)


# ---- the plan, on the driver, from a histogram


def best_configuration(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the multiset of sizes within the capacity that is worth most."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        fits = sizes <= room
        worth = np.where(fits, values + best[np.where(fits, room - sizes, 0)], -1.0)
        g = int(worth.argmax())
        if worth[g] > best[room - 1] + 1e-12:
            best[room], choice[room] = worth[g], g
        else:
            best[room], choice[room] = best[room - 1], -1
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return float(best[capacity]), counts


def configurations(sizes: np.ndarray, needed: np.ndarray, capacity: int, rounds: int = 600) -> list[tuple[np.ndarray, int]]:
    """Few-size configurations and how often each is used: the linear program by column generation, rounded down."""
    k = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    amounts = needed / np.diag(columns)
    for _ in range(rounds):
        inverse = np.linalg.inv(columns)
        duals = inverse.sum(axis=0)
        worth, counts = best_configuration(np.maximum(duals, 0), sizes, capacity)
        if worth <= 1 + 1e-9:
            break
        direction = inverse @ counts
        amounts = inverse @ needed
        ratios = np.where(direction > 1e-12, amounts / np.where(direction > 1e-12, direction, 1), np.inf)
        leave = int(ratios.argmin())
        columns[:, leave] = counts
    amounts = np.linalg.solve(columns, needed.astype(float))
    return [(columns[:, j].round().astype(np.int64), int(np.floor(amounts[j] + 1e-6))) for j in range(k) if amounts[j] >= 1 - 1e-6]


class _Stock:
    """How many pieces of each length are left, and the largest such length up to a bound."""

    def __init__(self, histogram: dict[int, int]):
        self.count = dict(histogram)
        self.lengths = sorted(n for n, c in histogram.items() if c)

    def largest(self, most: int) -> int:
        """0 if there is none."""
        i = bisect.bisect_right(self.lengths, most) - 1
        return self.lengths[i] if i >= 0 else 0

    def take(self, n: int, c: int) -> None:
        self.count[n] -= c
        if not self.count[n]:
            self.lengths.pop(bisect.bisect_left(self.lengths, n))


def rounded_groups(stock: _Stock, over: int, groups: int) -> list[tuple[int, int, int]]:
    """(least length, size rounded up to, items) of groups of equal cardinality over all lengths above `over`."""
    lengths = [n for n in reversed(stock.lengths) if n > over]
    total = sum(stock.count[n] for n in lengths)
    out: list[list[int]] = []
    before = 0
    for n in lengths:  # a length that spans a group's end opens no group of its own
        k = before * groups // max(total, 1)
        if out and out[-1][3] == k:
            out[-1][0] = n
            out[-1][2] += stock.count[n]
        else:
            out.append([n, n, stock.count[n], k])
        before += stock.count[n]
    return [(a, b, c) for a, b, c, _ in out]


def substitute(stock: _Stock, places: list[tuple[int, int]], times: int, capacity: int) -> Iterator[tuple[tuple[tuple[int, int], ...], int]]:
    """Actual lengths for a configuration's places (least, most), as runs of equal sequences.

    A place takes the largest length left in its group; the last one takes the largest that still fits the sequence.
    """
    while times:
        own: dict[int, int] = {}
        room = capacity
        for i, (least, most) in enumerate(places):
            n = stock.largest(room if i == len(places) - 1 else min(most, room))
            while n and stock.count[n] <= own.get(n, 0):  # used up by this very sequence
                n = stock.largest(n - 1)
            if n and (n >= least or i == len(places) - 1):
                own[n] = own.get(n, 0) + 1
                room -= n
        if not own:
            return
        step = min(times, *(stock.count[n] // q for n, q in own.items()))
        for n, q in own.items():
            stock.take(n, q * step)
        times -= step
        yield tuple(own.items()), step


def plan(histogram: dict[int, int], capacity: int, groups: int = 20, small: tuple[float, ...] = (1 / 8, 1 / 4, 1 / 2)) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(pattern, times)]: a pattern is ((length, how many), ...), its total at most the capacity.

    Lengths over a share of the capacity are the large ones; of the shares in `small`, that with the fewest sequences
    is taken. The number of patterns follows the number of distinct lengths, not the number of pieces.
    """
    plans = [_plan(histogram, capacity, groups, share) for share in small]
    return min(plans, key=lambda p: sum(times for _, times in p))


def _plan(histogram: dict[int, int], capacity: int, groups: int, small: float) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    stock = _Stock(histogram)
    bins: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    gaps: list[int] = []

    def put(pattern: tuple[tuple[int, int], ...], times: int) -> None:
        gap = capacity - sum(n * q for n, q in pattern)
        if gap not in bins:
            bins[gap] = []
            bisect.insort(gaps, gap)
        bins[gap].append((pattern, times))

    if full := stock.count.get(capacity, 0):
        put(((capacity, 1),), full)
        stock.take(capacity, full)
    if large := rounded_groups(stock, int(small * capacity), groups):
        sizes, needed = np.array([b for _, b, _ in large]), np.array([c for _, _, c in large])
        for counts, times in configurations(sizes, needed, capacity):
            places = [large[g][:2] for g in np.flatnonzero(counts) for _ in range(counts[g])]
            for pattern, step in substitute(stock, places, times, capacity):
                put(pattern, step)
    for n in reversed(stock.lengths):  # best fit, largest first: the fullest sequences that still have room
        c = stock.count[n]
        while c:
            i = bisect.bisect_left(gaps, n)
            if i == len(gaps):
                q = min(capacity // n, c)
                put(((n, q),), c // q)
                c -= q * (c // q)
                continue
            gap = gaps[i]
            pattern, times = bins[gap].pop()
            if not bins[gap]:
                del bins[gap]
                gaps.pop(i)
            q = min(gap // n, c)
            used = min(times, c // q)
            if times > used:
                put(pattern, times - used)
            put((*pattern, (n, q)), used)
            c -= q * used
    return [x for own in bins.values() for x in own if x[1]]


def seats(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, first sequence, offset, how many side by side), sorted by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        at = 0
        for n, q in pattern:
            out.setdefault(n, []).append((ranks.get(n, 0), sequence, at, q))
            ranks[n] = ranks.get(n, 0) + q * times
            at += n * q
        sequence += times
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def pack(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[bytes]]], capacity: int = 2048, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text", groups: int = 20) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece of every document in its sequence.

    `encoder` makes, on an executor, the function from texts to token ids; `word_encoder` is one.
    """
    spark = docs.sparkSession
    batches(spark)
    pieces = written(cut(docs, encoder, capacity, end_id, id_column, text_column), "pieces")
    counts = written(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    by_length = seats(plan(histogram, capacity, groups))
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))

    def seat(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            length, rank = (frame.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            bounds = np.flatnonzero(np.diff(length[order], prepend=-1))
            for own in np.split(order, bounds[1:]) if len(order) else []:
                rows = by_length[int(length[own[0]])]
                row = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                nth = rank[own] - row[:, 0]
                sequence[own] = row[:, 1] + nth // row[:, 3]
                offset[own] = row[:, 2] + nth % row[:, 3] * length[own]
            yield pa.RecordBatch.from_arrays([*(frame.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(seat, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
