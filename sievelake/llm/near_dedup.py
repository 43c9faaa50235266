"""Near-duplicate classes by order MinHash.

A text is its words (lower case, no punctuation); its k-mers are runs of `k` words, labelled by occurrence so that a
repeated k-mer counts each time. A sketch entry takes the `ell` labelled k-mers of smallest hash and keeps them in text
order, so two texts agree on it only if they share those k-mers in the same order; that follows edit similarity, where
plain MinHash follows sets. Bands of `rows` entries are bucket keys; the usual parameters are such that a pair at the least
similarity meets in some bucket even if its edits are scattered (2 of 10 words changed at random leave a Jaccard share J of
a fifth of the 5-mers, and 1 - (1 - J^2)^128 of the pairs meet). A text of under `SHORT` words
keeps too few 5-mers for that and has bands of 2-mers in their place; one of up to `SHORT` / similarity words has both, as it may
be near to either. Candidates are verified by banded alignment: word edit
distance at most (1 - similarity) of the longer text.

Equal word sequences are one representative from the start, numbered apart from the ids, so an id that stands by several texts is
in the classes of all of them. A bucket links its members to its first one. Where this leaves
more than one class in a bucket, its members are dealt into blocks by a hash, and any two blocks of which one lies outside
the bucket's largest class meet in a task of their own: there each pair of different classes is ruled out by bounds of
the edit distance (lengths, and words and word pairs counted in hashed cells) or goes on to the alignment. So every pair
that meets in a bucket is linked, in one class already, ruled out or aligned, whatever the size of the bucket; no bucket and no class is
capped, no task holds more than two blocks, and no group of copies is expanded into pairs.

Defined results: a text without a word (null and empty ones too) is a class of its own; a text of fewer than k words has
one k-mer, all its words; repeated rows get the same class, and rows of one id with different words the classes of their words
(a class is named after its smallest id, so two classes may bear one name if an id has several texts); empty tables give no rows;
extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from sievelake.llm.common import Sieve, batches, forget, written
from sievelake.plans.components import connected_components

WORD = re.compile(r"[^\W_]+")
#: Members of a block, about; two blocks of a bucket meet in one task.
BLOCK = 4096
#: Cells of the counts of words and of word pairs from which a distance is bounded without the texts.
CELLS, PAIR_CELLS = 512, 256
#: Bands whose buckets are compared before the others, so that a class is joined by few links for each member.
FIRST_BANDS = 4
#: Texts of fewer words are sketched by shorter k-mers.
SHORT = 40


def normalise(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def digest_of(words: list[str]) -> bytes | None:
    return xxh3_128_digest(" ".join(words).encode("utf-8", "replace")) if words else None


class Sketcher:
    """Order MinHash sketches of word sequences."""

    def __init__(self, k: int = 5, ell: int = 2, entries: int = 128, rows: int = 1, seed: int = 7):
        self.k, self.ell, self.entries, self.rows = k, ell, entries, rows
        rng = np.random.default_rng(seed)
        self.mix = rng.integers(1, 2**32, entries, dtype=np.uint32) | np.uint32(1)
        self.add = rng.integers(1, 2**32, entries, dtype=np.uint32)
        self.order = rng.integers(1, 2**63, ell, dtype=np.uint64) | np.uint64(1)
        self.place = rng.integers(1, 2**63, k, dtype=np.uint64) | np.uint64(1)
        self.letter = rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
        self.letter[32] = 0
        self.power = np.full(64, 0x9E3779B97F4A7C15, np.uint64).cumprod(dtype=np.uint64)

    def numbers(self, words: list[str]) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial in its UTF-8 bytes, all words at once."""
        if not words:
            return np.zeros(0, np.uint64)
        raw = np.frombuffer((" ".join(words) + " ").encode("utf-8", "replace"), np.uint8)
        ends = np.flatnonzero(raw == 32) + 1
        starts = np.concatenate(([0], ends[:-1]))
        sizes = ends - starts
        if (longest := int(sizes.max())) > len(self.power):
            self.power = np.full(2 * longest, 0x9E3779B97F4A7C15, np.uint64).cumprod(dtype=np.uint64)
        found = np.add.reduceat(self.letter[raw] * self.power[np.arange(len(raw)) - np.repeat(starts, sizes)], starts)
        found = (found ^ found >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return found ^ found >> np.uint64(32)

    def bands(self, words: list[str]) -> np.ndarray:
        """Signed 64-bit bucket keys, one a band."""
        n = self.numbers(words)
        if len(n) < self.k:
            n = np.concatenate((n, np.zeros(self.k - len(n), np.uint64)))
        size = len(n) - self.k + 1
        mers = np.zeros(size, np.uint64)
        for i in range(self.k):
            mers += n[i : i + size] * self.place[i]
        mers ^= mers >> np.uint64(31)
        labelled = mers
        ranked = np.sort(mers)
        if (ranked[1:] == ranked[:-1]).any():
            order = np.argsort(mers, kind="stable")
            run = np.concatenate(([True], mers[order][1:] != mers[order][:-1]))
            nth = np.empty(size, np.uint64)
            at = np.arange(size)
            nth[order] = at - np.maximum.accumulate(np.where(run, at, 0))
            labelled = mers + nth * np.uint64(0x9E3779B97F4A7C15)
        labelled = ((labelled ^ labelled >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)
        out = np.empty(self.entries, np.uint64)
        ell = min(self.ell, size)
        step = max(1, min(self.entries, (1 << 16) // size))  # as many entries at once as stay in the processor's cache
        for a in range(0, self.entries, step):
            h = labelled[None, :] * self.mix[a : a + step, None]
            h += self.add[a : a + step, None]
            row = np.arange(len(h))
            least = np.empty((len(h), ell), np.int64)
            for e in range(ell):  # the smallest, then the next smallest
                least[:, e] = h.argmin(axis=1)
                h[row, least[:, e]] = ~np.uint32(0)
            least.sort(axis=1)
            out[a : a + step] = (mers[least] * self.order[None, :ell]).sum(axis=1, dtype=np.uint64)
        out ^= out >> np.uint64(30)
        keys = np.zeros(self.entries // self.rows, np.uint64)
        for r in range(self.rows):
            keys = keys * np.uint64(0xBF58476D1CE4E5B9) + out[r :: self.rows][: len(keys)]
        keys = keys * np.uint64(0x94D049BB133111EB) + np.arange(len(keys), dtype=np.uint64)
        keys ^= keys >> np.uint64(31)
        return (keys * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)

    def bag(self, words: list[str]) -> bytes:
        """Counts of the words and of the pairs of neighbouring words by hashed cell, up to 15 each, two in a byte."""
        n = self.numbers(words)
        pairs = (n[:-1] * self.place[0] + n[1:]) * np.uint64(0x9E3779B97F4A7C15)
        counts = [np.bincount((x >> np.uint64(40)).astype(np.int64) % size, minlength=size) for x, size in ((n, CELLS), (pairs, PAIR_CELLS))]
        few = np.minimum(np.concatenate(counts), 15).astype(np.uint8)
        return (few[0::2] | few[1::2] << 4).tobytes()


def edits_within(a: list, b: list, most: int) -> int | None:
    """Edit distance of two sequences if it is at most `most`, else None: bit-parallel over a band of 2 * most + 1 diagonals."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return None
    start = 0
    while start < len(a) and a[start] == b[start]:
        start += 1
    end_a, end_b = len(a), len(b)
    while end_a > start and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    a, b = a[start:end_a], b[start:end_b]
    m, n = len(a), len(b)
    if not m:
        return n
    most = min(most, n)
    if not most:
        return None
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    # bits are rows of the column around its diagonal: bit r of column j is row j - most + r
    width = 2 * most + 1
    full, top, low = (1 << width) - 1, 1 << 2 * most, most
    up, down = full ^ ((1 << most) - 1), 0
    inside = max(0, m - most)  # columns whose lowest row lies within a
    distance = most if m > most else m
    bit = 1 << (m - 1 - inside + low)
    for j, x in enumerate(b):
        own = masks.get(x, 0)
        own = (own >> (j - most) if j >= most else own << (most - j)) & full
        same = ((((own & up) + up) ^ up) | own | down) & full
        plus, minus = down | (full & ~(same | up)), same & up
        if j < inside:
            distance += not same & top
        else:
            distance += bool(plus & bit) - bool(minus & bit)
            bit >>= 1
            if not bit:
                break
        if distance - (n - 1 - j) > most and j >= inside:
            return None
        shifted = same >> 1
        up, down = minus | (full & ~(shifted | plus)), shifted & plus
    return distance if distance <= most else None


def similar(a: list[str], b: list[str], similarity: float) -> bool:
    longer = max(len(a), len(b))
    most = int((1 - similarity) * longer + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    # no alignment keeps more words than the two have in common
    counts: dict[str, int] = {}
    for w in a:
        counts[w] = counts.get(w, 0) + 1
    common = 0
    for w in b:
        if c := counts.get(w, 0):
            counts[w] = c - 1
            common += 1
    return longer - common <= most and edits_within(a, b, most) is not None


def banded(words: list[str], sketcher: Sketcher, brief: Sketcher, similarity: float) -> tuple[int, np.ndarray]:
    """The number of the first band and the keys from there on: the usual bands, then those of short texts."""
    if len(words) < SHORT:
        return sketcher.entries // sketcher.rows, brief.bands(words)
    keys = sketcher.bands(words)
    return 0, np.concatenate((keys, brief.bands(words))) if len(words) * similarity <= SHORT else keys


def sketches(docs: DataFrame, sketcher: Sketcher, brief: Sketcher, similarity: float, id_column: str, text_column: str) -> DataFrame:
    """doc_id, digest of the words (null if there is none), number of words, first band, bucket keys."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            words = [normalise(t) for t in frame.column(1).to_pylist()]
            found = [banded(x, sketcher, brief, similarity) if x else (0, None) for x in words]
            yield pa.RecordBatch.from_arrays(
                [frame.column(0), pa.array(map(digest_of, words), pa.binary()), pa.array(map(len, words), pa.int32()), pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.list_(pa.int64()))],
                names=["doc_id", "digest", "words", "first", "bands"],
            )

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, digest binary, words int, first int, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """a, b, linked of candidate pairs; texts by id, once each."""
    of = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"t{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ta", "tb")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, list[str]] = ("", [])
        for frame in frames:
            found = []
            for ta, tb in zip(frame.column(2).to_pylist(), frame.column(3).to_pylist(), strict=True):
                if ta != last[0]:
                    last = (ta, ta.split(" "))
                found.append(similar(last[1], tb.split(" "), similarity))
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1), pa.array(found, pa.bool_())], names=["a", "b", "linked"])

    return both.mapInArrow(run, "a long, b long, linked boolean")


def classes(docs: DataFrame, similarity: float = 0.8, sketcher: Sketcher | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, class_id (the smallest id of the class), one row per row of docs with an id."""
    return _members(docs, similarity, sketcher, id_column, text_column).select("doc_id", "class_id")


def _members(docs: DataFrame, similarity: float, sketcher: Sketcher | None, id_column: str, text_column: str) -> DataFrame:
    """doc_id, digest, class_id, and whether id and digest are the first of their class; one row per row of docs with an id."""
    spark = docs.sparkSession
    batches(spark)
    sketcher, brief = sketcher or Sketcher(), Sketcher(k=2, entries=64, seed=8)
    made = written(sketches(docs, sketcher, brief, similarity, id_column, text_column).where("doc_id is not null"), "sketches")
    # one representative per word sequence, with a number of its own; only the smallest (id, keys) of a group travels
    firsts = made.where("digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "words", "first", "bands")).alias("f"))
    firsts = written(firsts.select("digest", "f.*", F.monotonically_increasing_id().alias("id")), "representatives")
    ids = written(made.select("doc_id", "digest"), "ids")
    forget(made)
    # id and band travel as one number, as there is such a row for each text and band
    rows = firsts.select("id", "words", "first", F.posexplode("bands").alias("at", "bucket")).select((F.col("id") * 256 + F.col("first") + F.col("at")).alias("entry"), "words", "bucket")
    # one row a bucket, as a table, so that a bucket that fills a partition can be split on the members' side
    shared = rows.groupBy("bucket").agg(F.min("entry").alias("least"), F.max("entry").alias("most")).where("least <> most")
    shared = written(shared.select("bucket", F.shiftright("least", 8).alias("pivot")), "buckets")
    # how many buckets are shared has no bound, so they are never broadcast, and a small table is joined as a large one is
    members = written(rows.join(shared.hint("merge"), "bucket").select(F.shiftright("entry", 8).alias("id"), (F.col("entry") % 256).cast("int").alias("band"), "words", "bucket", "pivot"), "members")
    of_digest = written(firsts.select("digest", "doc_id", "words", "id"), "ids")
    forget(firsts, shared)
    needed = written(of_digest.join(members.select("id").distinct(), "id", "left_semi"), "needed")
    texts = written(_texts(docs, needed, sketcher, id_column, text_column), "candidate-texts")
    forget(needed)
    # each member against its bucket's pivot; later bands skip what the first ones have joined already
    labels, tested = None, None
    sizes = of_digest.select(F.col("id").alias("a"), F.col("words").alias("wa"))
    fits = F.least("wa", "words") >= F.greatest("wa", "words") * F.lit(similarity - 1e-9)
    early = F.col("band") % (sketcher.entries // sketcher.rows) < FIRST_BANDS
    for bands in (early, ~early):
        pairs = members.where(bands & (F.col("id") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("id").alias("b"), "words").distinct().join(sizes, "a").where(fits).select("a", "b")
        if labels is not None:
            of = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))  # noqa: B023, E731
            pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b").join(tested.select("a", "b"), ["a", "b"], "left_anti")
        fresh = written(verified(pairs, texts, similarity), "compared")
        labels, tested = _joined(labels, fresh), fresh if tested is None else tested.unionByName(fresh)
    near = written(_close(_blocks(members, labels, texts), similarity).join(tested.select("a", "b"), ["a", "b"], "left_anti"), "close")
    forget(members)
    labels = _joined(labels, written(verified(near, texts, similarity), "compared"))
    forget(texts)
    named = written(of_digest.join(labels, of_digest["id"] == labels["node"], "left").select("digest", "doc_id", F.coalesce("component", "id").alias("class")), "classes")
    first = named.groupBy("class").agg(F.min(F.struct("doc_id", "digest")).alias("least"))  # one row a class, so that a large one can be split on the other side
    of_digest = named.join(first, "class").select("digest", "least")
    whole = ids.join(of_digest, "digest", "left")
    is_first = F.col("least").isNull() | (F.col("doc_id") == F.col("least.doc_id")) & (F.col("digest") == F.col("least.digest"))
    return whole.select("doc_id", "digest", F.coalesce("least.doc_id", "doc_id").alias("class_id"), is_first.alias("is_first"))


def _joined(labels: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """Classes after more links: each member so far holds on to its class by one link."""
    links = fresh.where("linked").select("a", "b")
    if labels is None:
        return connected_components(links)
    if not links.limit(1).count():
        return labels
    return connected_components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))


def _texts(docs: DataFrame, needed: DataFrame, sketcher: Sketcher, id_column: str, text_column: str) -> DataFrame:
    """id, words, words joined by spaces and their counts by cell, of the needed (id, doc_id, digest), once each.

    Digests say in the end which texts are needed; the ids only save moving the others.
    """
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    own = Sieve(needed.select("doc_id")).through(own, F.col("doc_id"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            words = [normalise(t) for t in frame.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(digest_of, words), pa.binary()), pa.array(map(len, words), pa.int32()), pa.array([" ".join(x) for x in words], pa.string()), pa.array(map(sketcher.bag, words), pa.binary())], names=["digest", "words", "text", "bag"])

    made = own.mapInArrow(run, "digest binary, words int, text string, bag binary").where("digest is not null")
    return made.groupBy("digest").agg(F.min(F.struct("text", "words", "bag")).alias("f")).join(needed.select("digest", "id"), "digest").select("id", "f.*")


def _blocks(members: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """bucket, i, j, block, id, class, words, bag, earlier: a row for each meeting (i, j) of two blocks that a member takes part in.

    Only buckets of more than one class are left. Blocks of the largest class have negative numbers and meet the others,
    not one another; a block's number is a hash, so no bucket is sorted or counted through in one task. A member's buckets,
    at most one a band, are gathered before its counts are joined, so that those move once; `earlier` has those of the bands
    before the bucket's own, as a pair that meets in several buckets is to be found in the first of them alone.
    """
    named = members.join(labels, members["id"] == labels["node"], "left").select("bucket", "band", "id", F.coalesce("component", "id").alias("class"))
    sizes = named.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n"))
    open_ = sizes.groupBy("bucket").agg(F.max(F.struct("n", "class")).alias("h"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    open_ = open_.select("bucket", F.col("h.class").alias("largest"), blocks(F.col("h.n")).alias("inner"), blocks(F.col("all") - F.col("h.n")).alias("outer"))
    home, deal = F.col("class") == F.col("largest"), lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    own = named.join(open_, "bucket").withColumn("block", F.when(home, -1 - deal("inner")).otherwise(deal("outer")))
    by_id = own.groupBy("id").agg(F.first("class").alias("class"), F.collect_list(F.struct("band", "bucket", "block", "inner", "outer")).alias("all"))
    found = by_id.join(texts.select("id", "words", "bag"), "id").select("id", "class", "words", "bag", "all", F.explode("all").alias("at"))
    before = F.transform(F.filter("all", lambda x: x["band"] < F.col("at.band")), lambda x: F.struct(x["band"].alias("band"), x["bucket"].alias("bucket")))
    found = found.select("id", "class", "words", "bag", before.alias("earlier"), "at.*")
    meeting = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    outer, every, block = F.sequence(F.lit(0), F.col("outer") - 1), F.sequence(-F.col("inner"), F.col("outer") - 1), F.col("block")
    met = F.when(block < 0, F.transform(outer, lambda x: meeting(x, block))).otherwise(F.transform(every, lambda x: meeting(F.greatest(x, block), F.least(x, block))))
    return found.select("bucket", F.explode(met).alias("m"), "block", "id", "class", "words", "bag", "earlier").select("bucket", "m.i", "m.j", "block", "id", "class", "words", "bag", "earlier")


def unpacked(bags: list[bytes]) -> np.ndarray:
    """A row of counts for each of the bags."""
    packed = np.frombuffer(b"".join(bags), np.uint8).reshape(len(bags), (CELLS + PAIR_CELLS) // 2)
    counts = np.empty((len(bags), CELLS + PAIR_CELLS), np.uint8)
    counts[:, 0::2], counts[:, 1::2] = packed & 15, packed >> 4
    return counts


def by_band(earlier: pa.ListArray) -> np.ndarray:
    """A row of bucket keys by band for each list of (band, bucket); 0 where there is none."""
    at, flat = np.repeat(np.arange(len(earlier)), earlier.value_lengths().to_numpy()), earlier.flatten()
    band = flat.field(0).to_numpy()
    out = np.zeros((len(earlier), int(band.max(initial=0)) + 1), np.int64)
    out[at, band] = flat.field(1).to_numpy()
    return out


def close(block: np.ndarray, ident: np.ndarray, of: np.ndarray, words: np.ndarray, bags: np.ndarray, earlier: np.ndarray, i: int, j: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members of blocks i and j, of different classes and without a bucket of an earlier band in common, whose distance the bounds leave within reach."""
    order = np.argsort(words, kind="stable")
    ident, of, words, bags, earlier, block = ident[order], of[order], words[order], bags[order], earlier[order], block[order]
    ours, theirs = np.flatnonzero(block == i), np.flatnonzero(block == j)
    if len(ours) > len(theirs):
        ours, theirs = theirs, ours
    sizes = words[theirs]
    for x in ours.tolist():
        n = int(words[x])
        from_, to = np.searchsorted(sizes, [n * similarity - 1e-6, n / similarity + 1e-6], side="left")
        other = theirs[from_:to]
        other = other[(of[other] != of[x]) & (ident[other] > ident[x])] if i == j else other[of[other] != of[x]]
        # an edit takes one word out of a cell, puts one into a cell, or both; of pairs of words, two at most
        for at, reach in ((slice(None, CELLS), 1), (slice(CELLS, None), 2)):
            if not len(other):
                break
            mine, theirs_bag = bags[x, at], bags[other, at]
            most = reach * ((1 - similarity) * np.maximum(words[other], n) + 1e-9).astype(np.int64)
            union = np.maximum(mine, theirs_bag)
            other = other[((union - mine).sum(axis=1, dtype=np.int64) <= most) & ((union - theirs_bag).sum(axis=1, dtype=np.int64) <= most)]
        if len(other) and len(bands := np.flatnonzero(earlier[x])):
            other = other[~(earlier[np.ix_(other, bands)] == earlier[x, bands]).any(axis=1)]
        if len(other):
            yield np.minimum(ident[x], ident[other]), np.maximum(ident[x], ident[other])


def _close(meetings: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs a, b that the bounds do not rule out."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            whole = pa.concat_tables(parts).combine_chunks()
            columns = [whole.column(k).to_numpy() for k in range(7)]
            for a, b in close(*columns[3:], unpacked(whole.column(7).to_pylist()), by_band(whole.column(8).combine_chunks()), int(columns[1][0]), int(columns[2][0]), similarity):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        parts, last = [], None
        for frame in frames:  # sorted by meeting, of which one is held at a time
            keys = list(zip(*(frame.column(k).to_pylist() for k in range(3)), strict=True))
            starts = [n for n in range(len(keys)) if not n or keys[n] != keys[n - 1]]
            for at, end in zip(starts, [*starts[1:], len(keys)], strict=True):
                if parts and keys[at] != last:
                    yield from settled(parts)
                    parts = []
                last = keys[at]
                parts.append(pa.Table.from_batches([frame.slice(at, end - at)]))
        if parts:
            yield from settled(parts)

    return meetings.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "a long, b long").distinct()


def keep_first(docs: DataFrame, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with one row of each class, that of its smallest id; rows without an id stay, and of rows without a word one an id.

    A row is told by its id and its words, so of an id with several texts only those go whose class has an earlier row.
    """
    found = written(_members(docs, similarity, None, id_column, text_column), "members-of-classes")
    by_id = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("is_first").alias("any"))
    gone = written(by_id.where("not any").select(F.col("doc_id").alias("_gone")), "gone")
    many = by_id.where("any and n > 1").select(F.col("doc_id").alias("_many"))
    key = docs[id_column].cast("long")
    sieve = Sieve(gone)  # most rows stay without being moved
    kept = sieve.held_back(docs, key).union(sieve.through(docs, key).join(gone, key == gone["_gone"], "left_anti"))
    if many.limit(1).count() == 0:  # no id is repeated, so no text need move
        return kept

    @F.pandas_udf("binary")
    def digests(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: digest_of(normalise(t)) or b"")

    several = kept.join(many, key == many["_many"], "left_semi").withColumn("_digest", digests(F.col(text_column)))
    first = found.where("is_first").select(F.col("doc_id").alias("_first"), F.coalesce("digest", F.lit(b"")).alias("_own")).distinct()
    several = several.join(first, (several[id_column].cast("long") == first["_first"]) & (several["_digest"] == first["_own"]), "left_semi")
    return kept.join(many, key == many["_many"], "left_anti").unionByName(several.dropDuplicates([id_column, "_digest"]).drop("_digest"))
