"""Duplicate rows: exact, by fingerprint, by token sets, and by string similarity with blocking."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions.strings import SIMILARITIES, fingerprint
from sievelake.operators.base import Action, ParameterizedAction, ParamSpec
from sievelake.plans.components import connected_components
from sievelake.plans.shared import forget, written

log = logging.getLogger(__name__)

#: Cells in which characters are counted; several share one, which only makes bounds wider.
CELLS = 64

#: Cells in which tokens are counted.
TOKEN_CELLS = 1 << 20


def kept_only(df: DataFrame, by: list[Column], order: list[str], keep: str | bool, instead: dict[str, Column] | None = None) -> DataFrame:
    """One row of each group, by the order of the row key; keep=False: only groups of one. `instead`: aggregates in place of columns.

    The row that stays is an aggregate, so a group of copies shrinks to one before anything moves.
    """
    row, at = F.struct(*(F.col(f"`{c}`") for c in df.columns)), F.struct(*(F.col(f"`{c}`") for c in order))
    stays = F.max_by(row, at) if keep == "last" else F.min_by(row, at)
    named = instead or {}
    found = df.groupBy(*(x.alias(f"_g{i}") for i, x in enumerate(by))).agg(stays.alias("_row"), F.count(F.lit(1)).alias("_n"), *(e.alias(f"_i_{c}") for c, e in named.items()))
    found = found.where("_n = 1") if keep is False else found
    return found.select(*(F.col(f"_i_{c}").alias(c) if c in named else F.col(f"_row.`{c}`").alias(c) for c in df.columns))


class _Keyed(Action):
    """Operators that need a row key: what is first and last follows it."""

    def _order(self, df) -> list[str]:
        key = self.params.get("key")
        if key is None:
            return df.columns
        return [key] if isinstance(key, str) else list(key)

    def _keep(self):
        keep = self.params["keep"]
        if keep not in ("first", "last", False):
            log.warning("keep=%r is none of first, last, False; taken as first", keep)
            return "first"
        return keep


class ExactDeduplicator(_Keyed):
    """Nulls are equal; rows without columns to compare all stay."""

    DEFAULTS = {"keep": "first", "key": None}

    def apply(self, df, columns, stats):
        keys = set(self._order(df)) if self.params["key"] else set()
        by = [c for c in columns if c not in keys or self.columns]
        return kept_only(df, [F.col(f"`{c}`") for c in by], self._order(df), self._keep()) if by else df


class FingerprintDeduplicator(_Keyed):
    """Rows whose columns have equal token fingerprints; `ascii` keeps to built-in functions."""

    DEFAULTS = {"keep": "first", "key": None, "ascii": False}

    def apply(self, df, columns, stats):
        from sievelake.functions.strings import ascii_fingerprint

        make = ascii_fingerprint if self.params["ascii"] else fingerprint
        own = [c for c in columns if c not in set(self._order(df)) or self.columns]
        by = F.concat_ws("|", *(make(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in own))
        return kept_only(df.withColumn("_f", by), [F.col("_f")], self._order(df), self._keep()).drop("_f")


class RoundedDeduplicator(_Keyed):
    """Rows equal after rounding; with a label, the survivor takes its group's most frequent label."""

    DEFAULTS = {"keep": "first", "key": None, "decimals": 6, "label": None}
    NUMERIC_ONLY = True

    def apply(self, df, columns, stats):
        own = [c for c in columns if c not in (self.params["label"], *(self._order(df) if self.params["key"] else ()))]
        by = [F.round(F.col(f"`{c}`").cast("double"), self.params["decimals"]) for c in own]
        label = self.params["label"]
        return kept_only(df, by, self._order(df), self._keep(), {label: F.mode(F.col(f"`{label}`"), True)} if label else None)


def drop_linked(df: DataFrame, key: str, links: DataFrame, keep: str | bool) -> DataFrame:
    """One row (or none) of each component of the links (a, b) between row keys."""
    found = connected_components(links)
    if keep is False:
        gone = found.select("node")
    elif keep == "last":
        last = found.groupBy("component").agg(F.max("node").alias("last"))
        gone = found.join(last, "component").where("node <> last").select("node")
    else:
        gone = found.where("node <> component").select("node")
    return df.join(gone, df[key] == gone["node"], "left_anti")


def token_sets(df: DataFrame, key: str, text: Column) -> DataFrame:
    return df.select(F.col(key).alias("k"), F.array_remove(F.array_distinct(F.split(F.trim(F.lower(text)), r"\s+")), "").alias("tokens")).where("size(tokens) > 0")


def first_of_equal(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k, h, d, n) of the sets, written: hashes of the tokens in order and a digest of them; and (d, first, copies) of those that occur.

    Tokens are told apart by 64-bit hashes, half and less of what they take as strings; sets are told apart by their digests alone.
    """
    own = sets.select("k", F.sort_array(F.transform("tokens", lambda t: F.xxhash64(t))).alias("h"))
    sets = written(own.withColumns({"d": F.unhex(F.sha2(F.col("h").cast("string"), 256)), "n": F.size("h")}), "sets")
    return sets, written(sets.groupBy("d").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("copies")), "firsts")


def equal_links(sets: DataFrame, firsts: DataFrame) -> DataFrame:
    return sets.select("k", "d").join(firsts.where("copies > 1").select("d", "first"), "d").where("k <> first").select(F.col("first").alias("a"), F.col("k").alias("b"), F.lit(1.0).alias("jaccard"))


def rarest(sets: DataFrame, threshold: float) -> DataFrame:
    """k, d, n, prefix: place and hash of the size - ceil(threshold * size) + 1 rarest tokens of each set, less those that occur once.

    Any order that all sets share will do, so tokens are ordered by how often their cell of hashes occurs: a table of bounded size
    that every task holds, in place of a join with the tokens' counts.
    """
    often = np.zeros(TOKEN_CELLS, np.int64)
    found = sets.select(F.explode("h").alias("h")).groupBy(F.pmod("h", F.lit(TOKEN_CELLS)).alias("cell")).agg(F.count(F.lit(1)).alias("c")).toArrow()
    often[found["cell"].to_numpy()] = found["c"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(often)
    key = sets.schema["k"].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            h, n = batch.column(3).flatten().to_numpy(), batch.column(2).to_numpy()
            row, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
            c = shared.value[h % TOKEN_CELLS]
            order = np.lexsort((h, c, row))
            h, c, place = h[order], c[order], np.arange(len(h)) - start[row] + 1
            stays = (place <= (n - np.ceil((threshold - 1e-12) * n) + 1)[row]) & (c > 1)
            ends = np.concatenate(([0], np.cumsum(np.bincount(row[stays], minlength=len(n)))))
            entries = pa.StructArray.from_arrays([pa.array(place[stays], pa.int32()), pa.array(h[stays], pa.int64())], ["r", "t"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)], ["k", "d", "n", "prefix"])

    return sets.select("k", "d", "n", "h").mapInArrow(run, f"k {key}, d binary, n int, prefix array<struct<r: int, t: bigint>>")


def jaccard_links(sets: DataFrame, threshold: float) -> DataFrame:
    """a < b, jaccard of all pairs of token sets at least that similar; exact.

    Two such sets share one of their rarest tokens: each set is indexed under its size - ceil(threshold * size) + 1 rarest only,
    so frequent tokens bring no pairs together. Where the first of them stands bounds what the two can share. Equal sets are
    compared once, by their first key.
    """
    sets, firsts = first_of_equal(sets)
    return verified(sets, firsts, near_pairs(sets, threshold), threshold).unionByName(equal_links(sets, firsts))


def near_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """a < b of the pairs of first sets that may be as similar."""
    least = F.lit(threshold - 1e-12)
    one = rarest(sets, threshold).groupBy("d").agg(F.min(F.struct("k", "n", "prefix")).alias("s"))
    index = written(one.select("s.k", "s.n", F.explode("s.prefix").alias("e")).select("k", "n", "e.r", "e.t"), "rarest")
    a, b = index.alias("a"), index.alias("b")
    sized = F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * least
    enough = 1 + F.least(F.col("a.n") - F.col("a.r"), F.col("b.n") - F.col("b.r")) >= least / (1 + least) * (F.col("a.n") + F.col("b.n")) - 1e-9
    return a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.k") < F.col("b.k")) & sized & enough).select(F.col("a.k").alias("a"), F.col("b.k").alias("b")).distinct()


def verified(sets: DataFrame, firsts: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs with their similarity, of those that reach it.

    Only sets of some pair meet the pairs, and these go in slices of about as many as there are such sets, so that what moves at
    once does not grow with the pairs.
    """
    pairs = written(pairs, "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    near = sets.join(ends, "k", "left_semi").join(firsts.select("d", F.col("first").alias("k")), ["d", "k"], "left_semi")
    near = written(near.dropDuplicates(["k", "d"]).select("k", "h"), "near")
    common = F.size(F.array_intersect("ta", "tb"))
    slices = max(1, -(-pairs.count() // max(1, near.count())))
    found = []
    for i in range(slices):
        own = lambda k: F.pmod(F.xxhash64(k), F.lit(slices)) == i  # noqa: B023, E731
        left, right = near.where(own("k")).select(F.col("k").alias("a"), F.col("h").alias("ta")), near.select(F.col("k").alias("b"), F.col("h").alias("tb"))
        met = pairs.where(own("a")).join(left, "a").join(right, "b").withColumn("jaccard", common / (F.size("ta") + F.size("tb") - common))
        found.append(written(met.where(F.col("jaccard") >= threshold - 1e-12).select("a", "b", "jaccard"), "links"))
    forget(near)
    return reduce(DataFrame.unionByName, found)


def band_rows(threshold: float, num_perm: int, recall: float = 0.97) -> int:
    """The most rows a band may have so that pairs at the threshold still share a band with the given probability."""
    return max((r for r in range(1, num_perm + 1) if 1 - (1 - threshold**r) ** (num_perm // r) >= recall), default=1)


def least_hashes(h: np.ndarray, starts: np.ndarray, seeds: int) -> np.ndarray:
    """For runs of hashes the least of Spark's xxhash64 of token and seed, a column a seed; h are the tokens' own xxhash64."""
    first, second, third, fifth = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    base, out = h.view(np.uint64) + fifth + np.uint64(4), np.empty((len(starts), seeds), np.int64)
    with np.errstate(over="ignore"):
        for i in range(seeds):
            x = base ^ np.uint64(i) * first
            x = (x << np.uint64(23) | x >> np.uint64(41)) * second + third
            for shift, factor in ((33, second), (29, third)):
                x ^= x >> np.uint64(shift)
                x *= factor
            x ^= x >> np.uint64(32)
            out[:, i] = np.minimum.reduceat(x.view(np.int64), starts)
    return out


def signatures(sets: DataFrame, seeds: int) -> DataFrame:
    """k, d, n, s: the least hashes of each set under every seed."""
    key = sets.schema["k"].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                n = part.column(2).to_numpy()
                found = least_hashes(part.column(3).flatten().to_numpy(), np.cumsum(n) - n, seeds)
                s = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * seeds, pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], s], ["k", "d", "n", "s"])

    return sets.select("k", "d", "n", "h").mapInArrow(run, f"k {key}, d binary, n int, s array<bigint>")


def lsh_links(sets: DataFrame, threshold: float, num_perm: int = 128, most: int = 64) -> DataFrame:
    """a < b, jaccard of pairs of token sets at least that similar which share a band of their hash signatures; every pair is verified.

    Signatures are least hashes of the tokens under `num_perm` seeds, bands of them are keys of an equi-join. Equal sets are
    compared once. The members of a bucket of over `most` different sets are not paired there: they go through the exact join,
    which frequent tokens do not slow, so no bucket is expanded into all its pairs and none is cut.
    """
    sets, firsts = first_of_equal(sets)
    rows = band_rows(threshold, num_perm)
    bands = F.transform(F.sequence(F.lit(0), F.lit(num_perm // rows - 1)), lambda b: F.xxhash64(F.slice("s", b * rows + 1, F.lit(rows)), b))
    signed = signatures(sets, num_perm // rows * rows).select("k", "d", "n", bands.alias("bands"))
    one = signed.groupBy("d").agg(F.min(F.struct("k", "n", "bands")).alias("s"))
    index = written(one.select("s.k", "s.n", F.explode("s.bands").alias("bucket")), "bands")
    sizes = written(index.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "buckets")
    few = index.join(sizes.where(F.col("c") <= most).select("bucket"), "bucket")
    a, b = few.alias("a"), few.alias("b")
    pairs = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.k") < F.col("b.k")) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * F.lit(threshold - 1e-12))).select(F.col("a.k").alias("a"), F.col("b.k").alias("b"))
    crowded = written(index.join(sizes.where(F.col("c") > most).select("bucket"), "bucket", "left_semi").select("k").distinct(), "crowded")
    if crowded.limit(1).count():
        many = written(sets.join(crowded, "k", "left_semi"), "crowded-sets")
        pairs = pairs.unionByName(near_pairs(many, threshold))
    return verified(sets, firsts, pairs.distinct(), threshold).unionByName(equal_links(sets, firsts))


class JaccardSimilarityDeduplicator(_Keyed):
    """Rows whose token sets are similar, and what they link together; every pair is verified, none is only estimated.

    `method` is `exact` (all pairs at the threshold) or `lsh` (those that share a band of `num_perm` hashes, 0.97 or more of
    those at the threshold itself). `combine_columns` is accepted for the interface.
    """

    DEFAULTS = {"threshold": 0.8, "num_perm": 128, "tokenizer": None, "combine_columns": True, "keep": "first", "key": None, "method": "exact"}

    def links(self, df: DataFrame, columns: list[str]) -> DataFrame:
        key = self._order(df)[0]
        own = [c for c in columns if c != key]
        if tokenizer := self.params["tokenizer"]:
            split = F.pandas_udf(lambda s: s.map(lambda t: sorted(set(tokenizer(t))) if t is not None else []), "array<string>")
            sets = df.select(F.col(key).alias("k"), split(F.concat_ws(" ", *own)).alias("tokens")).where("size(tokens) > 0")
        else:
            sets = token_sets(df, key, F.concat_ws(" ", *(F.col(f"`{c}`").cast("string") for c in own)))
        if self.params["method"] not in ("exact", "lsh"):
            raise ValueError("method is exact or lsh")
        return lsh_links(sets, self.params["threshold"], self.params["num_perm"]) if self.params["method"] == "lsh" else jaccard_links(sets, self.params["threshold"])

    def apply(self, df, columns, stats):
        if not columns:
            return df
        return drop_linked(df, self._order(df)[0], self.links(df, columns), self._keep())


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of characters by cell, and lengths; of nulls 0."""
    bags = np.zeros((len(texts), CELLS), np.int32)
    for i, t in enumerate(texts):
        if t:
            bags[i] = np.bincount(np.frombuffer(t.encode("utf-32-le"), np.uint32) % CELLS, minlength=CELLS)
    return bags, bags.sum(1)


def at_most(kind: str, common: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """No more than this is the similarity of texts of these lengths with so many characters in common.

    An edit distance is at least the longer length less the common characters; no more of them can match or stand in one order.
    """
    longer = np.maximum(np.maximum(m, n), 1)
    if kind == "jarowinkler":
        jaro = np.where(common > 0, (common / np.maximum(m, 1) + common / np.maximum(n, 1) + 1) / 3, 0.0)
        return np.where((m == 0) & (n == 0), 1.0, np.where(jaro > 0.7, jaro + 0.4 * (1 - jaro), jaro))
    if kind == "token_sort":
        return np.where(m + n > 0, 2 * common / np.maximum(m + n, 1), 1.0)
    return np.where(m + n > 0, common / longer, 1.0)


def block_pairs(rows: DataFrame, score, threshold: float, block_rows: int = 1024, kind: str | None = None, least=None) -> DataFrame:
    """a < b, similarity of rows (k, v: array<string>) by a Python function; every block meets every other once, in tasks of two blocks.

    With a `kind` of similarity only pairs are scored whose lengths and common characters let them reach the threshold (or
    least(m, n), a number by their lengths) in every column; all others are ruled out by whole blocks of numbers.
    """
    rows = written(rows, "blocks")
    blocks = max(1, -(-rows.count() // block_rows))
    own = rows.withColumn("i", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    ends = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = own.withColumn("j", F.explode(F.filter(ends, lambda j: j >= F.col("i"))))
    # columns of their own on the right: a cogroup takes shared ones of one plan for the left side's
    right = own.select(F.col("k").alias("k"), F.col("v").alias("v"), F.col("i").alias("j")).withColumn("i", F.explode(F.filter(ends, lambda i: i <= F.col("j"))))
    key = rows.schema["k"].dataType.simpleString()

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        same = a.num_rows and b.num_rows and a["i"][0] == a["j"][0]
        ours, theirs = (list(zip(t["k"].to_pylist(), t["v"].to_pylist(), strict=True)) for t in (a, b))
        if kind and ours and theirs:
            read = (lambda t: t and " ".join(sorted(t.split()))) if kind == "token_sort" else (lambda t: t)
            sides = [[characters([read(v[c]) for _, v in side]) for c in range(len(ours[0][1]))] for side in (ours, theirs)]
        for x, (ka, va) in enumerate(ours):
            near = range(len(theirs))
            if kind and theirs:
                reach = np.ones(len(theirs), bool)
                for (bags, sizes), (other, others) in zip(*sides, strict=True):
                    common = np.minimum(other, bags[x]).sum(1)
                    reach &= at_most(kind, common, sizes[x], others) >= (threshold if least is None else least(sizes[x], others)) - 1e-9
                near = np.flatnonzero(reach).tolist()
            for kb, vb in (theirs[y] for y in near):
                if (not same or ka < kb) and (s := score(va, vb, threshold)) is not None:
                    for column, x in zip(out, (min(ka, kb), max(ka, kb), s), strict=True):
                        column.append(x)
        k = a.schema.field("k").type
        return pa.table({"a": pa.array(out[0], k), "b": pa.array(out[1], k), "similarity": pa.array(out[2], pa.float64())})

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, f"a {key}, b {key}, similarity double")


def _all_columns(similarity):
    """The least similarity over the columns if each reaches the threshold; a null matches nothing."""

    def score(a, b, threshold):
        least = 1.0
        for x, y in zip(a, b, strict=True):
            if x is None or y is None or (s := similarity(x, y)) < threshold:
                return None
            least = min(least, s)
        return least

    return score


class ApproximateDeduplicator(_Keyed):
    """Rows whose columns are all similar, and what they link together.

    Candidates: all pairs in blocks (`full`), pairs of equal blocking value (`block`), or of neighbouring blocking values in
    sorted order (`sortedneighbourhood`). Rows with equal columns are compared once, by their first key.
    """

    DEFAULTS = {"threshold": 0.85, "comparison_type": "jarowinkler", "keep": "first", "blocking_col": None, "indexing_method": "auto", "max_rows_limit": 10000, "key": None}

    def links(self, df: DataFrame, columns: list[str]) -> DataFrame:
        key, blocking, how = self._order(df)[0], self.params["blocking_col"], self.params["indexing_method"]
        threshold = self.params["threshold"]
        score = _all_columns(SIMILARITIES[self.params["comparison_type"]])
        if blocking is not None and blocking not in df.columns:
            log.warning("blocking column %s is missing; all pairs are compared", blocking)
            blocking = None
        if how == "auto":
            how = "block" if blocking else "full"
        own = [c for c in columns if c != key]
        rows = df.select(F.col(key).alias("k"), F.array(*(F.col(f"`{c}`").cast("string") for c in own)).alias("v"), *([F.col(blocking).alias("g")] if blocking else []))
        by = ["v", "g"] if blocking else ["v"]
        full = rows.where(~F.exists("v", lambda x: x.isNull()))
        first = written(full.groupBy(*by).agg(F.min("k").alias("k")), "firsts")
        equal = full.join(first.withColumnRenamed("k", "a"), by).where("k <> a").select("a", F.col("k").alias("b"), F.lit(1.0).alias("similarity"))
        if not blocking or how == "full":
            return block_pairs(first.select("k", "v"), score, threshold, kind=self.params["comparison_type"]).unionByName(equal)
        if how == "sortedneighbourhood":
            from sievelake.operators.scale import ranked

            places = ranked(first.where("g is not null").select("g").distinct(), "g")
            named = first.join(places, "g").withColumn("s", F.explode(F.array("rank", F.col("rank") + 1)))
        else:
            named = first.where("g is not null").withColumn("s", F.col("g"))
        a, b = named.alias("a"), named.alias("b")
        met = a.join(b, (F.col("a.s") == F.col("b.s")) & (F.col("a.k") < F.col("b.k"))).select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), F.col("a.v").alias("va"), F.col("b.v").alias("vb")).distinct()
        @F.pandas_udf("double")
        def similarity(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([score(p, q, threshold) for p, q in zip(x, y, strict=True)], dtype="float64")

        return met.select("a", "b", similarity("va", "vb").alias("similarity")).where(F.col("similarity") >= threshold).unionByName(equal)

    def apply(self, df, columns, stats):
        if self.params["max_rows_limit"] and self.params["blocking_col"] is None and df.limit(self.params["max_rows_limit"] + 1).count() > self.params["max_rows_limit"]:
            log.warning("more than %d rows without a blocking column: all pairs are compared, in blocks", self.params["max_rows_limit"])
        return drop_linked(df, self._order(df)[0], self.links(df, columns), self._keep())


class TokenSortDeduplicator(ApproximateDeduplicator):
    """Token-sort ratio over all columns joined by spaces."""

    DEFAULTS = ApproximateDeduplicator.DEFAULTS | {"comparison_type": "token_sort"}

    def links(self, df, columns):
        key = self._order(df)[0]
        own = [c for c in columns if c != key]
        joined = df.select(F.col(key), F.lower(F.concat_ws(" ", *(F.col(f"`{c}`").cast("string") for c in own))).alias("_text"))
        return super().links(joined, [key, "_text"])


class RowStringDeduplicator(ApproximateDeduplicator):
    """Whole rows as strings by a metric: DL, LM (edits below threshold times the mean length) or JW (similarity at least the threshold)."""

    DEFAULTS = {"threshold": 0.6, "metric": "DL", "keep": "first", "key": None, "max_rows_limit": 10000, "blocking_col": None}

    def links(self, df, columns):
        from sievelake.functions.strings import damerau, damerau_free, jaro_winkler

        key, metric = self._order(df)[0], self.params["metric"]
        edits = {"DL": damerau, "LM": damerau_free}.get(metric)

        def score(a, b, threshold):
            a, b = a[0], b[0]
            if edits is None:
                return s if (s := jaro_winkler(a, b)) >= threshold else None
            most = (len(a) + len(b)) / 2
            return 1 - d / max(most, 1) if (d := edits(a, b)) < most * threshold else None

        own = [c for c in columns if c != key]
        rows = df.select(F.col(key).alias("k"), F.array(F.concat_ws(" ", *(F.col(f"`{c}`").cast("string") for c in own))).alias("v"))
        # edits under (m + n) / 2 * t are a similarity, by the longer length, of over 1 - (m + n) / (2 * longer) * t
        share = self.params["threshold"]
        least = None if edits is None else lambda m, n: 1 - (m + n) / (2 * np.maximum(np.maximum(m, n), 1)) * share
        return block_pairs(rows, score, share, kind="jarowinkler" if edits is None else "levenshtein", least=least)


class ParameterizedDeduplicator(ParameterizedAction, _Keyed):
    PARAM_SPECS = (ParamSpec("keep", "categorical", choices=("first", "last", False), default="first"), ParamSpec("subset", "categorical", choices=("all", "numeric"), default="all"))

    def apply(self, df, columns, stats):
        own = self.select_columns(df, numeric_only=True) if self.params["subset"] == "numeric" else columns
        return ExactDeduplicator(columns=own, keep=self.params["keep"], key=self.params.get("key")).transform(df)
