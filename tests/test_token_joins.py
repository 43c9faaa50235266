"""Joins of token sets: what moves is bounded, and the pairs are those of all pairs."""

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from sievelake.operators import dedup


def _sets(spark):
    rng = np.random.default_rng(3)
    rows = [(0, ["a", "b"]), (1, ["b", "a"])]
    for i in range(2, 80, 2):
        words = sorted({f"w{int(x)}" for x in rng.zipf(1.3, 40) % 300})
        rows += [(i, words), (i + 1, words[1:] + ["more"])]
    return rows, spark.createDataFrame(rows, "k long, tokens array<string>")


def test_only_the_rarest_tokens_are_indexed(spark):
    """F1, dedup_jaccard: every token of every set went through joins and windows, at several times the texts' size."""
    rows, df = _sets(spark)
    sets, firsts = dedup.first_of_equal(df)
    held = {r.k: len(r.prefix) for r in dedup.rarest(sets, 0.8).collect()}
    assert all(held[k] <= len(t) - int(np.ceil(0.8 * len(t) - 1e-9)) + 1 for k, t in rows)
    jaccard = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    firsts_of = {tuple(sorted(t)): min(k for k, o in rows if sorted(o) == sorted(t)) for _, t in rows}
    first = {k: t for k, t in rows if firsts_of[tuple(sorted(t))] == k}
    want = {(a, b) for a, b in combinations(sorted(first), 2) if jaccard(first[a], first[b]) >= 0.8} | {(firsts_of[tuple(sorted(t))], k) for k, t in rows if k not in first}
    assert {(r.a, r.b) for r in dedup.jaccard_links(df, 0.8).collect()} == want


def test_signatures_are_those_of_sparks_hash(spark):
    """F5, dedup_lsh_documents: the least hashes are found a seed at a time over whole batches, and are the same."""
    _, df = _sets(spark)
    sets, _ = dedup.first_of_equal(df)
    least = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.array_min(F.transform("tokens", lambda t: F.xxhash64(t, i))))
    assert {r.k: r.s for r in dedup.signatures(sets, 10).collect()} == {r.k: r.s for r in df.select("k", least.alias("s")).collect()}
