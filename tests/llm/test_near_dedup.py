import random
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sievelake.llm import near_dedup
from tests.llm.conftest import prose


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=20), st.lists(st.integers(0, 3), max_size=20), st.integers(0, 12))
def test_banded_alignment(a, b, most):
    d = edits(a, b)
    assert near_dedup.edits_within(a, b, most) == (d if d <= most else None)


def changed(text, share, seed):
    rng = random.Random(seed)
    return " ".join("qqq" + str(rng.randrange(99)) if rng.random() < share else w for w in text.split())


def brute(texts):
    """Components of word sequences whose edit similarity is at least 0.8."""
    words = [near_dedup.normalise(t) for t in texts]
    label = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if words[i] and words[j] and edits(words[i], words[j]) <= int(0.2 * max(len(words[i]), len(words[j])) + 1e-9):
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    return label


def substituted(words, share, seed):
    rng, out = random.Random(seed), list(words)
    for i in rng.sample(range(len(out)), int(share * len(out) + 1e-9)):
        out[i] = "q" + str(rng.randrange(99999))
    return out


def test_usual_sketch_finds_scattered_edits():
    usual, brief = near_dedup.Sketcher(), near_dedup.Sketcher(k=2, entries=64, seed=8)

    def keys(words):
        first, own = near_dedup.banded(words, usual, brief, 0.8)
        return set(enumerate(own.tolist(), first))

    for n in (8, 10, 12, 15, 20, 25, 30, 39, 40, 48, 60, 200):
        for share, least in ((0.1, 0.99), (0.15, 0.95), (0.2, 0.9)):  # 0.2: the least similarity itself
            met = [bool(keys(a) & keys(substituted(a, share, seed))) for seed in range(100) for a in [prose(seed, n).split()]]
            assert sum(met) >= least * len(met), (n, share)
    for n in range(34, 56):  # words left out, across the border of short texts
        met = [bool(keys(a) & keys([w for i, w in enumerate(a) if i not in set(random.Random(seed).sample(range(n), n // 5))])) for seed in range(50) for a in [prose(seed, n).split()]]
        assert sum(met) >= 0.9 * len(met), n


def test_classes_against_brute_force(spark, make_docs):
    base = [prose(i, 80) for i in range(8)]
    shared = prose(99, 30)
    texts = base + [changed(t, 0.03, i) for i, t in enumerate(base[:5])] + [changed(base[0], 0.04, s) for s in range(20)] + base[:3]
    texts += [shared + " " + prose(200 + i, 90) for i in range(6)] + [None, "", "!!!", "one two", "One, two."] + [prose(5, 3000), changed(prose(5, 3000), 0.02, 1)]
    dense = near_dedup.Sketcher(entries=128, rows=1)  # so that hashing misses no pair and the rest must agree exactly
    got = {r.doc_id: r.class_id for r in near_dedup.classes(make_docs(texts, extra=True), sketcher=dense).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_registered_sketch_against_brute_force(spark, make_docs):
    texts = [prose(i, 60) for i in range(12)] + [" ".join(substituted(prose(i, 60).split(), 0.1 + 0.01 * i, i)) for i in range(8)]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(make_docs(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=30), st.lists(st.integers(0, 6), min_size=1, max_size=30), st.sampled_from([0.5, 0.7, 0.8]))
def test_bounds_rule_out_no_similar_pair(a, b, similarity):
    a, b = [str(x) for x in a], [str(x) for x in b]
    sketcher = near_dedup.Sketcher()
    bags = near_dedup.unpacked([sketcher.bag(a), sketcher.bag(b)])
    for blocks, i, j in (([0, 0], 0, 0), ([3, -1], 3, -1)):
        met = list(near_dedup.close(np.array(blocks), np.array([7, 9]), np.array([7, 9]), np.array([len(a), len(b)]), bags, np.array([[0, 5], [0, 6]]), i, j, similarity))
        assert met or not near_dedup.similar(a, b, similarity)
        assert not list(near_dedup.close(np.array(blocks), np.array([7, 9]), np.array([7, 9]), np.array([len(a), len(b)]), bags, np.array([[0, 5], [0, 5]]), i, j, similarity))
    assert near_dedup.similar(a, b, similarity) == (edits(a, b) <= int((1 - similarity) * max(len(a), len(b)) + 1e-9))


def test_outsiders_of_a_large_class_are_compared(spark, make_docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    base = prose(1, 60)
    texts = [changed(base, 0.12, s) for s in range(12)]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(make_docs(texts), sketcher=near_dedup.Sketcher(entries=128, rows=1)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_more_unlike_members_in_a_bucket_than_a_block(spark, make_docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    shared = prose(77, 30)
    texts = [shared + " " + prose(400 + i, 60) for i in range(8)]
    texts += [changed(texts[5], 0.1, 1), changed(texts[7], 0.1, 2)]
    members = spark.createDataFrame([(1, 0, i, 90) for i in range(10)], "bucket long, band int, id long, words int")
    labels = spark.createDataFrame([(5, 5), (8, 5), (7, 7), (9, 7)], "node long, component long")
    counts = spark.createDataFrame([(i, 90, b"") for i in range(10)], "id long, words int, bag binary")
    met = near_dedup._blocks(members, labels, counts).collect()
    groups = {}
    for r in met:
        groups.setdefault((r.i, r.j), []).append(r)
    class_of = {i: {8: 5, 9: 7}.get(i, i) for i in range(10)}
    pairs = [frozenset((x.id, y.id)) for (i, j), own in groups.items() for x in own for y in own if x.block == i and y.block == j and (i != j or x.id < y.id)]
    assert len(pairs) == len(set(pairs)) and set(pairs) >= {frozenset((x, y)) for x, y in combinations(range(10), 2) if class_of[x] != class_of[y]}
    got = {r.doc_id: r.class_id for r in near_dedup.classes(make_docs(texts), sketcher=near_dedup.Sketcher(entries=128, rows=1)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_short_texts_against_brute_force(spark, make_docs):
    base = [prose(i, 8 + 2 * i) for i in range(16)]
    texts = base + [" ".join(substituted(t.split(), 0.2, i)) for i, t in enumerate(base)] + ["one two three four five", "one two three four six"]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(make_docs(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_an_id_of_several_texts(spark, make_docs):
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(1, a), (2, a + " tail"), (2, b), (3, c), (4, b + " end"), (6, None), (6, ""), (6, c + " more"), (None, a)]
    docs = make_docs(rows, extra=True)
    got = sorted((r.doc_id, r.class_id) for r in near_dedup.classes(docs).collect())
    assert got == [(1, 1), (2, 1), (2, 2), (3, 3), (4, 2), (6, 3), (6, 6), (6, 6)]
    kept = near_dedup.keep_first(docs)
    assert sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str) == sorted([(1, a), (2, b), (3, c), (6, ""), (None, a)], key=str) and kept.columns == docs.columns


def test_keep_first(spark, make_docs):
    docs = make_docs([(5, prose(1, 50)), (3, prose(1, 50)), (3, prose(1, 50)), (9, prose(2, 50)), (7, None), (8, None)])
    kept = near_dedup.keep_first(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 8, 9] and kept.columns == docs.columns
    assert near_dedup.keep_first(docs.limit(0)).count() == 0


def _shuffled(spark, plan_of) -> str:
    """The plan as it is where no table is small enough for Spark to broadcast by itself."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("-1", "false"), strict=True):
            spark.conf.set(n, v)
        return plan_of()._jdf.queryExecution().executedPlan().toString()
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)


def test_texts_that_are_not_needed_do_not_move(spark, make_docs):
    docs = make_docs([prose(i, 50) for i in range(20)])
    digest = near_dedup.digest_of(near_dedup.normalise(prose(3, 50)))
    needed = spark.createDataFrame([(7, 3, bytearray(digest))], "id long, doc_id long, digest binary")
    texts = lambda: near_dedup._texts(docs, needed, near_dedup.Sketcher(), "doc_id", "text")
    assert [(r["id"], r["words"], r["text"]) for r in texts().collect()] == [(7, 50, prose(3, 50))]
    plan = _shuffled(spark, texts)
    read = plan[plan.index("MapInArrow") :].partition("FileScan parquet")[0]
    assert "hashpartitioning" not in read


def test_rows_that_stay_do_not_move(spark, make_docs):
    docs = make_docs([*(prose(i, 50) for i in range(6)), prose(2, 50), (None, prose(1, 50))])
    kept = lambda: near_dedup.keep_first(docs)
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept().select("doc_id").collect()) == [*((False, i) for i in range(6)), (True, None)]
    lines = _shuffled(spark, kept).splitlines()
    stays = [x for x in lines[1:] if x.startswith(":")]
    assert lines[0].strip() == "Union" and stays and not any("hashpartitioning" in x for x in stays)
