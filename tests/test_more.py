"""Rows that stay, pairs that bounds rule out, fronts, linkage, mixtures, and state on streams, each against a plain version."""

import datetime
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.functions import strings
from sievelake.operators import dedup, evaluate
from sievelake.plans import mixture
from sievelake.streaming import streams


def test_rows_that_stay_are_whole_rows(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([1.0, 2.0, None]), f"n{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "k long, a string, x double, note string").repartition(5)
    for keep in ("first", "last", False):
        want = []
        for _, own in itertools.groupby(sorted(rows, key=lambda r: (str(r[1]), str(r[2]), r[0])), key=lambda r: (r[1], r[2])):
            own = list(own)
            want += own[:1] if keep == "first" else own[-1:] if keep == "last" else own if len(own) == 1 else []
        got = dedup.ExactDeduplicator(columns=["a", "x"], key="k", keep=keep).transform(df)
        assert got.columns == df.columns and sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("kind", ["jarowinkler", "levenshtein", "damerau_levenshtein", "token_sort"])
def test_bounds_rule_out_no_similar_pair(spark, kind):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcd é") for _ in range(rng.randint(0, 12))) for _ in range(50)]
    texts += [f"part {a}{b}" + "x" * rng.randint(0, 9) for a in "12" for b in "3456"]
    similarity = strings.SIMILARITIES[kind]
    read = (lambda t: " ".join(sorted(t.split()))) if kind == "token_sort" else (lambda t: t)
    bags, sizes = dedup.characters([read(t) for t in texts])
    for i, j in itertools.combinations(range(len(texts)), 2):
        bound = dedup.at_most(kind, np.minimum(bags[i], bags[j]).sum(), sizes[i], sizes[j])
        assert similarity(texts[i], texts[j]) <= bound + 1e-9, (texts[i], texts[j])
    rows = spark.createDataFrame([(i, [t]) for i, t in enumerate(texts)], "k long, v array<string>")
    score = dedup._all_columns(similarity)
    assert sorted(dedup.block_pairs(rows, score, 0.7, 16, kind).collect()) == sorted(dedup.block_pairs(rows, score, 0.7, 16).collect())


def test_front_of_three_objectives(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, size=(400, 3)).astype(float)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k long, a double, b double, c double").repartition(6)
    want = {i for i in range(400) if not any((x[j] >= x[i]).all() and (x[j] > x[i]).any() for j in range(400))}
    assert {r.k for r in evaluate.pareto_front(df, "k", ["a", "b", "c"]).collect()} == want


def test_threshold_of_best_f1_is_a_score(spark):
    rng = np.random.default_rng(4)
    rows = [(int(y), float(np.round(y * 0.3 + s, 7))) for y, s in zip(rng.integers(0, 2, 300), rng.random(300), strict=True)]
    got = evaluate.best_f1_threshold(spark.createDataFrame(rows, "label int, score double")).first()

    def f1(t):
        hit = sum(y for y, s in rows if s >= t)
        return 2 * hit / (sum(s >= t for _, s in rows) + sum(y for y, _ in rows))

    best = max(f1(s) for _, s in rows)
    assert got.f1 == pytest.approx(best, abs=1e-12) and got.threshold == min(s for _, s in rows if f1(s) == best)


def plain_linkage(x, k):
    """Mean cosine distance over all pairs, bottom up."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        far = {(a, b): np.mean([1 - u[i] @ u[j] for i in groups[a] for j in groups[b]]) for a, b in itertools.combinations(range(len(groups)), 2)}
        a, b = min(far, key=far.get)
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


def test_average_linkage_equals_all_pairs(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(15, 3)) * 0.2 + c for c in np.eye(3) * 2])
    for k in (2, 3, 5):
        label = evaluate.average_linkage(x / np.linalg.norm(x, axis=1, keepdims=True), np.ones(len(x)), (k,))[0]
        assert {frozenset(np.flatnonzero(label == c).tolist()) for c in set(label.tolist())} == plain_linkage(x, k)
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.concatenate((x, np.repeat(x, 20, axis=0) * 3, np.zeros((2, 3))))], "a double, b double, c double").repartition(4)
    for most in (1000, 30):  # each row a summary of its own, and rows gathered
        score, k = evaluate.AgglomerativeEvaluator(["a", "b", "c"], most=most).evaluate(df)
        assert k == 3 and score > 0.8


def test_gradients_of_the_mixture_by_differences():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 2)) * 3
    x[rng.random(x.shape) < 0.3] = np.nan
    y, w = rng.normal(size=50), rng.normal(size=3)
    c = mixture.Candidates(rng.normal(size=(3, 2)), np.stack([np.stack([np.full(2, -np.inf), np.full(2, np.inf)]), np.array([[-1.0, -2.0], [1.5, 1.0]]), np.array([[-3.0, -3.0], [3.0, 2.5]])]), rng.normal(size=(4, 2)), 0.5 + rng.random((4, 2)))
    logits = {k: rng.normal(size=len(v)) for k, v in mixture.STAGES.items()}
    got = mixture.loss_and_gradients(c, logits, w, x, y)
    loss = lambda lo, ww: mixture.loss_and_gradients(c, lo, ww, x, y)["loss"][0]
    step = 1e-6
    for i in range(3):
        near = [w + s * step * np.eye(3)[i] for s in (1, -1)]
        assert (loss(logits, near[0]) - loss(logits, near[1])) / (2 * step) == pytest.approx(got["w"][i], rel=1e-5, abs=1e-6)
    for k, v in logits.items():
        through = mixture.through_softmax(v, got[k])
        for i in range(len(v)):
            near = [logits | {k: v + s * step * np.eye(len(v))[i]} for s in (1, -1)]
            assert (loss(near[0], w) - loss(near[1], w)) / (2 * step) == pytest.approx(through[i], rel=1e-4, abs=1e-6)


def test_mixture_finds_the_planted_pipeline(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=600) + 4
    wild, gap = rng.random(600) < 0.05, rng.random(600) < 0.3
    y = 2 * np.where(gap, 0.0, x)  # a gap means zero, and a wild value a common one
    seen = np.where(wild, x + 200, x)
    rows = [(i, None if gap[i] else float(seen[i]), float(y[i])) for i in range(600)]
    found = mixture.PipelineMixture(["x"], "y", ["k"], steps=80).fit(spark.createDataFrame(rows, "k long, x double, y double"))
    assert found.chosen["fill"] == "zero" and found.chosen["clamp"] == "iqr" and found.losses[-1] < 0.6 * found.losses[0]


def test_profiles_of_keys_on_a_stream(spark, tmp_path):
    at = lambda minutes: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)
    schema = "u string, t timestamp, v double"
    batches = [[("a", at(0), 1.0), ("a", at(1), 3.0), ("b", at(2), None)], [("a", at(5), 5.0), ("c", at(200), 7.0)], [("a", at(3), 99.0), ("c", at(201), 9.0)], [("c", at(202), 2.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = [tuple(r) for r in streams.run_to_table(streams.running_profiles(stream, "u", "t", "v", "10 minutes", "30 minutes"), "update").collect()]
    last = {r[0]: r for r in sorted(got, key=lambda r: r[1])}
    assert last["c"][1:6] == (3, 6.0, pytest.approx(13**0.5), 2.0, 9.0)
    # a's row of minute 3 came after the watermark had passed it, and a and b were closed
    assert last["a"][1:3] == (3, 3.0) and {r[0] for r in got if r[6]} == {"a", "b"} and last["b"][1] == 0


def test_table_function(spark):
    df = spark.createDataFrame([(1, [1.0, None]), (2, []), (3, None), (4, [2.5])], "k int, x array<double>")
    assert sorted(map(tuple, streams.items(df, "x").collect())) == [(1, 0, 1.0), (1, 1, None), (4, 0, 2.5)]
    assert streams.items(df.limit(0), "x").columns == ["k", "place", "value"]
