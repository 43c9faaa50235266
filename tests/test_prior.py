"""Distances of whole rows against sums over all pairs, and draws that do not depend on the partitions."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from sievelake.functions.stats import hash_unit
from sievelake.operators import distance, prior
from sievelake.plans.shared import written


def frame(spark, x, parts=4):
    names = [f"c{i}" for i in range(x.shape[1])]
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k long, " + ", ".join(f"{c} double" for c in names)).repartition(parts), names


def distances(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))


def test_kernel_and_energy_distances_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2000, 3)) @ rng.normal(size=(3, 3)), rng.normal(size=(1500, 3)) + 0.3
    (p, names), (q, _) = frame(spark, a), frame(spark, b, 7)
    gamma = 0.2
    kernel = lambda x, y: np.exp(-gamma * distances(x, y) ** 2).mean()
    got, error = prior.kernel_distance(p, q, names, gamma, 4096)
    want = kernel(a, a) + kernel(b, b) - 2 * kernel(a, b)
    assert abs(got - want) < 4 * error and error < 0.05 * want
    want = 2 * distances(a, b).mean() - distances(a, a).mean() - distances(b, b).mean()
    got, error = prior.row_energy(p, q, names, 200)
    assert abs(got - want) < 4 * error and error < 0.2 * want
    one, _ = prior.row_energy(p, q, names[:1])
    assert abs(one - (2 * distances(a[:, :1], b[:, :1]).mean() - distances(a[:, :1], a[:, :1]).mean() - distances(b[:, :1], b[:, :1]).mean())) < 1e-6
    assert prior.kernel_distance(p, p, names, gamma)[0] < 1e-12 and prior.row_energy(p, p, names, 4)[0] == 0
    median = prior.median_distance(p, names, ["k"])
    assert abs(median / np.median(distances(a, a)[np.triu_indices(len(a), 1)]) - 1) < 0.08
    assert prior.median_distance(p.repartition(2), names, ["k"]) == median and prior.median_distance(p.limit(0), names, ["k"]) == 1.0


def test_auc_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(2)), int(rng.integers(2)), float(rng.integers(0, 6))) for _ in range(300)] + [(2, 1, 1.0), (0, None, 1.0), (0, 1, None)]
    got = {r.g: r for r in prior.auc(spark.createDataFrame(rows, "g int, label int, score double"), ["g"]).collect()}
    for g in (0, 1):
        up, down = ([s for h, y, s in rows if h == g and y == label and s is not None] for label in (1, 0))
        want = sum((x > y) + (x == y) / 2 for x in up for y in down) / (len(up) * len(down))
        assert abs(got[g].auc - want) < 1e-12 and (got[g].positives, got[g].negatives) == (len(up), len(down))
    assert got[2].auc is None


def test_draws_do_not_depend_on_partitions(spark):
    names = ["a", "b", "c", "d"]
    first = prior.prior_sample(spark, 1000, names, 3).orderBy("id").collect()
    ids = np.array([r.id for r in first])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert prior.prior_sample(spark, 1000, names, 3).coalesce(1).orderBy("id").collect() == first
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert (ids == np.arange(1000)).all() and prior.prior_sample(spark, 50, names, 4).orderBy("id").first() != first[0]
    x = np.array([r[1:] for r in prior.normal_sample(spark, 20000, names, 1).collect()])
    assert np.abs(x.mean(0)).max() < 0.03 and np.abs(np.cov(x.T) - np.eye(4)).max() < 0.05


def test_prior_distances(spark):
    near = prior.prior_sample(spark, 600, ["a", "b"], 9).withColumnRenamed("id", "k")
    far = near.select("k", F.exp("a").alias("a"), F.floor("b").alias("b"))
    same, other = (prior.prior_distances(df, ["a", "b"], "k", 9, features=512, lines=8) for df in (near, far))
    assert same["mmd"] < 1e-6 and same["energy"] < 1e-6 and other["energy"] > 0.01 and other["c2st"] > 0.7 and same["c2st"] < 0.5  # a copy of each row bears the other label
    normal = prior.normal_sample(spark, 600, ["a", "b"], 5).withColumnRenamed("id", "k")
    got = prior.prior_distances(normal, ["a", "b"], "k", 6, "normal", features=512)
    assert abs(got["c2st"] - 0.5) < 0.1 and got["w1"] < 0.2 and math.isclose(got["mmd"], 0, abs_tol=0.02)


def test_a_row_and_its_copies_are_learned_from_as_one(spark, monkeypatch):
    """Copies weigh in the fit and in the ranks, and only distinct rows of a side and fold are held."""
    held = []
    monkeypatch.setattr(prior, "written", lambda df, kind: held.append(written(df, kind)) or held[-1])
    p = spark.range(4000).selectExpr("id k", "cast(id % 7 as double) a")
    q = spark.range(3000).selectExpr("id k", "cast(id % 5 as double) a")
    got = prior.told_apart(p, q, ["a"], "k")
    assert held[0].count() <= 3 * (7 + 5)
    draw = lambda df, label: df.select("a", F.floor(hash_unit(F.col("k"), F.lit(label), seed=0) * 3).alias("fold")).collect()
    up, down = draw(p, 1), draw(q, 0)
    want = []
    for fold in range(3):  # of one feature the score is a monotone function
        x, y = (np.array([r.a for r in side if r.fold == fold]) for side in (up, down))
        want.append(((x[:, None] > y) + (x[:, None] == y) / 2).mean())
    assert abs(got - np.mean(want)) < 1e-9


def test_both_sides_are_dealt_alike_over_the_fits_files(spark, monkeypatch):
    """A side whose columns take few bytes was packed whole into a task or two."""
    held = []
    monkeypatch.setattr(prior, "written", lambda df, kind: held.append(written(df, kind)) or held[-1])
    p, q = (spark.range(0, 2000, 1, 1).selectExpr("id k", f"id / {by} a") for by in (7.0, 5.0))
    prior.told_apart(p, q, ["a"], "k")
    by = held[0].groupBy(F.input_file_name().alias("file")).pivot("label", [0.0, 1.0]).count().collect()
    assert all(r["0.0"] and r["1.0"] and 0.5 < r["0.0"] / r["1.0"] < 2 for r in by)


def test_a_column_is_not_gathered_in_one_task(spark):
    """The distribution functions of a column met its two totals in the one task of the column's name."""
    p, q = (prior.normal_sample(spark, 50, ["a", "b"], seed) for seed in (1, 2))
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("-1", "false"), strict=True):
            spark.conf.set(n, v)
        plan = distance.steps(p, q, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    assert "SortMergeJoin [feature" in plan  # that of the ranges
    assert not re.search(r"SortMergeJoin \[feature#\d+\]", plan)


def test_values_move_in_pieces_by_range(spark, monkeypatch):
    """F2, dist_row_energy: each value of each line was a row that was counted, written, read three times and sorted."""
    kinds = []
    monkeypatch.setattr(distance, "written", lambda df, kind: kinds.append(kind) or written(df, kind))
    rng = np.random.default_rng(4)
    rows = lambda n, by: spark.createDataFrame([(float(a) + by, None if b < -1 else float(b), float(c), None, int(c) + 1) for a, b, c in zip(rng.normal(size=n), rng.normal(size=n), rng.integers(0, 4, n), strict=True)], "a double, b double, c double, none double, w long")
    p, q = rows(900, 0.0), rows(500, 0.5)
    assert prior.row_energy(p, q, ["a", "c"], 4)[0] > 0 and not kinds
    names = ["a", "b", "c", "none"]
    for weight in (None, "w"):
        gap = F.col("fp") - F.col("fq")
        want = {r.feature: r for r in distance.steps(p, q, names, weight=weight).groupBy("feature").agg(F.sum(F.abs(gap) * F.col("width")).alias("one"), F.sum(gap * gap * F.col("width")).alias("two")).collect()}
        for most in (70, 1 << 20):  # twenty ranges, and one
            for over, name in ((np.abs, "one"), (np.square, "two")):
                got = distance.areas(p, q, names, over, weight=weight, most=most)
                assert np.allclose(got[:3], [want[c][name] for c in names[:3]], rtol=1e-12) and got[3] is None
    assert distance.areas(p.limit(0), q, ["a"], np.abs) == [None]


def test_a_row_costs_monomials_not_waves(spark, monkeypatch):
    """F1, dist_prior_normal, and F4, dist_mmd: each row went through a cosine and a sine a line."""
    rng = np.random.default_rng(6)
    lines = rng.standard_normal((3, 300))
    x, w = np.concatenate((rng.standard_normal((4000, 3)), rng.uniform(-1e6, 1e6, (20, 3)))), rng.integers(1, 5, 4020)
    monkeypatch.setattr(prior, "CELLS", 500)  # some cells are put through the waves early
    waves = prior.CellWaves(lines)
    for part in np.array_split(np.arange(len(x)), 3):
        waves.add(x[part], w[part])
    waves.flush()
    near = x[:4000] @ lines
    far = x[4000:] @ lines
    want = [sum(w[at] @ f(along) for at, along in ((slice(4000), near), (slice(4000, None), far))) for f in (np.cos, np.sin)]
    assert np.abs(waves.total - want).max() / w.sum() < 1e-7
    few = prior.CellWaves(lines * 0.01)
    few.add(x[:4000], w[:4000])
    assert len(few.cells) <= 27
    p, names = frame(spark, x[:500, :2])
    five = spark.createDataFrame([tuple(map(float, r)) for r in rng.standard_normal((50, 5))], [f"c{i}" for i in range(5)])
    assert prior.CellWaves.offered(2) and not prior.CellWaves.offered(5)
    for df, own in ((p, names), (five, five.columns)):
        y, along = np.array(df.select(own).collect()), rng.standard_normal((len(own), 40))
        assert np.allclose(prior.kernel_means(df, own, along), np.concatenate((np.cos(y @ along).mean(0), np.sin(y @ along).mean(0))), atol=1e-7)


def test_pairs_of_a_group_that_spans_batches(spark):
    """F1, dist_prior_normal, and F4, dist_mmd: a group's rows were gathered as an array and exploded twice."""
    df = spark.range(600).selectExpr("id k", "cast(id * id as double) a")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = prior.median_distance(df, ["a"], ["k"], each=600)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    a = np.arange(600.0) ** 2
    far = np.abs(a[:, None] - a)[np.triu_indices(600, 1)]
    assert abs((far < got).mean() - 0.5) < 0.001


def test_scores_are_ranked_in_pieces(spark, monkeypatch):
    """F1, dist_prior_normal: every score was a row that was counted, written and put through windows."""
    kinds = []
    monkeypatch.setattr(prior, "auc", lambda *a, **k: kinds.append("auc"))
    p, q = (spark.range(n).selectExpr("id k", f"cast(id % {by} as double) a") for n, by in ((700, 9), (500, 6)))
    pairs = [(x % 9 > y % 6) + (x % 9 == y % 6) / 2 for x in range(700) for y in range(500)]
    for most in (50, 1 << 20):
        assert abs(distance.areas(p, q, ["a"], None, most=most)[0] - np.mean(pairs)) < 1e-12
    assert prior.told_apart(p, q, ["a"], "k", pooled=True) > 0.6 and not kinds
