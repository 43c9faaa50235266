"""Fitted operators against plain versions of themselves."""

import numpy as np
import pytest

from sievelake.operators import evaluate, impute, outliers
from sievelake.plans import registry, search


def frame(spark, x, names):
    return spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in row)) for i, row in enumerate(x)], "k long, " + ", ".join(f"{n} double" for n in names))


def chained(x, rounds, tol, ridge=1e-3):
    """EMImputer on an array."""
    gaps, filled = np.isnan(x), np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    mean, sd = np.nanmean(x, axis=0), np.nanstd(x, axis=0)
    for _ in range(rounds):
        was = filled.copy()
        for c in sorted((c for c in range(x.shape[1]) if gaps[:, c].any()), key=lambda c: gaps[:, c].sum()):
            z = (filled - mean) / sd
            a = np.column_stack([np.ones(len(x)), np.delete(z, c, axis=1)])
            seen = ~gaps[:, c]
            beta = np.linalg.solve(a[seen].T @ a[seen] + ridge * np.eye(a.shape[1]), a[seen].T @ ((x[seen, c] - mean[c]) / sd[c]))
            filled[gaps[:, c], c] = (a @ beta)[gaps[:, c]] * sd[c] + mean[c]
        if np.abs(filled - was).max() <= tol * np.nanmax(np.abs(x)):
            break
    return filled


@pytest.mark.parametrize("rounds", [1, 6])
def test_em_chains_the_columns_it_has_filled(spark, rounds):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 3)) @ rng.normal(size=(3, 3)) + 5
    x[rng.random(x.shape) < 0.2] = np.nan
    df = frame(spark, x, "abc")
    em = impute.EMImputer(columns=["a", "b", "c"], max_iter=rounds, tol=1e-9)
    got = np.array([r[1:] for r in em.fit_transform(df).orderBy("k").collect()])
    assert np.allclose(got, chained(x, rounds, 1e-9), atol=1e-8)
    if rounds > 1:  # rows with two gaps go on moving after the first round
        assert not np.allclose(got, chained(x, 1, 1e-9), atol=1e-4)


def test_em_of_complete_and_empty_frames(spark):
    df = frame(spark, np.array([[1.0, 2.0], [3.0, 4.0]]), "ab")
    assert sorted(impute.EMImputer(columns=["a", "b"]).fit_transform(df).collect()) == sorted(df.collect())
    assert impute.EMImputer(columns=["a", "b"]).fit_transform(df.limit(0)).count() == 0


def test_lasso_from_sums_of_products(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4))
    y = 3 * x[:, 0] - 2 * x[:, 2] + rng.normal(scale=0.1, size=200)
    centred, target = x - x.mean(0), y - y.mean()
    for alpha in (0.01, 0.5):
        beta = evaluate.lasso(centred.T @ centred / 200, centred.T @ target / 200, alpha, np.zeros(4))
        gradient = centred.T @ (target - centred @ beta) / 200
        assert np.all(np.abs(gradient) <= alpha + 1e-6) and np.allclose(gradient[beta != 0], alpha * np.sign(beta[beta != 0]), atol=1e-6)
    model = evaluate.LassoEvaluator("y", ["k"], ["a", "b", "c", "d"])
    result = model.evaluate(frame(spark, np.column_stack([x, y]), ["a", "b", "c", "d", "y"]))
    assert result["r2"] > 0.99 and 1e-4 <= model.alpha <= 0.1


@pytest.mark.parametrize("block", [7, 4096])
def test_local_outlier_factors_of_rows(spark, block):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(40, 2)), [[9.0, 9.0], [np.nan, 1.0]]])
    lof = outliers.MultivariateLOFCleaner(columns=["a", "b"], key="k", block=block)
    df = frame(spark, x, "ab")
    got = {r.q: r.factor for r in lof.factors(df, ["a", "b"]).collect()}
    whole = x[:41]
    distance = np.sqrt(((whole[:, None] - whole[None]) ** 2).sum(-1))
    np.fill_diagonal(distance, np.inf)
    near = np.argsort(distance, axis=1, kind="stable")[:, :4]
    far = np.take_along_axis(distance, near, 1).max(1)
    density = 1 / (np.maximum(np.take_along_axis(distance, near, 1), far[near]).mean(1) + 1e-10)
    assert np.allclose([got[i] for i in range(41)], density[near].mean(1) / density) and len(got) == 41
    kept = {r.k for r in lof.fit_transform(df).collect()}
    assert 40 not in kept and 41 not in kept and len(kept) >= 36
    assert lof.fit_transform(df.limit(0)).count() == 0


def test_signed_ranks_and_t(spark):
    df = spark.createDataFrame([("x", a, b) for a, b in ((1.0, 2.0), (4.0, 2.0), (5.0, 1.0), (3.0, 3.0), (7.0, 6.0))] + [("y", 1.0, 1.0)], "g string, a double, b double")
    w = evaluate.wilcoxon(df, ["g"], "a", "b").collect()
    assert [(r.g, r.n, r.w) for r in w] == [("x", 4, 1.5)]  # differences -1 2 4 1: ranks 1.5 3 4 1.5
    t = {r.g: r for r in evaluate.one_sample_t(df, ["g"], "a", 1.0).collect()}
    a = np.array([1, 4, 5, 3, 7.0])
    assert t["x"].t == pytest.approx((a.mean() - 1) / (a.std(ddof=1) / np.sqrt(5))) and t["y"].t is None


def test_names_that_are_not_offered():
    assert "TABPFN" not in registry.EVALUATORS and {"MARS", "KRR"} <= registry.EVALUATORS.keys()
    assert registry.STRATEGIES["outliers"]["LOF"][0] is outliers.MultivariateLOFCleaner


def test_q_learner_keeps_its_epsilon():
    groups = {"one": [impute.MeanImputer(columns=["a"], name="mean")], "two": [impute.DropMissing(name="drop")]}
    greedy = search.QLearner(groups, epsilon=0.0, episodes=50)
    greedy.learn()
    open_moves = np.flatnonzero(greedy.reward[0] >= 0)
    assert np.count_nonzero(greedy.q[0, open_moves]) == 1  # without chance only the first best move is ever tried
