"""Learners of the library against plain versions of themselves on the same draws and folds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.operators import crossval, learners, splines


def frame(spark, x, y, kind="double"):
    names = [f"c{i}" for i in range(x.shape[1])]
    rows = [(i, *(None if np.isnan(v) else float(v) for v in r), t) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "k long, " + ", ".join(f"{c} double" for c in names) + f", y {kind}").repartition(5), names


# ---- folds


def separate(x, y, fold, kind, alpha):
    """One fit for each fold: mean accuracy."""
    out = []
    for f in sorted(set(fold)):
        tx, ty, vx, vy = x[fold != f], y[fold != f], x[fold == f], y[fold == f]
        scores = []
        for c in sorted(set(ty)):
            own, prior = tx[ty == c], math.log((ty == c).mean())
            if kind == "nb":
                v = own.var(0) + 1e-9 * tx.var(0).max()
                scores.append(prior - 0.5 * np.log(2 * np.pi * v).sum() - 0.5 * ((vx - own.mean(0)) ** 2 / v).sum(1))
            elif kind == "mnb":
                low = np.maximum(own, 0)
                scores.append(prior + np.maximum(vx, 0) @ np.log((low.sum(0) + alpha) / (low.sum() + alpha * x.shape[1])))
            else:
                within = sum((tx[ty == d] - tx[ty == d].mean(0)).T @ (tx[ty == d] - tx[ty == d].mean(0)) for d in set(ty)) / (len(tx) - len(set(ty))) + 1e-6 * np.eye(x.shape[1])
                w = np.linalg.solve(within, own.mean(0))
                scores.append(prior - own.mean(0) @ w / 2 + vx @ w)
        out.append((np.array(sorted(set(ty)))[np.argmax(scores, 0)] == vy).mean())
    return out


@pytest.mark.parametrize("kind", ["nb", "lda", "mnb"])
def test_folds_equal_separate_fits(spark, kind):
    rng = np.random.default_rng(1)
    y = rng.choice(["a", "b", "c"], 500)
    x = rng.normal(size=(500, 3)) + 1.2 * np.column_stack((y == "a", y == "b", y == "c")) + 5 * (kind == "mnb")
    df, names = frame(spark, x, y.tolist(), "string")
    grid = {"mnb": [{"alpha": 0.001}, {"alpha": 0.5}]}.get(kind)
    model = crossval.KFoldClassifier("y", ["k"], names, kind, 5, grid)
    fold = np.array([r.f for r in df.orderBy("k").select(crossval.fold_of(["k"], 5, 42).alias("f")).collect()])
    got = {(r.point, r.fold): r.hits / r.n for r in model.results(df).collect()}
    for point, p in enumerate(model.grid):
        want = separate(x, y, fold, kind, p.get("alpha", 1.0))
        assert [got[point, f] for f in range(5)] == pytest.approx(want, abs=1e-12)
    accuracy, best = model.evaluate(df.withColumn("c0", F.when(F.col("k") != 3, F.col("c0"))))
    assert 0.5 < accuracy < 1 and best in model.grid and model.evaluate(df.limit(0)) == (0.0, {})


def test_regression_folds_and_trees(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)) * [1, 10, 0.1] + 100
    y = x @ [1.0, 0.2, 0.0] + rng.normal(size=300)
    df, names = frame(spark, x, y.tolist())
    model = crossval.KFoldRegression("y", ["k"], names, 10, [0.0, 0.05, 100.0])
    fold = np.array([r.f for r in df.orderBy("k").select(crossval.fold_of(["k"], 10, 42).alias("f")).collect()])
    got = {(r["alpha"], r["fold"]): r["mse"] for r in model.results(df)}
    for f in range(10):
        a = np.column_stack((np.ones(300), x))
        w = np.linalg.lstsq(a[fold != f], y[fold != f], rcond=None)[0]
        assert got[0.0, f] == pytest.approx(((a[fold == f] @ w - y[fold == f]) ** 2).mean(), rel=1e-6)
        assert got[100.0, f] == pytest.approx(((y[fold != f].mean() - y[fold == f]) ** 2).mean(), rel=1e-9)
    assert model.evaluate(df)[1] < 100 and crossval.KFoldRegression("y", ["k"], names).evaluate(df.limit(0)) == (0.0, 0.0)
    banded = df.withColumn("band", F.when(F.col("y") > 120, "high").otherwise("low"))
    accuracy, best = crossval.KFoldClassifier("band", ["k"], names, "cart", 3, [{"max_depth": 1}, {"max_depth": 4}]).evaluate(banded)
    assert accuracy > 0.7 and best in ({"max_depth": 1}, {"max_depth": 4})


def test_kernel_ridge_uses_all_rows_and_its_grid(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-2, 2, size=(1500, 2))
    y = np.sin(2 * x[:, 0]) + 0.5 * x[:, 1] ** 2
    df, names = frame(spark, x, y.tolist())
    model = crossval.KernelRidgeEvaluator("y", ["k"], names, alphas=[1e-3, 100.0], gammas=[1e-4, 0.5], folds=3)
    got = model.predictions(df).collect()
    assert model.best_params == {"gamma": 0.5, "alpha": 1e-3} and np.mean([(r.label - r.prediction) ** 2 for r in got]) < 0.02 * y.var()


# ---- splines


def test_splines_find_the_knots_of_a_piecewise_function(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.uniform(0, 10, size=(1000, 2)), 1)
    y = 3 * np.maximum(x[:, 0] - 4, 0) - 2 * np.maximum(7 - x[:, 1], 0) + 0.05 * rng.normal(size=1000)
    df, names = frame(spark, x, y.tolist())
    model = splines.SplineRegressor(names, "y", knots=99).fit(df)
    strong = {(j, t) for (j, t, _), w in zip(model.terms, model.weights[1:], strict=True) if abs(w) > 1}
    assert {j for j, _ in strong} == {0, 1} and all(abs(t - (4, 7)[j]) <= 0.3 for j, t in strong), model.terms
    got = df.select("y", model.prediction().alias("p")).collect()
    assert np.mean([(r.y - r.p) ** 2 for r in got]) < 0.01


def test_first_pair_equals_search_over_all(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 2))
    y = np.abs(x[:, 0] - 0.3) + 0.3 * rng.normal(size=200)
    df, names = frame(spark, x, y.tolist())
    model = splines.SplineRegressor(names, "y", max_terms=3, penalty=0.0, knots=200).fit(df)
    rows = df.select(F.col("c0").alias("x0"), F.col("c1").alias("x1"))
    pairs = model.candidates(rows, 200)
    assert len(pairs) > 60

    def error(j, t):
        a = np.column_stack((np.ones(200), np.maximum(x[:, j] - t, 0), np.maximum(t - x[:, j], 0)))
        return ((a @ np.linalg.lstsq(a, y, rcond=None)[0] - y) ** 2).sum()

    best = min(pairs, key=lambda c: error(*c))
    assert {(j, t) for j, t, _ in model.terms} == {best}
    got = np.array([r.p for r in df.orderBy("k").select(model.prediction().alias("p")).collect()])
    assert ((got - y) ** 2).sum() == pytest.approx(error(*best), rel=1e-9)
    empty = splines.SplineRegressor(names, "y").fit(df.limit(0))
    assert empty.terms == [] and splines.SplineRegressor(names, "y").fit(df.withColumn("y", F.lit(2.0))).middle == 2.0


# ---- trees and support vectors


def plain_tree(x, own, seed, tree, depth, drawn, classes, node=0, at=0):
    """The same draws, recursively: {node: (feature, cut)}."""
    p = x.shape[1]
    rng = np.random.default_rng([seed, tree, node])
    unit, order = rng.random(p), rng.permutation(p)

    def impurity(s):
        return s.sum() - (s**2).sum() / max(s.sum(), 1e-300) if classes else max(0.0, s[2] - s[1] ** 2 / max(s[0], 1e-300))

    low, high = x.min(0), x.max(0)
    varies = [f for f in order if low[f] < high[f]][:drawn]
    if at == depth or len(x) < 2 or not varies or impurity(own.sum(0)) <= 1e-12 * len(x):
        return {}
    drop = {f: impurity(own.sum(0)) - impurity(own[x[:, f] <= low[f] + unit[f] * (high[f] - low[f])].sum(0)) - impurity(own[x[:, f] > low[f] + unit[f] * (high[f] - low[f])].sum(0)) for f in varies}
    best = min(f for f in drop if drop[f] >= max(drop.values()) - 1e-9 * impurity(own.sum(0)))
    cut = low[best] + unit[best] * (high[best] - low[best])
    under = x[:, best] <= cut
    out = {node: (int(best), float(cut))}
    for child, part in ((2 * node + 1, under), (2 * node + 2, ~under)):
        out |= plain_tree(x[part], own[part], seed, tree, depth, drawn, classes, child, at + 1)
    return out


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_extra_trees_equal_plain_trees_of_the_same_draws(spark, task):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(150, 3)), 2)
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(int) if task == "classification" else 2 * x[:, 0] + x[:, 1] ** 2
    df, names = frame(spark, x, [str(v) for v in y] if task == "classification" else y.tolist(), "string" if task == "classification" else "double")
    forest = learners.ExtraTrees(names, "y", task, n_estimators=3, max_depth=5).fit(df)
    own = np.eye(2)[y] if task == "classification" else np.column_stack((np.ones(150), y, y * y))
    for tree in range(3):
        want = plain_tree(x, own, 42, tree, 5, forest.drawn_features, task == "classification")
        got = {node: (f, forest.cut[t, node]) for (t, node), f in forest.feature.items() if t == tree}
        assert got.keys() == want.keys() and all(got[n][0] == want[n][0] and abs(got[n][1] - want[n][1]) < 1e-12 for n in got)
    assert forest.importances[0] == forest.importances.max() and abs(forest.importances.sum() - 1) < 1e-12
    got = np.array([r.p for r in df.orderBy("k").select(forest.prediction([F.col(c) for c in names]).alias("p")).collect()])
    assert (got == y).mean() > 0.85 if task == "classification" else ((got - y) ** 2).mean() < 0.5 * y.var()


def test_l1_support_vectors_reach_the_least(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 4))
    y = np.where(x[:, 0] - 0.7 * x[:, 1] + 0.5 * rng.normal(size=400) > 0.2, 1.0, -1.0)
    df, names = frame(spark, x, y.tolist())
    w = learners.l1_support_vectors(df, names, F.col("y") > 0, 0.05)
    value = lambda v: np.abs(v).sum() + 0.05 * (np.maximum(0, 1 - y * (np.column_stack((x, np.ones(400))) @ v)) ** 2).sum()
    best = value(w)
    assert abs(w[2]) < 0.05 and abs(w[3]) < 0.05 and w[0] > 0.3
    for j in range(5):
        for step in (1e-3, -1e-3):
            near = w.copy()
            near[j] += step
            assert value(near) >= best - 1e-9
    assert (learners.l1_support_vectors(df, names, F.col("y") > 0, 1e-6) == 0).all()
