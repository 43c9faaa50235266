"""Forests that take one pass, and the tasks of Spark's own."""

import numpy as np
import pytest
from pyspark.ml import classification, regression
from pyspark.sql import functions as F

from sievelake.operators import evaluate, impute, select
from sievelake.operators.learners import BinnedForest, CountedForest, ranges
from sievelake.plans.shared import spread, written


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    out = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_round_of_chained_forests_is_a_few_jobs_whatever_the_depth(spark):
    df = spark.range(400).selectExpr("CASE WHEN id % 7 > 0 THEN id % 50 + 0.5 END a", "CASE WHEN id % 11 > 0 THEN 3.0 * (id % 50) END b", "id % 13 c")
    kind, n = jobs(spark, "mice", lambda: impute.MICEImputer(columns=["a", "b", "c"], max_iter=3, tol=0, n_estimators=10).fit(df))
    assert kind.stats["rounds"] == 3 and n <= 8 + 3 * 8  # each forest took some ten jobs before
    out = kind.transform(df)
    assert out.where("a is null or b is null or c is null").count() == 0
    gaps = df.withColumn("k", F.monotonically_increasing_id()).where("a is null").count()
    assert gaps and out.agg(F.corr("a", "b")).first()[0] > 0.97


def squared_error(y):
    return float(((y - y.mean()) ** 2).sum())


def brute(x, y, depth):
    """The least squares tree on one feature's values."""
    cuts = np.unique(x)[:-1]
    if not depth or not len(cuts) or squared_error(y) < 1e-9:
        return np.full(len(y), y.mean())
    drop = [squared_error(y) - squared_error(y[x <= c]) - squared_error(y[x > c]) for c in cuts]
    under = x <= cuts[int(np.argmax(drop))]
    out = np.zeros(len(y))
    for side in (under, ~under):
        out[side] = brute(x[side], y[side], depth - 1)
    return out


def test_trees_grown_from_sums_are_those_of_the_rows():
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 20, 500).astype(float), rng.random(500)
    forest = BinnedForest(["a"], "y", [ranges(x)], "id", n_estimators=2, max_depth=3)
    cell = forest.cells(x[:, None])
    sums = np.stack([np.bincount(cell, w, *forest.shape) for w in (np.ones(500), y, y * y)])
    for tree in forest.grown(np.stack([sums, 3 * sums])):
        assert tree[cell] == pytest.approx(brute(x, y, 3))
    assert np.isnan(forest.grown(0 * sums[None])).all()


def test_forests_follow_two_features(spark):
    df = spark.range(3000).selectExpr("id", "cast(id % 53 as double) a", "cast(id % 17 as double) b").withColumn("y", F.col("a") + 2 * F.col("b"))
    own = [ranges([r[0] for r in df.select(c).collect()]) for c in ("a", "b")]
    forest = BinnedForest(["a", "b"], "y", own, "id", n_estimators=20).fit(df, 40.0)
    got = df.repartition(3).select("y", forest.prediction([F.col("a"), F.col("b")]).alias("p"))
    assert got.agg(F.corr("y", "p")).first()[0] > 0.95
    again = BinnedForest(["a", "b"], "y", own, "id", n_estimators=20).fit(df.repartition(5), 40.0)
    assert again.means == pytest.approx(forest.means)  # draws follow the id, not the partitions


def test_rows_of_a_small_file_are_dealt_over_tasks(spark):
    table = written(spark.range(1000, numPartitions=1), "small")
    assert table.rdd.getNumPartitions() == 1
    sizes = spread(table, 300).rdd.glom().map(len).collect()
    assert len(sizes) == 4 and sum(sizes) == 1000 and max(sizes) <= 300
    assert spread(table, 1000).rdd.getNumPartitions() == 1


def test_boosted_trees_learn_from_points_with_counts(spark):
    """The trees are those of all rows, and the fit holds a row for each point."""
    df = spark.range(3000).selectExpr("id k", "cast(id % 9 as double) a", "cast(id % 4 as double) b").withColumn("y", F.sin("a") * F.col("b") + F.col("k") % 101 / 50)
    kind = evaluate.GBREvaluator("y", ["k"], ["a", "b"], n_estimators=6)
    rows = evaluate.vectors(evaluate.split(df, ["k"], seed=42), ["a", "b"], "y", keep=("k", "split")).withColumn("y", F.col("_t"))
    train = rows.where("split = 'train'")
    assert kind.training(train, ["a", "b"]).count() == 36
    plain = regression.GBTRegressor(featuresCol="x", labelCol="y", maxIter=6, maxDepth=3, stepSize=0.1, seed=42).fit(train)
    want = {r.k: r.prediction for r in plain.transform(rows.where("split = 'test'")).select("k", "prediction").collect()}
    got = {r.k: r.prediction for r in kind.predictions(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_forests_for_classes_grow_from_counted_rows(spark):
    """Copies are one row with their count, draws follow the ranges, and the shares are close to those of Spark's forest of all rows."""
    df = spark.range(6000).selectExpr("cast(id % 40 as double) a", "cast(id % 7 as double) b", "cast(id % 3 as double) c", "id").withColumn("y", ((F.col("a") > 24) != ((F.col("b") > 4) & (F.hash("id") % 2 == 0))).cast("int"))
    forest = CountedForest(["a", "b", "c"], "y", n_estimators=30, max_depth=4)
    assert forest.counted(df).count() <= 32 * 7 * 3 * 2
    forest.fit(df)
    again = CountedForest(["a", "b", "c"], "y", n_estimators=30, max_depth=4).fit(df.repartition(7))
    assert list(again.importances) == list(forest.importances) and abs(forest.importances.sum() - 1) < 1e-9
    plain = classification.RandomForestClassifier(featuresCol="_x", labelCol="y", numTrees=30, maxDepth=4, seed=1)
    kind = select.RandomForestSelector(columns=["a", "b", "c"], target="y", n_estimators=30, max_depth=4)
    want = plain.fit(kind.fitted(df, ["a", "b", "c"]).withColumnRenamed("_y", "y")).featureImportances.toArray()
    assert np.abs(forest.importances - want).max() < 0.1 and forest.importances[0] > forest.importances[1] > forest.importances[2]
    assert kind.fit(df).stats["kept"] == ["a", "b"]
