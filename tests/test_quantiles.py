"""Exact quantiles in narrow brackets, sketches that merge, and faults that were mended."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.functions import sketches
from sievelake.functions.quantiles import Quantiles, exact_quantiles, quantile_grid
from sievelake.operators import dedup, evaluate, impute, inject, reduce, select
from sievelake.sources import loaders


def test_quantiles_equal_those_of_sorted_values(spark):
    rng = np.random.default_rng(1)
    n = 3000
    columns = {"even": rng.normal(size=n), "tied": rng.integers(0, 4, n).astype(float), "halves": np.repeat([1.0, 2.0], n // 2), "hot": np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n) * 1e6), "few": np.where(np.arange(n) < 5, np.arange(n), np.nan), "none": np.full(n, np.nan), "ends": np.where(rng.random(n) < 0.3, np.inf, -rng.random(n))}
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in zip(*columns.values(), strict=True)], ", ".join(f"{c} double" for c in columns)).repartition(4)
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0]
    want = {c: df.agg(F.percentile(c, F.array(*map(F.lit, shares)))).first()[0] for c in columns}
    for most, accuracy in ((7, 20), (200, 100), (10_000, 10_000)):
        got = exact_quantiles(df, {c: Quantiles(F.col(c), shares) for c in columns} | {"middle": Quantiles(F.col("even"), [0.5], True)}, most, accuracy)
        for c in columns:
            assert got[c] == want[c], (c, most)
        assert got["middle"] == got["even"][3]
    grid = [i / 99 for i in range(100)]
    for c in ("even", "tied", "hot"):
        assert quantile_grid(df, F.col(c), grid) == df.agg(F.percentile(c, F.array(*map(F.lit, grid)))).first()[0]
    assert exact_quantiles(df.limit(0), {"x": Quantiles(F.col("even"), [0.5], True)}) == {"x": None} and quantile_grid(df, F.col("none"), grid) is None


def test_sketches_merge_to_the_bit(spark):
    df = spark.range(20000).select((F.col("id") % 3).alias("a"), (F.col("id") % 7).alias("b"), (F.col("id") % 4000).alias("user"), F.when(F.col("id") % 11 != 0, F.exp(F.col("id") / 4000) - 10).alias("x"), F.when(F.col("id") % 2 == 0, "even").otherwise(F.concat(F.lit("odd"), F.col("id") % 500)).alias("word"))
    fine = sketches.sketch(df, ["a", "b"], ["user"], ["x"], ["word"])
    order = ["column", "kind", "slot", "v"]
    for by in (["a"], ["b"], []):
        assert sorted(sketches.merge(fine, by).select(*by, *order).collect()) == sorted(sketches.sketch(df.repartition(3), by, ["user"], ["x"], ["word"]).select(*by, *order).collect())
    cube = sketches.merge_cube(fine, ["a", "b"])
    assert sorted(cube.where("level = 1").select("a", *order).collect()) == sorted(sketches.merge(fine, ["a"]).select("a", *order).collect()) and {r.level for r in cube.select("level").distinct().collect()} == {0, 1, 2, 3}
    whole = sketches.merge(fine, [])
    assert abs(sketches.distinct_counts(whole, []).first()["distinct"] / 4000 - 1) < 0.05
    x = np.sort([r.x for r in df.where("x is not null").select("x").collect()])
    shares = [0.01, 0.2, 0.5, 0.99]
    row = sketches.quantiles(whole, [], shares).first()
    assert row.n == len(x) and all(abs(g - x[int(s * (len(x) - 1))]) <= 0.0101 * abs(x[int(s * (len(x) - 1))]) + 1e-9 for g, s in zip(row.quantiles, shares, strict=True))
    words = df.select("word").distinct()
    got = {r.word: r.n for r in sketches.frequencies(whole, [], "word", words.unionByName(spark.createDataFrame([("never",)], "word string")), "word").collect()}
    true = {r.word: r["count"] for r in df.groupBy("word").count().collect()}
    assert all(true[w] <= got[w] <= true[w] + 20000 * 2.72 / sketches.WIDTH for w in true) and got["even"] >= 10000
    assert sketches.sketch(df.limit(0), ["a"], ["user"]).count() == 0


def test_lsh_join_finds_what_the_exact_join_finds(spark):
    rng = np.random.default_rng(2)
    base = [sorted(rng.choice(3000, 30, replace=False).tolist()) for _ in range(60)]
    sets = [(i, [str(t) for t in b]) for i, b in enumerate(base)]
    for i, b in enumerate(base * 4):  # 2 to 5 of 30 tokens replaced: jaccard from 0.71 to 0.88
        k = 2 + i % 4
        kept = rng.choice(b, 30 - k, replace=False).tolist()
        sets.append((100 + i, [str(t) for t in kept + rng.integers(5000, 9000, k).tolist()]))
    sets += [(900, sets[0][1]), (901, sets[0][1][::-1])]
    df = spark.createDataFrame(sets, "k long, tokens array<string>")
    for threshold in (0.7, 0.8):
        exact = {(r.a, r.b) for r in dedup.jaccard_links(df, threshold).collect()}
        found = {(r.a, r.b) for r in dedup.lsh_links(df, threshold).collect()}
        assert found <= exact and len(found) >= 0.95 * len(exact) and (0, 900) in found
        assert found <= {(r.a, r.b) for r in dedup.lsh_links(df, threshold, most=2).collect()} <= exact  # crowded buckets go the exact way
    text = df.select("k", F.concat_ws(" ", "tokens").alias("t"))
    assert dedup.JaccardSimilarityDeduplicator(threshold=0.8, key="k", method="lsh").fit_transform(text).where("k >= 900").count() == 0
    with pytest.raises(ValueError):
        dedup.JaccardSimilarityDeduplicator(key="k", method="guess").fit_transform(text)


def test_drawn_cells_are_as_many_as_asked(spark):
    df = spark.range(400).select(F.col("id").alias("k"), F.lit(1.0).alias("a"), F.lit(2.0).alias("b"), F.lit("s").alias("s")).repartition(6)
    got = inject.inject_mcar_cells(df, 0.5, ["k"])
    nulls = got.where("a is null").count() + got.where("b is null").count()
    drawn = 400  # with replacement: 800 * (1 - exp(-1/2)) cells on average
    assert got.count() == 400 and got.columns == df.columns and 280 < nulls < 350 and nulls < drawn
    again = inject.inject_mcar_cells(df.coalesce(1), 0.5, ["k"])
    assert sorted(got.collect(), key=str) == sorted(again.collect(), key=str)
    one = inject.inject_mcar_cells(df, 1e-9, ["k"])
    assert one.where("a is null or b is null").count() == 1 and inject.inject_mcar_cells(df.limit(0), 0.5, ["k"]).count() == 0


def test_several_marks_of_missing_values(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w") as f:
        f.write("a,b,c\n1,x,2.5\n?,NA,-\n3,y,NA\n")
    df = loaders.CSVLoader(spark, file_path=path, read_csv_kwargs={"na_values": ["NA", "?", "-"]}).load()
    assert dict(df.dtypes) == {"a": "int", "b": "string", "c": "double"}
    assert [tuple(r) for r in df.collect()] == [(1, "x", 2.5), (None, None, None), (3, "y", None)]
    assert [r.b for r in loaders.CSVLoader(spark, file_path=path, read_csv_kwargs={"na_values": "NA"}).load().collect()] == ["x", None, "y"]


def test_an_index_column_is_data_outside_csv(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1, 2)], "_c0 int, b int").write.parquet(path)
    assert loaders.TableLoader(spark, path).load().columns == ["_c0", "b"]


def test_smote_draws_differ_between_rows_of_equal_values(spark):
    rows = [(i, float(i % 3), float(i % 3), "few") for i in range(9)] + [(100 + i, float(i), 1.0, "many") for i in range(40)]
    df = spark.createDataFrame(rows, "k long, a double, b double, y string")
    new = reduce.SMOTEBalancer(key="k", target="y", columns=["a", "b"]).fit_transform(df).where("k is null").collect()
    between = [(r.a, r.b) for r in new if r.a % 1]
    assert len(new) == 31 and len(set(between)) == len(between)


def test_lda_fills_the_training_mean(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    x = np.where(rng.random(300) < 0.33, np.nan, 5 + 2 * y + rng.normal(size=300))
    df = spark.createDataFrame([(i, None if np.isnan(v) else float(v), str(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "k long, x double, y string")
    assert evaluate.LDAEvaluator("y", ["k"], ["x"]).evaluate(df) > 0.65


def test_trees_and_support_vectors_select(spark):
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b), float(c), int(a + 0.5 * b > 0)) for a, b, c in rng.normal(size=(300, 3))]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int")
    trees = select.ExtraTreesSelector(columns=["a", "b", "c"], target="y", n_estimators=8, max_depth=4).fit(df)
    assert trees.stats["kept"][0] == "a" and "c" not in trees.stats["kept"]
    svc = select.LinearSVCSelector(columns=["a", "b", "c"], target="y", C=0.02).fit(df)
    assert "a" in svc.stats["kept"] and "c" not in svc.stats["kept"]
    gaps = df.withColumn("k", F.monotonically_increasing_id()).withColumn("b", F.when(F.rand(1) < 0.8, F.col("a") * 3))
    filled = impute.MICEImputer(columns=["a", "b", "c"], max_iter=2, estimator="extra_trees", n_estimators=5).fit_transform(gaps)
    assert filled.where("b is null").count() == 0 and filled.join(gaps.where("b is null").select("k"), "k").agg(F.corr("b", "a")).first()[0] > 0.9
