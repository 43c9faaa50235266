"""Distances, profiles, evaluation, rewards, search, sources and streams."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sievelake.operators import distance, evaluate, impute, outliers, profile, reward, scale
from sievelake.plans import components, registry, search
from sievelake.sources import loaders
from sievelake.streaming import streams


def numbers(spark, values, name="v"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], f"{name} double")


@pytest.mark.parametrize(("p", "q", "want"), [([0, 0, 0], [10, 10, 10], 10), ([0], [0, 0, 0, 0], 0), ([0], [10, 10], 10), ([1, None, 3], [2, 4], 1.0)])
def test_wasserstein(spark, p, q, want):
    assert distance.Wasserstein().calculate(numbers(spark, p), numbers(spark, q)) == pytest.approx(want)


def test_wasserstein_over_many_ranges(spark):
    rng = random.Random(1)
    a, b = [rng.gauss(0, 1) for _ in range(900)], [rng.gauss(0.3, 2) for _ in range(900)]
    want = sum(abs(x - y) for x, y in zip(sorted(a), sorted(b), strict=True)) / 900
    assert distance.Wasserstein().calculate(numbers(spark, a), numbers(spark, b)) == pytest.approx(want)


def test_every_distance_of_a_frame_to_itself_is_zero(spark):
    df = spark.createDataFrame([(float(i % 13), float(i * i % 7), "ab"[i % 2]) for i in range(80)], "a double, b double, s string")
    for d in distance.DISTANCES.values():
        assert d().calculate(df, df) == pytest.approx(0, abs=1e-8), d.name  # empty bins at 1e-10 leave the KL divergence that far from 0
        assert d().calculate(None, df) == 0.0
    assert len(distance.DISTANCES) == 18
    assert distance.distortion(df, df) == pytest.approx(0, abs=1e-9)


def test_jensen_shannon_of_disjoint_values_is_its_largest(spark):
    p, q = spark.createDataFrame([("a",)] * 3, "s string"), spark.createDataFrame([("b",)] * 2, "s string")
    assert distance.JensenShannon().calculate(p, q) == pytest.approx(math.sqrt(math.log(2)))
    assert distance.RowCount().calculate(p, q) == pytest.approx(1 / 3)
    assert distance.HistogramIntersection().calculate(numbers(spark, [5, 5]), numbers(spark, [5])) == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101 + i) for i in range(30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for a, b in edges * 100 if len(edges) < 200 else edges:
        if a != b:
            low = min(label[a], label[b])
            for n, v in label.items():
                if v in (label[a], label[b]) and v != low:
                    label[n] = low
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label


def test_profile_and_observers(spark):
    df = spark.createDataFrame([(float(i), None if i % 4 == 0 else float(i % 5), "xy"[i % 2]) for i in range(40)] + [(1000.0, 1.0, "x")], "a double, b double, c string")
    report = profile.DataProfiler().profile(df, "c")
    assert len(report.to_state_vector()) == 9 and report.missing > 0 and "outlier_detection" in report.relevant_action_groups()
    observer = profile.DataStatsObserver()
    assert observer.observe(df) == [41, 3, 10, 2, 1] and len(observer.history) == 1
    assert len(profile.AdvancedStatsObserver("c").observe(df)) == 5
    quality = profile.DataQualityObserver(df, "c").observe(df)
    assert quality[0] == 1 and quality[-1] == pytest.approx(0)
    assert len(profile.DataQualityObserver(df.select("c")).observe(df.select("c"))) == len(quality)
    assert {r.column: r.distinct for r in profile.summary(df).collect()}["b"] == 6


def test_metrics(spark):
    rows = spark.createDataFrame([(1, 1, 0.95), (0, 1, 0.55), (0, 0, 0.15), (1, 0, 0.35), (1, 1, 1.0)], "label int, prediction int, score double")
    m = evaluate.classification_metrics(rows).first()
    assert m.accuracy == pytest.approx(0.6) and m.f1 == pytest.approx((2 / 3 + 0.5) / 2)
    rows = rows.withColumn("correct", F.col("label") == F.col("prediction"))
    half_open = evaluate.expected_calibration_error(rows, confidence="score").first().ece
    closed = evaluate.expected_calibration_error(rows, confidence="score", closed=True).first().ece
    assert half_open == pytest.approx((0.05 + 0.55 + 0.85 + 0.35) / 5) and closed == pytest.approx((0.05 + 0.55 + 0.85 + 0.35) / 5)
    best = evaluate.best_f1_threshold(rows).first()
    assert best.threshold == 0.35 and best.f1 == pytest.approx(6 / 7)
    signals = evaluate.confidence_signals(spark.createDataFrame([([0.7, 0.2, 0.1],), ([0.5, 0.5, 0.0],)], "probability array<double>")).first()
    assert signals.confidence == pytest.approx(0.6) and signals.margin == pytest.approx(0.25)


def test_splits_models_and_pareto(spark):
    df = spark.range(400).selectExpr("id k", "cast(id % 40 as double) a", "cast((id * 37) % 100 as double) b", "case when id % 40 > 20 then 'hi' else 'lo' end y")
    for kind in (evaluate.CARTEvaluator, evaluate.LDAEvaluator, evaluate.GaussianNBEvaluator, evaluate.LogisticEvaluator):
        assert kind("y", ["k"], ["a", "b"]).evaluate(df) > 0.85
    assert evaluate.CARTEvaluator("y", ["k"]).evaluate(df.limit(5)) == 0.0
    line = df.withColumn("t", 3 * F.col("a") - F.col("b") + 1)
    assert evaluate.OLSEvaluator("t", ["k"], ["a", "b"]).evaluate(line)["r2"] == pytest.approx(1)
    sizes = {(r.y, r.split): r["count"] for r in evaluate.stratified_split(df, ["k"], "y", 0.25).groupBy("y", "split").count().collect()}
    assert all(sizes[y, "test"] == math.ceil(0.25 * (sizes[y, "test"] + sizes[y, "train"])) for y in ("hi", "lo"))
    rng = random.Random(3)
    points = [(i, rng.randrange(30), rng.randrange(30), rng.randrange(30)) for i in range(120)]
    frame = spark.createDataFrame(points, "k int, a int, b int, c int")
    for axes in (("a", "b"), ("a", "b", "c")):
        at = [{"k": 0, "a": 1, "b": 2, "c": 3}[x] for x in axes]
        front = {p[0] for p in points if not any(all(q[j] >= p[j] for j in at) and any(q[j] > p[j] for j in at) for q in points)}
        assert {r.k for r in evaluate.pareto_front(frame, "k", list(axes)).collect()} == front


def test_dbscan_against_brute_force(spark):
    rng = random.Random(4)
    points = [(i, rng.gauss(c, 0.3), rng.gauss(c, 0.3)) for i, c in enumerate([0, 5, 9] * 25)] + [(900, 50.0, 50.0)]
    got = {r.k: r.cluster for r in evaluate.dbscan(spark.createDataFrame(points, "k int, x double, y double"), "k", ["x", "y"], eps=0.5, least=4).collect()}
    near = {a[0]: [b[0] for b in points if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 0.25] for a in points}
    core = {k for k, n in near.items() if len(n) >= 4}
    assert {k for k, c in got.items() if c is None} == {k for k in near if k not in core and not core & set(near[k])}
    assert all(got[a] == got[b] for a in core for b in near[a] if b in core)


def test_rewards(spark):
    df = spark.createDataFrame([(i, float(i % 9) if i % 3 else None) for i in range(60)], "k int, v double")
    own = reward.CompletenessRetentionReward()
    own.reset(df)
    assert own(df) == pytest.approx(1 - 20 / 120) and own(df.limit(0)) == -1.0
    told = reward.ExplainableReward(own)
    told.reset(df)
    told.record("mean", impute.MeanImputer(columns=["v"]).fit_transform(df))
    told.record("half", df.where("k < 30"))
    assert reward.action_ranking(told.frame(spark)).first().action == "mean"
    gain = reward.IncrementalGainReward(reward.CompletenessRetentionReward())
    gain.reset(df)
    assert gain(impute.MeanImputer(columns=["v"]).fit_transform(df)) == pytest.approx(5 * 20 / 120)
    lost = reward.DataDistortionReward()
    lost.reset(df.select("v"))
    assert lost(df.select("v")) == pytest.approx(1, abs=1e-6)


def test_permutation_space():
    space = search.PermutationSpace(["A", "B"])
    assert [space.unrank(i) for i in range(4)] == [("A",), ("B",), ("A", "B"), ("B", "A")]
    assert len(search.PermutationSpace([1, 2, 3])) == 15
    seven = search.PermutationSpace(range(5))
    assert len({seven.unrank(i) for i in range(len(seven))}) == len(seven)
    for bad in ([], range(21)):
        with pytest.raises(ValueError):
            search.PermutationSpace(bad)
    with pytest.raises(IndexError):
        space.unrank(4)


def test_search(spark):
    df = spark.createDataFrame([(i, float(i % 9) if i % 3 else None) for i in range(60)] + [(77, 900.0)], "k int, v double")
    own = reward.CompletenessRetentionReward()
    own.reset(df)
    groups = {"impute": [impute.MeanImputer(columns=["v"], name="mean")], "outliers": [outliers.IQROutlierCleaner(columns=["v"], method="drop", name="iqr")], "scale": [scale.Log1pScaler(columns=["nope"], name="log")]}
    assert len(list(search.valid_pipelines(groups, 3))) == 1 + 3 + 6 + 6
    chosen, value = search.greedy_search(df, groups, own, 1)
    assert chosen["impute"].name == "mean" and chosen["outliers"] is None and value == pytest.approx(1)
    assert search.genetic_search(df, groups, own, 24, 3)[0][0] == pytest.approx(1)
    best, value, found = search.QLearner(groups, episodes=100).search(df, own)
    assert "mean" in best and len(found) == 4
    env = search.SequentialCleaningEnv(df, [a for g in groups.values() for a in g], own, profile.DataStatsObserver())
    env.reset()
    first, again = env.step(0), env.step(0)
    assert first.reward > 0 and again.reward == -1.0 and again.terminated
    assert search.PermutationsCleaningEnv(df, groups["impute"], own).step(0).reward == pytest.approx(1)
    steps = search.OfflineTransitions(env)
    assert steps.collect(3) and steps.fitted_q().shape == (3, 6) and steps.frame(spark).count() == len(steps.rows)
    scores = search.score_pipelines(df, list(search.valid_pipelines(groups, 1)), {"r": own})
    assert scores.where("pipeline = 'mean'").first().value == pytest.approx(1)
    protocol = search.NestedProtocol(["k"])
    parts = protocol.splits(df)
    assert sum(p.count() for p in parts) == df.count()
    assert len(search.weight_grid(0.5)) == 6


def test_registry_builds_everything(spark):
    for name in registry.ACTIONS:
        assert registry.action(name).name
    df = spark.createDataFrame([(i, float(i)) for i in range(20)], "k int, v double")
    out = registry.apply_to_dataset("normalisation", "MM", {"train": df, "test": df.limit(3)}, columns=["v"])
    assert out["train"].agg(F.max("v")).first()[0] == 1.0 and out["test"].count() == 3
    for family, own in registry.STRATEGIES.items():
        for name in own:
            assert registry.strategy(family, name).name == name


def test_sources(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("col1;col2;col3\n1;a;true\n2;NA;false\n3;c;true\n")
    df = loaders.CSVLoader(spark, "col3", file_path=str(path), read_csv_kwargs={"sep": ";", "na_values": "NA"}).load()
    assert df.count() == 3 and len(df.columns) == 3 and df.where("col2 is null").count() == 1
    for bad in ({}, {"file_path": "x", "dataset": df}):
        with pytest.raises(ValueError):
            loaders.CSVLoader(spark, **bad)
    with pytest.raises(FileNotFoundError):
        loaders.CSVLoader(spark, file_path="/no/such").load()
    with pytest.raises(ValueError):
        loaders.TableLoader(spark, str(path)).load()
    out = loaders.write_table(df, str(tmp_path), "cached", "v1")
    assert out.endswith("cached_v1.parquet")
    cached = loaders.CachedTableLoader(spark, "cached_v1", str(tmp_path), "col3", zero_as_null=("col1",)).load()
    assert dict(cached.dtypes)["col2"] == "bigint"
    lists = spark.createDataFrame([([1, 2],), ([3],)], "x array<int>")
    assert loaders.list_to_columns(lists, "x", 1.0).columns == ["x_item1", "x_item2"]
    times = loaders.convert_columns(spark.createDataFrame([("2017-01-02 06:30:00", "4.5")], "t string, n string")).first()
    assert (times.t_TIMESTAMP, times.t_DAYOFWEEK, times.t_HOUR, times.n) == (109800.0, 0, 6.5, 4.5)
    parts = loaders.train_test(df.drop("col3"), df, target="col3")
    assert parts["task"] == "classification" and parts["test"].columns == ["col1", "col2"]
    assert list(loaders.load_all({"a": loaders.CSVLoader(spark, file_path="/no/such"), "b": loaders.CSVLoader(spark, dataset=df)})) == ["b"]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-01 00:{i % 60:02d}:00", float(i)) for i in range(120)], "k int, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    rows.unionByName(rows.limit(5)).write.parquet(f"{tmp_path}/in")
    fitted = [scale.MinMaxScaler(columns=["v"]).fit(rows)]
    source = lambda: streams.read_table_stream(spark, f"{tmp_path}/in", rows.schema)
    with pytest.raises(RuntimeError):
        streams.apply_fitted(source(), [scale.MinMaxScaler(columns=["v"])])
    streams.run_to_memory(streams.apply_fitted(source(), fitted), "scaled")
    assert spark.table("scaled").agg(F.max("v")).first()[0] == 1.0
    streams.run_to_memory(streams.deduplicate(source(), ["k"], "ts"), "once")
    assert spark.table("once").count() == 120
    streams.run_to_memory(streams.windowed_quality(source(), "ts", "v", "10 minutes"), "quality", "complete")
    assert spark.table("quality").agg(F.sum("n")).first()[0] == 125
    streams.run_to_memory(streams.windowed_drift(source(), "ts", "v", 0, 120, [0.5, 0.5], "10 minutes"), "drift", "complete")
    assert spark.table("drift").count() == 6
    streams.run_to_memory(streams.sessions(source(), "ts", "k"), "sessions", "complete")
    assert spark.table("sessions").count() == 120
