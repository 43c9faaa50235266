"""Fixtures with known answers, and invariants, for the data-preparation operators."""

import math

import pytest
from pyspark.sql import functions as F

from sievelake.functions import strings
from sievelake.operators import base, dedup, impute, inject, outliers, reduce, scale, select, validate


def col(df, name, order="k"):
    return [r[name] for r in df.orderBy(order).collect()]


@pytest.fixture(scope="module")
def spiky(spark):
    return spark.createDataFrame([(i, a, 1) for i, a in enumerate([10, 11, 12, 13, 14, 100])], "k int, A int, B int")


def test_column_selection(spark):
    df = spark.createDataFrame([(1, "a", 1.0, True)], "A int, B string, C double, D boolean")
    own = base.DummyAdd()
    assert own.select_columns(df, numeric_only=True) == ["A", "C", "D"]
    assert own.select_columns(df, numeric_only=False, categorical_only=True) == ["B"]
    assert base.DummyAdd(columns=["C", "Z"], exclude=["A"]).select_columns(df) == ["C"]


@pytest.mark.parametrize(("method", "want"), [("mask", [10, 11, 12, 13, 14, None]), ("drop", [10, 11, 12, 13, 14]), ("clip", [10, 11, 12, 13, 14, 17.5])])
def test_iqr(spiky, method, want):
    out = outliers.IQROutlierCleaner(columns=["A", "B"], method=method).fit_transform(spiky)
    assert col(out, "A") == want


def test_bad_method_and_fitless_mode(spiky):
    with pytest.raises(ValueError):
        outliers.IQROutlierCleaner(method="burn")
    assert col(outliers.IQROutlierCleaner(columns=["A"])(spiky), "A")[-1] is None


def test_zscore_keeps_constant_columns(spiky):
    out = outliers.ZScoreOutlierCleaner(columns=["A", "B"], threshold=1.5).fit_transform(spiky)
    assert col(out, "A")[-1] is None and col(out, "B") == [1] * 6


def test_fraction_guard_and_lof(spark):
    df = spark.createDataFrame([(i, float(i % 10), float(i % 7)) for i in range(60)] + [(99, 500.0, 3.0)], "k int, a double, b double")
    assert outliers.FractionOutlierCleaner(columns=["a", "b"], threshold=-1).fit_transform(df).count() == 60
    assert outliers.FractionOutlierCleaner(columns=["a", "b"], threshold=0.6).fit_transform(df).count() == 61
    assert outliers.GuardedRemoval(inner=outliers.IQROutlierCleaner(columns=["a"], factor=0.0, method="drop"), least=59).fit_transform(df).count() == 61
    assert 99 not in col(outliers.LocalOutlierFactorCleaner(columns=["b", "a"], key="k", n_neighbors=5, method="drop").fit_transform(df), "k")
    whole = outliers.LocalOutlierFactorCleaner(n_neighbors=3).factors(df.withColumn("v", F.col("k") * F.col("k") * 1.0), "v", "k").collect()
    parts = outliers.LocalOutlierFactorCleaner(n_neighbors=3, range_rows=15).factors(df.withColumn("v", F.col("k") * F.col("k") * 1.0), "v", "k").collect()
    assert {r.k: round(r.factor, 9) for r in whole} == {r.k: round(r.factor, 9) for r in parts}


def test_imputers(spark):
    df = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, None), (3, None, "y"), (4, 9.0, "y"), (5, float("nan"), "x"), (6, 4.0, "z")], "k int, v double, s string")
    assert col(impute.MeanImputer(columns=["v"]).fit_transform(df), "v")[2] == 4.0
    assert col(impute.MedianImputer(columns=["v"]).fit_transform(df), "v")[4] == 3.0
    assert col(impute.MFImputer(columns=["s"]).fit_transform(df), "s")[1] == "x"
    drawn = col(impute.RandomImputer(columns=["v"], key="k").fit_transform(df), "v")
    assert set(drawn) <= {1.0, 2.0, 4.0, 9.0} and drawn == col(impute.RandomImputer(columns=["v"], key="k").fit_transform(df), "v")
    with pytest.raises(ValueError):
        impute.MeanImputer(columns=["v"]).fit(df).transform(df.drop("v"))
    assert impute.DropMissing().transform(df).count() == 3
    own = impute.ParameterizedImputer(columns=["v"])
    with pytest.raises(ValueError):
        own.set_params(nonsense=1)
    assert own.clone_with(strategy="median").current_params()["strategy"] == "median" and own.params["strategy"] == "mean"


def test_knn_imputer(spark):
    df = spark.createDataFrame([(1, 1.0, 10.0), (2, 2.0, 20.0), (3, 3.0, None), (4, 4.0, 40.0), (5, None, None), (6, 50.0, 500.0)], "k int, a double, b double")
    for block in (2, 100):
        out = impute.KNNImputer(columns=["a", "b"], key="k", n_neighbors=2, block=block).fit_transform(df)
        b = dict(zip(col(out, "k"), col(out, "b"), strict=True))
        assert b[3] == pytest.approx(30.0) and b[5] == pytest.approx(142.5)


def test_regression_imputers_follow_a_line(spark):
    df = spark.createDataFrame([(i, float(i), 3.0 * i + 1 if i % 5 else None, float((i * 7) % 11)) for i in range(60)], "k int, a double, b double, c double")
    out = impute.EMImputer(columns=["a", "b", "c"]).fit_transform(df)
    assert max(abs(r.b - (3 * r.a + 1)) for r in out.collect()) < 0.1
    forest = impute.MICEImputer(columns=["a", "b", "c"], max_iter=1, n_estimators=20).fit_transform(df)
    assert max(abs(r.b - (3 * r.a + 1)) for r in forest.where("k % 5 = 0 and k between 5 and 50").collect()) < 25


def test_random_draws_reach_rare_values(spark):
    df = spark.range(12000).selectExpr("id k", "CASE WHEN id % 2 = 0 THEN null ELSE cast(id AS double) END v")
    kind = impute.RandomImputer(columns=["v"], key="k", block=1000)
    out = kind.fit_transform(df)
    drawn = [r.v for r in out.where("k % 2 = 0").collect()]
    assert out.columns == ["k", "v"] and len(drawn) == 6000 and all(v % 2 == 1 for v in drawn)
    assert len(set(drawn)) > 3000  # 6000 draws of 6000 values leave out a share of 1/e
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, kind.transform(df).collect()))


def test_chained_forests_go_on_until_nothing_moves(spark):
    rows = [(i, float(i) if i % 4 else None, 3.0 * i + 1 if i % 3 and i % 4 else None, float((i * 7) % 11)) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double")
    kind = impute.MICEImputer(columns=["a", "b", "c"], n_estimators=3).fit(df)
    assert 2 < kind.stats["rounds"] < 50 and len(kind.stats["models"]) == 2 * kind.stats["rounds"]
    assert kind.transform(df).where("a is null or b is null").count() == 0
    assert len(impute.MICEImputer(columns=["a", "b", "c"], n_estimators=3, max_iter=3, tol=0).fit(df).stats["models"]) == 6


def test_scalers(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 1000, "p"), (2, 10, 5.0, 2000, "q"), (3, 100, 50.0, 3000, "r")], "k int, a int, b double, c int, label string")
    out = scale.DecimalScaler(columns=["a", "b", "c"]).fit_transform(df)
    assert col(out, "a")[2] == 0.1 and col(out, "b")[2] == 0.5 and col(out, "c")[2] == 0.3 and col(out, "label") == ["p", "q", "r"]
    assert [scale.DecimalScaler.divisor(v) for v in (80, 512.3292, 100, 0, 0.05)] == [100, 1000, 1000, None, 1]
    assert sum(col(scale.ZScoreScaler(columns=["a"]).fit_transform(df), "a")) == pytest.approx(0)
    assert col(scale.MinMaxScaler(columns=["a"], feature_range=(-1, 1)).fit_transform(df), "a")[::2] == [-1, 1]
    assert col(scale.QuantileScaler(columns=["b"]).fit_transform(df), "b") == [0, 0.5, 1]
    assert col(scale.RobustScaler(columns=["c"]).fit_transform(df), "c") == [-1, 0, 1]
    assert col(scale.LabelEncoder(columns=["label"]).transform(df), "label") == [0, 1, 2]
    shifted = df.withColumn("a", F.col("a") - 50)
    assert col(scale.Log10Scaler(columns=["a"], shift_epsilon=1.0).fit_transform(shifted), "a")[0] == pytest.approx(0)
    assert all(math.isfinite(v) for m in ("box-cox", "yeo-johnson") for v in col(scale.PowerScaler(columns=["a"], method=m).fit_transform(shifted), "a"))


def test_scaled_column_keeps_order_on_unseen_rows(spark):
    train = spark.range(100).selectExpr("id k", "cast(id as double) v")
    other = spark.createDataFrame([(1, -5.0), (2, 50.0), (3, 500.0), (4, None)], "k int, v double")
    for kind in (scale.ZScoreScaler, scale.MinMaxScaler, scale.RobustScaler, scale.QuantileScaler):
        got = col(kind(columns=["v"]).fit(train).transform(other), "v")
        assert got[0] <= got[1] <= got[2] and got[3] is None


def test_exact_dedup(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", 1), (4, "b", 2)], "k int, s string, v int")
    by = {"columns": ["s", "v"], "key": "k"}
    assert [col(dedup.ExactDeduplicator(keep=k, **by).transform(df), "k") for k in ("first", "last", False, "odd")] == [[1, 3, 4], [2, 3, 4], [3, 4], [1, 3, 4]]


def test_jaccard_dedup(spark):
    df = spark.createDataFrame(list(enumerate(["apple banana orange", "apple banana", "strawberry kiwi", "orange banana apple"])), "k int, s string")
    keep = lambda t: col(dedup.JaccardSimilarityDeduplicator(columns=["s"], key="k", threshold=t).transform(df), "k")
    assert keep(0.5) == [0, 2] and keep(0.7) == [0, 1, 2]
    abc = spark.createDataFrame(list(enumerate(["A B C", "X Y Z", "C D E"])), "k int, s string")
    assert [dedup.JaccardSimilarityDeduplicator(columns=["s"], key="k", threshold=t).transform(abc).count() for t in (0.3, 0.1)] == [3, 2]


def test_approximate_dedup_chains(spark):
    df = spark.createDataFrame(list(enumerate(["John Doe", "Jon Doe", "John Do", "Alice Smith", None], 1)), "k int, name string")
    assert col(dedup.ApproximateDeduplicator(columns=["name"], key="k").transform(df), "k") == [1, 4, 5]
    assert col(dedup.ApproximateDeduplicator(columns=["name"], key="k", keep="last").transform(df), "k") == [3, 4, 5]


def test_string_similarities():
    assert strings.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert strings.damerau("ca", "ac") == 1 and strings.damerau_free("kitten", "sitting") == 3
    assert strings.token_sort_ratio("new york mets", "mets york new") == 1.0
    assert strings.common_subsequence("AGGTAB", "GXTXAYB") == 4
    assert strings.fingerprint_of("  Ünïted, states-OF the  United ") == "of states the united"


def test_selectors(spark):
    df = spark.createDataFrame([(10, 1, 5, "x", 1), (0, 1, 5, "x", 0), (10, 1, 1, "x", 1), (0, 1, 1, "x", 0), (10, 1, 5, "x", 1), (0, 1, 1, "x", 0)], "A int, B int, C int, D string, y int")
    chi = select.ChiSquareSelector(k=2, target="y").fit(df)
    assert chi.transform(df).columns == ["A", "C", "D", "y"] and chi.stats["scores"]["A"] == pytest.approx(30.0) and chi.stats["scores"]["C"] == pytest.approx(0.889, abs=1e-3)
    assert "B" not in select.VarianceThresholdSelector(target="y").fit(df).transform(df).columns
    with pytest.raises(RuntimeError):
        select.VarianceThresholdSelector().transform(df)
    assert select.CollinearitySelector(columns=["A", "y"], threshold=0.9).fit(df).stats["kept"] == ["A"]


def test_validation(spark):
    df = spark.createDataFrame([(10, 20, "A123", "Ok"), (11, 5, "A123", "Ok"), (12, 30, "B999", "Fail"), (13, 30, "bad", "Ok"), (14, 30, "C000", "Odd")], "ID int, Age int, Code string, Status string")
    config = {"columns": {"Age": {"checks": {"ge": 18}}, "Code": {"checks": {"regex": r"[A-Z]\d{3}$"}}, "Status": {"checks": {"isin": ["Ok", "Fail"], "sparkle": 1}}, "Gone": {}}}
    own = validate.SchemaValidator(schema_config=config)
    for _ in range(2):  # the configuration is not used up
        assert [r.ID for r in own.transform(df).orderBy("ID").collect()] == [10, 12]
    assert {r.check: r.failed for r in own.violations(df).collect()}["Age:ge"] == 1
    with pytest.raises(base.DataValidationError):
        validate.SchemaValidator(schema_config=config, strict=True).transform(df)
    assert validate.ConstraintChecker(constraints={"fields": {"Age": {"min": 1000}}}).transform(df).count() == 5
    found = validate.discover_constraints(df)["fields"]
    assert found["Age"] == {"type": "int", "min": 5, "max": 30, "sign": "positive", "max_nulls": 0} and found["Status"]["allowed_values"] == ["Fail", "Odd", "Ok"]
    assert validate.discover_patterns(df, "Code")[0] == "^[A-Z][0-9]+$"


def test_injection_repeats(spark):
    df = spark.range(2000).selectExpr("id k", "cast(id % 97 as double) a", "cast(id % 97 + id % 5 as double) b", "id % 3 y")
    for p in inject.generate_all_profiles():
        one, two = (inject.apply_error_profile(df, p, ["k"], "y") for _ in range(2))
        assert one.exceptAll(two).count() == 0
    assert len(inject.generate_all_profiles()) == 14
    share = inject.inject_mcar(df, 0.1, ["k"]).where("a is null").count() / 2000
    assert 0.07 < share < 0.13
    assert inject.inject_duplicates(df, 0.1, ["k"]).count() > 2100
    noisy = inject.inject_label_noise(df, 0.2, ["k"], "y").join(df.select("k", F.col("y").alias("z")), "k")
    assert 0.15 < noisy.where("y <> z").count() / 2000 < 0.25


def test_reduction_and_balancing(spark):
    df = spark.createDataFrame([(i, float(i), 2.0 * i, i % 10 == 0) for i in range(100)], "k int, a double, b double, rare boolean")
    out = reduce.PCAReducer(columns=["a", "b"], k=2).fit_transform(df)
    assert out.agg(F.var_pop("d1")).first()[0] == pytest.approx(0, abs=1e-9) and out.agg(F.avg("d0")).first()[0] == pytest.approx(0, abs=1e-9)
    assert reduce.RandomProjector(columns=["a", "b"], kind="sparse").fit_transform(df).columns == ["d0", "d1", "k", "rare"]
    balanced = reduce.SMOTEBalancer(columns=["a", "b"], key="k", target="rare").fit_transform(df)
    made = balanced.where("k is null").collect()
    assert 50 < len(made) < 110 and all(r.rare and r.b == pytest.approx(2 * r.a) for r in made)


def test_smote_neighbours_are_those_of_the_whole_class(spark):
    df = spark.createDataFrame([(i, float(i), i >= 100) for i in range(130)], "k int, a double, rare boolean")
    made = reduce.SMOTEBalancer(columns=["a"], key="k", target="rare", k=1, block=4).fit_transform(df).where("k is null").collect()
    own = range(100, 130)
    near = [sorted((abs(i - j), len(str(j)), str(j), j) for j in own if j != i)[0][3] for i in own]
    assert 40 < len(made) < 100 and all(any(min(i, j) <= r.a <= max(i, j) for i, j in zip(own, near, strict=True)) for r in made)
    assert max(min(abs(r.a - i) for i in own) for r in made) <= 0.5 and len({int(r.a) for r in made}) > 20


def test_fitting_together_is_fitting_apart(spiky):
    apart = [scale.ZScoreScaler(columns=["A"]).fit(spiky), outliers.IQROutlierCleaner(columns=["A"]).fit(spiky)]
    together = base.fit_together(spiky, [scale.ZScoreScaler(columns=["A"]), outliers.IQROutlierCleaner(columns=["A"])])
    assert [a.stats for a in apart] == [a.stats for a in together]
