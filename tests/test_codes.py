"""Codes of categories, fills by type, and classes of one size."""

import pytest
from pyspark.sql import functions as F

from sievelake.operators import impute, reduce, scale


def test_codes_of_categories(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "k int, s string")
    coder = scale.FrequencyEncoder(columns=["s"]).fit(df)
    assert {r.k: r.s for r in coder.transform(df).collect()} == {1: 2 / 3, 2: 2 / 3, 3: 1 / 3, 4: None}
    assert coder.transform(spark.createDataFrame([(9, "new")], "k int, s string")).first().s == 0.0
    dummies = scale.DummyCoder(columns=["s"]).fit(df)
    assert sorted(map(tuple, dummies.transform(df).collect())) == [(1, 1, 0), (2, 1, 0), (3, 0, 1), (4, 0, 0)] and dummies.transform(df).columns == ["k", "s_a", "s_b"]
    assert scale.DummyCoder(columns=["s"], drop_first=True).fit_transform(df).columns == ["k", "s_b"]
    with pytest.raises(ValueError):
        scale.DummyCoder(columns=["s"], most=1).fit(df)
    assert scale.FrequencyEncoder(columns=["s"]).fit_transform(df.limit(0)).count() == 0


def test_fills_by_type(spark):
    df = spark.createDataFrame([(None, None, None, None)], "a int, b double, c string, d boolean")
    assert tuple(impute.DefaultImputer(number=7).fit_transform(df).first()) == (7, 7.0, "missing", False)


def test_classes_of_one_size(spark):
    df = spark.range(300).select("id", F.when(F.col("id") < 20, "few").when(F.col("id") < 220, "many").when(F.col("id") < 290, "some").alias("y")).repartition(6)
    under = reduce.Undersampler(key="id", target="y").fit_transform(df)
    assert {r.y: r["count"] for r in under.groupBy("y").count().collect()} == {"few": 20, "many": 20, "some": 20}
    assert sorted(under.collect()) == sorted(reduce.Undersampler(key="id", target="y").fit_transform(df.coalesce(1)).collect())
    assert reduce.Undersampler(key="id", target="y").fit_transform(df.limit(0)).count() == 0
