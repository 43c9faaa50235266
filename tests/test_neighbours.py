"""Mutual information by neighbours, against the plain estimator over all pairs."""

import math

import numpy as np
import pytest

from sievelake.operators import neighbours, select


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def plain(x, y, k=3):
    """All pairs; rows are (value, class)."""
    x, y = np.asarray(x, float), np.asarray(y)
    sizes = {c: int((y == c).sum()) for c in set(y.tolist())}
    own = np.array([sizes[c] > 1 for c in y.tolist()], bool)
    x, y = x[own], y[own]
    if not len(x):
        return None
    total = psi(len(x))
    for i in range(len(x)):
        far = np.abs(x - x[i])
        same = np.sort(np.delete(far, i)[np.delete(y, i) == y[i]])
        kk = min(k, len(same))
        r = same[kk - 1]
        m = int((far < r).sum()) if r > 0 else int((far == 0).sum())
        total += (psi(kk) - psi(len(same) + 1) - psi(m)) / len(x)
    return max(0.0, total)


def test_digamma():
    assert np.allclose(neighbours.digamma(np.array([1, 2, 3, 10, 1000])), [psi(i) for i in (1, 2, 3, 10, 1000)], rtol=0, atol=1e-14)


@pytest.mark.parametrize("range_rows", [7, 300, 4096])
def test_mutual_information_equals_all_pairs(spark, range_rows):
    rng = np.random.default_rng(4)
    n = 150 if range_rows == 7 else 2000
    y = rng.choice(["a", "b", "c"], n, p=[0.6, 0.38, 0.02])
    y[0] = "alone"
    columns = {"near": rng.normal(size=n) + 2 * (y == "a"), "noise": rng.random(n), "ties": rng.integers(0, 9, n).astype(float), "few": np.where(rng.random(n) < 0.95, np.nan, rng.normal(size=n)), "hot": np.where(rng.random(n) < 0.4, 5.0, rng.normal(size=n)), "none": np.full(n, np.nan)}
    rows = [(i, str(c), *(None if math.isnan(v[i]) else float(v[i]) for v in columns.values())) for i, c in enumerate(y)]
    rows += [(n, None, *[1.0] * 6), (n + 1, "a", *[None] * 6)]
    df = spark.createDataFrame(rows, "k long, y string, " + ", ".join(f"{c} double" for c in columns)).repartition(5)
    got = neighbours.mutual_information(df, list(columns), "y", 3, range_rows)
    for c, v in columns.items():
        seen = ~np.isnan(v)
        want = plain(v[seen], y[seen])
        assert got[c] is None if want is None else abs(got[c] - want) < 1e-9, c


def test_selector_tells_equal_values_apart(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 2), float(i % 2 * 3 + rng.integers(0, 4)), float(rng.integers(0, 4))) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, y int, tied double, noise double")
    pick = select.MutualInformationSelector(columns=["noise", "tied"], target="y", k=1, key="k", range_rows=100).fit(df)
    scores = pick.stats["scores"]
    assert pick.stats["kept"] == ["tied"] and scores["tied"] > 0.4 and scores["noise"] < 0.1
    again = select.MutualInformationSelector(columns=["noise", "tied"], target="y", k=1, key="k").fit(df.repartition(7)).stats["scores"]
    assert all(abs(scores[c] - again[c]) < 1e-12 for c in scores)
    assert pick.transform(df).columns == ["tied", "k", "y"]
    nothing = select.MutualInformationSelector(columns=["noise"], target="y").fit(df.limit(0))
    assert nothing.stats["scores"] == {"noise": None}


def test_rows_are_dealt_before_their_values_are_counted(spark, monkeypatch):
    """A file of many rows is one task of a scan; the tasks that count and sort its values hold no more for it."""
    from sievelake.operators import neighbours

    frames = {}
    real = neighbours.written

    def kept(df, kind):
        if kind == "edges":
            frames[kind] = df.rdd.getNumPartitions()
        return real(df, kind)

    monkeypatch.setattr(neighbours, "written", kept)
    df = spark.range(0, 4000, 1, 1).selectExpr("id", "cast(id * 7919 % 4001 as double) a", "cast(id * 104729 % 4001 as double) b", "id % 2 y")
    got = neighbours.mutual_information(df, ["a", "b"], "y", 3, range_rows=500)
    sizes = neighbours.dealt(df, 1000).rdd.glom().map(len).collect()
    assert len(sizes) == 4 and sum(sizes) == 4000 and max(sizes) < 1300
    assert frames["edges"] == 16  # 8000 values, 500 to a range
    whole = neighbours.mutual_information(df, ["a", "b"], "y", 3)
    assert all(abs(got[c] - whole[c]) < 1e-9 for c in got)
