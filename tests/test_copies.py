"""Tables with many copies of a row: what is found is that of all rows, and is worked out once for the copies."""

import numpy as np

from sievelake.operators import evaluate, outliers


def _copies(spark):
    """60 points on a coarse grid, each 1 to 12 times."""
    rng = np.random.default_rng(5)
    at = rng.integers(0, 12, (60, 2)).astype(float)
    rows = [(i, *map(float, at[p])) for i, p in enumerate(rng.permutation(np.repeat(np.arange(60), rng.integers(1, 13, 60))).tolist())]
    return rows, spark.createDataFrame(rows, "k long, x double, y double")


def test_dbscan_joins_points_not_copies(spark, monkeypatch):
    """F3, eval_dbscan: the pairs grew with the square of the copies."""
    from sievelake.plans import shared

    rows, df = _copies(spark)
    sizes, write = [], shared.written
    monkeypatch.setattr(shared, "written", lambda d, kind="stage": sizes.append((kind, (out := write(d, kind)).count())) or out)
    got = {r.k: r.cluster for r in evaluate.dbscan(df, "k", ["x", "y"], eps=1.0, least=9).collect()}
    assert max(n for kind, n in sizes if kind == "dbscan") <= max(len(rows), 60 * 9)
    x = np.array([r[1:] for r in rows])
    near = ((x[:, None] - x) ** 2).sum(2) <= 1
    core, label = near.sum(1) >= 9, np.arange(len(x))
    while True:
        new = np.array([min(label[near[i] & core]) if core[i] else label[i] for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    want = {i: (int(label[i]) if core[i] else int(min(label[near[i] & core])) if (near[i] & core).any() else None) for i in range(len(x))}
    assert got == want


def test_neighbours_of_copies_are_searched_once(spark, monkeypatch):
    """F8, outlier_lof_multivariate: every row met every other, copies too."""
    rows, df = _copies(spark)
    sizes, write = [], outliers.written
    monkeypatch.setattr(outliers, "written", lambda d, kind="stage": sizes.append((kind, (out := write(d, kind)).count())) or out)
    got = {(r.q, r.r): (r.d, r.distance) for r in outliers.nearest_rows(df, "k", ["x", "y"], 2, 64).collect()}
    x = np.array([r[1:] for r in rows])
    for i in range(len(x)):
        far = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(len(x)), far)).tolist() if j != i][:2]
        assert [got[i, r] for r in (1, 2)] == [(j, far[j]) for j in order]
    assert len(got) == 2 * len(x)
    assert dict(sizes)["found"] < len(got)


def test_a_row_meets_only_blocks_that_may_hold_its_neighbours(spark, monkeypatch):
    """F6, outlier_lof_multivariate: every row met every block."""
    held, write = {}, outliers.written
    monkeypatch.setattr(outliers, "written", lambda d, kind="stage": held.setdefault(kind, write(d, kind)))
    rng = np.random.default_rng(8)
    x = np.concatenate((np.round(rng.uniform(0, 50, (700, 2))), rng.normal(25, 1e-3, (50, 2)), [[1e4, 0.0]]))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(9999, None, 1.0)], "k long, x double, y double")
    got = {(r.q, r.r): (r.d, r.distance) for r in outliers.nearest_rows(df, "k", ["x", "y"], 3, 40).collect()}
    for i in range(len(x)):
        far = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(len(x)), far)).tolist() if j != i][:3]
        assert [got[i, r] for r in (1, 2, 3)] == [(j, far[j]) for j in order]
    assert len(got) == 3 * len(x)
    assert held["own-blocks"].selectExpr("sum(size(to))").first()[0] < 6 * len(x)  # of 19 blocks


def test_weights_stand_for_copies(spark):
    """F2, dist_row_energy, and F10, dist_mmd: each copy was projected, sorted and put through cosines by itself."""
    from sievelake.operators import prior

    _, df = _copies(spark)
    p, q = df.where("k % 3 > 0").select("x", "y"), df.where("k % 3 = 0").select("x", "y")
    few = [prior.counted_rows(side, ["x", "y"]) for side in (p, q)]
    assert few[0].count() <= 60 < p.count()
    assert np.allclose(prior.row_energy(*few, ["x", "y"], 4, weight="_w"), prior.row_energy(p, q, ["x", "y"], 4))
    assert np.allclose(prior.kernel_distance(*few, ["x", "y"], 0.1, 64, weight="_w"), prior.kernel_distance(p, q, ["x", "y"], 0.1, 64))


def test_extra_trees_read_copies_once(spark):
    """F7, select_extra_trees: every level read all rows twice."""
    from sievelake.operators import learners

    rows, df = _copies(spark)
    df = df.selectExpr("x", "y", "int(x + y > 11) AS label")
    trees = learners.ExtraTrees(["x", "y"], "label", n_estimators=2, max_depth=2)
    held = trees.counted(df)
    assert held.count() <= 60 < len(rows) == held.groupBy().sum("w").first()[0]
    trees.fit(df)
    assert np.allclose(trees.value[0, 0].sum(), 1.0) and trees.importances.sum() > 0


def test_a_sieve_lets_all_its_ids_through_and_loses_no_row(spark):
    from sievelake.plans.shared import Sieve

    rows = spark.createDataFrame([(i, f"t{i}") for i in [None, *range(-300, 300)]], "k int, t string")
    ids = spark.createDataFrame([(i,) for i in [None, *range(0, 5000, 7)]], "k long")
    for words in (1, 4, 1 << 20):  # from a sieve with every bit set
        sieve = Sieve(ids, words)
        through, back = ({r["t"] for r in part(rows, rows["k"]).collect()} for part in (sieve.through, sieve.held_back))
        assert through | back == {r["t"] for r in rows.collect()} and not through & back
        assert {f"t{i}" for i in range(0, 300, 7)} <= through
        assert sieve.table.count() <= words
    assert len(through) < 75  # 43 ids, the null and few others
    none = Sieve(ids.where("k > 99999"))
    assert none.through(rows, rows["k"]).count() == 0 and none.held_back(rows, rows["k"]).count() == 601
