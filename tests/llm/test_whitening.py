import math
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from sievelake.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_arithmetic_is_free_of_error():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=200) * 10.0 ** rng.integers(-8, 8, 200), rng.normal(size=200)
    for f, g in ((w.two_sum, lambda x, y: x + y), (w.two_product, lambda x, y: x * y)):
        high, low = f(a, b)
        assert all(Fraction(h) + Fraction(v) == g(Fraction(x), Fraction(y)) for x, y, h, v in zip(a, b, high, low, strict=True))
    high, low = w.folded((a, np.zeros(200)))
    exact = sum(map(Fraction, a))
    assert abs(Fraction(float(high)) + Fraction(float(low)) - exact) <= abs(exact) * Fraction(1, 10**28)


def brute(vectors):
    """Exact covariance by fractions, its components by numpy in extended precision."""
    x = [[math.floor(1024 * c) + 100000 for c in map(float, v)] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    cov = [[Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3) for j in range(d)] for i in range(d)]
    return x, s, cov


def test_whitening_matches_exact_covariance(spark):
    rng = np.random.default_rng(2)
    base = (rng.normal(size=(300, 10)) @ rng.normal(size=(10, 10))).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(base)] + [(0, base[0].tolist(), 1)] * 40
    bad = [(900, None, 0), (901, [1.0, None] + [0.0] * 8, 0), (902, [math.nan] * 10, 0), (903, [math.inf] * 10, 0)]
    kept = rows + [(904, [0.5] * 4, 0), (None, [0.25] * 10, 0)]  # a short one counts as zero beyond its end
    x, s, cov = brute([v + [0.0] * (10 - len(v)) for _, v, _ in kept])
    df = spark.createDataFrame(kept + bad, SCHEMA).repartition(40).withColumns({"id": F.lit("x"), "n": F.lit(1), "whitened": F.lit(2)})
    model = w.fit(df, "embedding", 8, 1024.0, 100000)
    assert model.n == len(kept) and model.sums == s
    for i in range(10):
        for j in range(10):
            got = Fraction(float(model.cov[0][i, j])) + Fraction(float(model.cov[1][i, j]))
            assert abs(got - cov[i][j]) <= Fraction(1, 10**22) * max(cov[i][i], cov[j][j])
    # A v = e v to the last digits, in exact arithmetic
    for k, e in enumerate(model.values):
        v = [Fraction(float(c)) for c in model.vectors[:, k]]
        miss = max(abs(sum(cov[i][j] * v[j] for j in range(10)) - Fraction(float(e)) * v[i]) for i in range(10))
        assert miss <= cov_norm(cov) * Fraction(1, 10**15) and abs(sum(c * c for c in v) - 1) < Fraction(1, 10**15)
    got = w.whiten(df, "vec_id", "embedding", 8, 1024.0, 100000).collect()
    assert len(got) == 8 * len(kept) and {r.component for r in got} == set(range(1, 9)) and {r.n for r in got} == {len(kept)}
    far = {}
    for (i, _, _), row in zip(kept, x, strict=True):
        far.setdefault(i, set()).add(sum((len(kept) * a - b) ** 2 for a, b in zip(row, s, strict=True)))
    assert all(int(r.deviation) in far[r.vec_id] for r in got)
    assert max(r.identity_error for r in got) < 1e-10 and len({r.identity_error for r in got}) == 1
    trace = float(sum(cov[i][i] for i in range(10)))
    assert all(abs(r.explained * trace / model.values[r.component - 1] - 1) < 1e-12 for r in got)
    mean = [Fraction(t, len(kept)) for t in s]
    want = {(i, k + 1): float(sum((a - m) * Fraction(float(c)) for a, m, c in zip(row, mean, model.vectors[:, k], strict=True))) / math.sqrt(model.values[k]) for (i, _, _), row in zip(kept, x, strict=True) for k in range(8)}
    assert all(abs(r.whitened - want[r.vec_id, r.component]) < 1e-12 for r in got)


def cov_norm(cov):
    return max(sum(abs(c) for c in row) for row in cov)


def test_close_eigenvalues_and_rank_deficient(spark):
    rows = [(i, [float(i % 7), 2.0 * (i % 7), 1.0], 0) for i in range(50)]
    got = w.whiten(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", 8, 1024.0, 100000).collect()
    assert len(got) == 150 and all((r.whitened is None) == (r.component > 1) for r in got) and got[0].identity_error < 1e-10
    one = w.whiten(spark.createDataFrame(rows[:1], SCHEMA), "vec_id", "embedding").collect()
    assert len(one) == 3 and all(r.whitened is None and r.identity_error is None and r.explained is None and r.deviation == 0 for r in one)
    values, vectors = w.components((np.diag([2.0, 2.0, 1.0]), np.zeros((3, 3))), 3)
    assert values.tolist() == [2, 2, 1] and np.allclose(vectors.T @ vectors, np.eye(3), atol=1e-15)


def test_large_entries_and_empty_table(spark):
    big = [(i, [1e30 if i % 2 else -1e30, 3.0], 0) for i in range(4)]
    got = w.whiten(spark.createDataFrame(big, SCHEMA), "vec_id", "embedding", 2, 1024.0, 100000).collect()
    assert {int(r.deviation) for r in got} == {4 * 4 * (1 << 104)}
    assert w.deviations(np.array([[5, 7]]), 3, [9, 21]) == [36]
    for rows in ([], [(1, None, 0)], [(1, [], 0)]):
        assert w.whiten(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding").count() == 0
