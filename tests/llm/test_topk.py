import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.llm import topk


@pytest.mark.parametrize("low", [-50, 0])
def test_against_brute_force(spark, low):
    rng = np.random.default_rng(3)
    x = rng.integers(low, 51, (700, 12))
    x[5] = x[6] = x[7]  # ties
    x[9] = 0
    ids = np.arange(700)
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(1))
    topk_rows = topk.SHARD_ROWS, topk.BLOCK_ROWS
    topk.SHARD_ROWS, topk.BLOCK_ROWS = 128, 3
    try:
        got = {}
        for r in topk.search(df, F.col("vec_id") % 50 == 0).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    finally:
        topk.SHARD_ROWS, topk.BLOCK_ROWS = topk_rows
    for q in range(0, 700, 50):
        s = x @ x[q]
        order = sorted((i for i in ids if i != q), key=lambda i: (-s[i], i))[:10]
        assert [got[q][k + 1] for k in range(10)] == [(i, s[i]) for i in order]


def test_unusable_vectors_ragged_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (100, None), (1, [float("nan"), 1.0]), (2, [None, 1.0]), (3, [float("inf"), 1.0]), (4, [3.0]), (4, [3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").where(topk.usable("embedding"))
    whole = df.select("vec_id", F.transform("embedding", lambda v: F.floor(1024.0 * v.cast("double")).cast("long")).alias("vector"))
    got = topk.search(whole, F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 4, 3 << 20), (0, 2, 4, 3 << 20)]
    assert topk.search(whole.limit(0), F.col("vec_id") % 100 == 0).count() == 0
