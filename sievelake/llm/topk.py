"""Exact top-k inner-product search by MaxScore.

A term is a dimension with a sign; its postings are the rows of a shard whose component has that sign, so a matching
term only adds to a score. Per query and shard, terms are split by the bounds of what they can add: those that together
cannot reach the k-th best score so far are non-essential. Essential postings are traversed; what can still compete is
probed in the other terms, largest bound first, and dropped once it cannot win; penalties of opposite signs are
subtracted exactly. The shards' best are merged.

Queries meet candidates in blocks: a group holds one shard of candidates and one block of queries, both of bounded
size, so neither grows with the tables.

Defined results: vectors that are null, or hold a null or non-finite component, take no part; a shorter vector counts as
zero beyond its end; a row never meets a candidate of its own id; repeated rows are candidates each; ties go to
the smaller id; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS, BLOCK_ROWS = 4096, 2048
HITS = "query_id long, vec_id long, score long"


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of one width, zero beyond a list's end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    for row, own in zip(out, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
        row[: len(own)] = own
    return out


class Shard:
    """Postings of a shard's rows by signed dimension, and the rows themselves for probing."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.postings, self.most = [], np.zeros((2, rows.shape[1]), np.int64)
        for d in range(rows.shape[1]):
            x = self.rows[:, d]
            up, down = np.flatnonzero(x > 0), np.flatnonzero(x < 0)
            self.postings.append(((up, x[up]), (down, -x[down])))
            self.most[:, d] = x[up].max(initial=0), (-x[down]).max(initial=0)

    def search(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best rows other than those of id `own`."""
        mine = np.arange(*np.searchsorted(self.ids, [own, own + 1]))
        dims = np.flatnonzero(query)
        weight, sign = np.abs(query[dims]), (query[dims] < 0).astype(int)
        bound = weight * self.most[sign, dims]
        order = np.argsort(-bound, kind="stable")
        dims, weight, sign, bound = dims[order], weight[order], sign[order], bound[order]
        left = np.concatenate((np.cumsum(bound[::-1])[::-1], [0]))  # what the terms from here on can add
        gains = np.zeros(len(self.ids), np.int64)
        gains[mine] = np.iinfo(np.int64).min // 2
        done, threshold = 0, None
        while done < len(dims) and (threshold is None or left[done] >= threshold):  # this term is essential
            rows, impacts = self.postings[dims[done]][sign[done]]
            gains[rows] += weight[done] * impacts
            done += 1
            if done % 8 == 0 or threshold is None and done == min(4, len(dims)):  # exact scores of the leaders raise the threshold
                lead = np.argpartition(-gains, min(2 * k, len(gains) - 1))[: 2 * k]
                lead = lead[gains[lead] >= 0]
                if len(lead) >= k:
                    best = np.partition(self.rows[lead] @ query, len(lead) - k)[len(lead) - k]
                    threshold = best if threshold is None else max(threshold, best)
        places = np.flatnonzero(gains >= 0 if threshold is None else gains + left[done] >= max(threshold, 0) if threshold > 0 else gains >= 0)
        score = self.rows[np.ix_(places, dims[:done])] @ query[dims[:done]]  # penalties included
        for at in range(done, len(dims) + 1, 8):
            if threshold is not None:
                keep = score + left[min(at, len(dims))] >= threshold
                places, score = places[keep], score[keep]
            own_dims = dims[at : at + 8]
            score = score + self.rows[np.ix_(places, own_dims)] @ query[own_dims]
        if len(places) > k:
            cut = np.partition(score, len(score) - k)[len(score) - k]
            keep = score >= cut
            places, score = places[keep], score[keep]
        order = np.lexsort((self.ids[places], -score))[:k]
        return places[order], score[order]


def usable(vector: str) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "vector") -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k best of all other rows. `vector_column` holds array<long>."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<long>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("id is not null and v is not null and not exists(v, x -> x is null)")
    n, asked, width = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("q"), 1)), F.max(F.size("v"))).first()
    shards, blocks, width = max(1, -(-n // SHARD_ROWS)), max(1, -(-asked // BLOCK_ROWS)), width or 0
    to = lambda what, count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(what)
    candidates = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"), to("block", blocks), "id", "v")
    queries = rows.where("q").select(F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), to("shard", shards), "id", "v")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = ([], [], [])
        if left.num_rows and right.num_rows:
            shard = Shard(left["id"].to_numpy(), matrix(left["v"], width))
            for own, query in zip(right["id"].to_pylist(), matrix(right["v"], width), strict=True):
                places, scores = shard.search(query, k, own)
                for out, x in zip(found, (np.full(len(places), own), shard.ids[places], scores), strict=True):
                    out.append(x)
        whole = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]
        return pa.table({"query_id": pa.array(whole[0], pa.int64()), "vec_id": pa.array(whole[1], pa.int64()), "score": pa.array(whole[2], pa.int64())})

    hits = candidates.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(run, HITS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
