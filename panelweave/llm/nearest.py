"""Approximate nearest neighbours by collision counting with query-aware hashing.

Rows are dealt by a hash of vec_id to shards of about SHARD_ROWS. A shard projects its vectors on M random lines and
sorts each line. A query opens a window around its own projection on every line and widens all of them together
(virtual rehashing: radius R means a half width of w R / 2); only a vector that lies in the windows of L lines or more is
verified by its exact distance. A shard ends when k verified vectors lie within R, or all are verified: a vector within R
is then missed with probability DELTA at most (by far less on average), and one beyond RATIO times R verified with
probability BETA. M and L follow from RATIO, DELTA and BETA by the usual tail bounds. R begins below the usual distance
to a k-th neighbour, that of SAMPLE of the shard's own vectors. There is no cap on candidates, and no other way to be one.

Every shard meets the queries in blocks of QUERY_BLOCK and returns k rows a query, so what is sent on is small. Vectors
without structure (all far from each other, as on a sphere of many dimensions) need windows over most of each line for any
recall worth the name, so work then grows with rows times queries whatever the parameters; the windows' share falls only
where near ones are much nearer than others.

Vectors that are null, zero, or hold null or non-finite numbers take no part; vectors of another length than the
query's aren't its candidates; null vec_ids take no part. A vec_id that repeats counts once, at its smallest distance;
a query that repeats is its smallest vector. Ties go to the smaller vec_id. Empty tables give no rows. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import materialise

SHARD_ROWS, QUERY_BLOCK, RATIO, DELTA, FAR_ROWS, STEP, SAMPLE = 16384, 16384, 1.4, 0.05, 400, 1.03, 32


def parameters(n: int, c: float = RATIO, delta: float = DELTA, far_rows: int = FAR_ROWS) -> tuple[float, int, int]:
    """(w, number of lines, collision threshold)."""
    below = NormalDist().cdf
    w = math.sqrt(8 * c * c * math.log(c) / (c * c - 1))
    p1, p2 = 1 - 2 * below(-w / 2), 1 - 2 * below(-w / (2 * c))
    beta = min(0.5, far_rows / max(n, 1))
    near, far = math.sqrt(math.log(1 / delta)), math.sqrt(math.log(2 / beta))
    m = math.ceil((near + far) ** 2 / (2 * (p1 - p2) ** 2))
    share = (far / near * p1 + p2) / (1 + far / near)
    return w, m, math.ceil(share * m)


class CollisionIndex:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int = 10, seed: int = 7):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], vectors[order]
        self.w, self.m, self.threshold = parameters(len(ids))
        rng = np.random.default_rng(seed)
        self.lines = rng.standard_normal((vectors.shape[1], self.m))
        p = (self.x @ self.lines).T
        self.order = np.argsort(p, axis=1, kind="stable").astype(np.int32)
        p = np.take_along_axis(p, self.order, axis=1)
        self.least, self.most = float(p.min()), float(p.max())
        self.shift = np.arange(self.m) * (self.most - self.least + 2)
        self.axis = (p - self.least + self.shift[:, None]).ravel()
        self.start = np.arange(self.m) * len(ids)
        some = [np.sort(self._distances(slice(None), self.x[i])) for i in rng.choice(len(ids), min(SAMPLE, len(ids)), replace=False)]
        # Of copies the distance is 0, whatever lies beyond them.
        kth = [x for x in (float(d[min(k, len(d) - 1)]) for d in some) if x > 0]
        self.first_radius = 0.9 * float(np.median(kth)) if kth else max((self.most - self.least) / self.m, 1e-300)

    def _place(self, values: np.ndarray, right: bool) -> np.ndarray:
        """searchsorted on every line at once: all lines lie one after another on one axis."""
        at = np.clip(values, self.least - 0.5, self.most + 0.5) - self.least + self.shift
        return np.searchsorted(self.axis, at, "right" if right else "left") - self.start

    def _distances(self, rows: np.ndarray | slice, q: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.x[rows] - q) ** 2).sum(axis=1))

    def search(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of the verified vectors, the query's own left out."""
        n = len(self.ids)
        done = np.zeros(n, bool)
        done[np.searchsorted(self.ids, query_id) : np.searchsorted(self.ids, query_id, "right")] = True
        at = q @ self.lines
        lo = self._place(at, False)
        hi = lo.copy()
        rows, found, counts, r = [], [], np.zeros(n, np.int64), self.first_radius
        while True:
            new_lo, new_hi = self._place(at - self.w * r / 2, False), self._place(at + self.w * r / 2, True)
            fresh = [self.order[i, a:b] for i, (a, b) in enumerate(zip(new_lo.tolist(), lo.tolist(), strict=True)) if b > a]
            fresh += [self.order[i, a:b] for i, (a, b) in enumerate(zip(hi.tolist(), new_hi.tolist(), strict=True)) if b > a]
            if fresh:
                counts += np.bincount(np.concatenate(fresh), minlength=n)
            lo, hi = np.minimum(lo, new_lo), np.maximum(hi, new_hi)
            c = np.flatnonzero((counts >= self.threshold) & ~done)
            done[c] = True
            rows.append(c)
            found.append(self._distances(c, q))
            if sum(int(np.count_nonzero(d <= r)) for d in found) >= k or bool(done.all()):
                return np.concatenate(rows), np.concatenate(found)
            r *= STEP


def _best(ids: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    o = np.lexsort((ids, dist))
    ids, dist = ids[o], dist[o]
    first = np.sort(np.unique(ids, return_index=True)[1])[:k]
    return ids[first], dist[first]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite & F.exists("x", lambda v: v != 0)
    )


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """vectors, queries: (vec_id, x). The k nearest found of each query: query_id, rank, vec_id, score."""
    queries = queries.groupBy("vec_id").agg(F.min("x").alias("x"))
    n, n_queries = vectors.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_queries // query_block))

    def dealt(df: DataFrame, own: str, count: int, other: str, others: int) -> DataFrame:
        # Both sides' keys must be of one type, or their hash partitions don't meet.
        key = F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int").alias(own)
        return df.select(F.size("x").alias("dim"), key, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other), "vec_id", "x")

    def work(key, left, right):
        out_q, out_v, out_s = [], [], []
        if left.num_rows and right.num_rows:
            dim = key[0].as_py()
            x = left.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            y = right.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            index = CollisionIndex(left.column("vec_id").to_numpy(), x, k)
            for q, v in zip(right.column("vec_id").to_pylist(), y, strict=True):
                rows, dist = index.search(q, v, k)
                ids, dist = _best(index.ids[rows], dist, k)
                out_q += [q] * len(ids)
                out_v += ids.tolist()
                out_s += dist.tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    keys = ["dim", "shard", "block"]
    left = dealt(vectors, "shard", shards, "block", blocks).groupBy(*keys)
    right = dealt(queries, "block", blocks, "shard", shards).groupBy(*keys)
    found = left.cogroup(right).applyInArrow(work, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = materialise(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


OP1_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
           WHERE len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INT) AS rank, vec_id, score FROM d
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
"""
