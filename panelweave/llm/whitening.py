"""Embedding whitening: principal components by blockwise TSQR and one-sided Jacobi rotations.

Entries become integers (``floor(scale * c) + offset``), so means and deviations are exact: with n distinct vectors and
sums S, the centred row is (n x - S) / n, its numerator an exact integer. The fit list holds each distinct vector once.

TSQR: every partition folds its centred rows, block by block, into one upper triangle R (a QR of R stacked on the block);
triangles meet FAN at a time in further rounds until one is left. No covariance is formed, so small deviations keep the
accuracy that squaring would cost. One-sided Jacobi then rotates pairs of R's columns (disjoint pairs at once, in
round-robin order) until all are orthogonal; the accumulated rotations are the components, column norms over sqrt(n) the
standard deviations. R has the square of the dimension, whatever the rows; it alone reaches the driver.

Directions without variance (standard deviation under TINY times the largest, as far as rounding goes) have no whitened
value and are left out, so fewer components than asked for may come back; with one distinct vector, none and no rows.

Nulls: rows whose vector is null or holds null or non-finite entries take no part, nor do entries too large for exact
integers (over 2^52 scaled) and vectors of another length than most (ties: than the longer). Null ids are kept. Repeated
rows get a row each but count once in the fit. ``deviation`` is null where it exceeds a long. An empty table gives no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialise

SCALE, OFFSET, COMPONENTS, FAN, BLOCK_ENTRIES, TINY = 64, 1000000, 16, 32, 1 << 18, 1e-10
OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """id, x of the rows that take part."""
    v = F.col(vector_col)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < float(1 << 52)))
    return table.where(fine).select(F.col(id_col), F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long") + offset).alias("x"))


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            size = max(1, BLOCK_ENTRIES * batch.num_rows // max(1, len(batch.column("x").flatten())))
            for low in range(0, batch.num_rows, size):
                part = batch.slice(low, size)
                yield part, matrix(part.column("x"))


@dataclass
class Mean:
    """n vectors with exact sums: n x - S is taken as n (x - base) - rest."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.base = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, rounded once at the end where integers below 2^53 allow."""
        d = x - self.base
        if self.n * (int(np.abs(d).max(initial=0)) + 1) < 1 << 53:
            return (self.n * d - self.rest) / self.n
        return d - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n x - S)^2, exact."""
        d = x - self.base
        if len(self.sums) * (self.n * (int(np.abs(d).max(initial=0)) + 1)) ** 2 < 1 << 63:
            return ((self.n * d - self.rest) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * a - b) ** 2 for a, b in zip(row, self.rest.tolist(), strict=True)) for row in d.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def mean_of(fit: DataFrame) -> Mean | None:
    def work(batches):
        n, sums = 0, None
        for _, x in blocks(batches):
            for low in range(0, len(x), 512):  # 512 entries under 2^53 add up in 64 bits
                part = x[low : low + 512].sum(axis=0).astype(object)
                sums = part if sums is None else sums + part
            n += len(x)
        if n:
            from decimal import Decimal

            values = pa.array([[Decimal(int(s)) for s in sums]], pa.list_(pa.decimal128(38, 0)))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), values], ["n", "sums"])

    parts = fit.mapInArrow(work, "n long, sums array<decimal(38,0)>").select("n", F.posexplode("sums"))
    rows = parts.groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").cast("decimal(38,0)").alias("s")).collect()
    rows.sort(key=lambda r: r.pos)
    return Mean(rows[0].n, [int(r.s) for r in rows]) if rows else None


def triangle(fit: DataFrame, mean: Mean, fan: int = FAN) -> np.ndarray:
    """R of the centred fit list."""
    d = len(mean.sums)

    def fold(parts: Iterator[np.ndarray]) -> np.ndarray:
        r = np.zeros((0, d))
        for part in parts:
            r = np.linalg.qr(np.vstack([r, part]), mode="r")
        return r

    def leaf(batches):
        r = fold(mean.centred(x) for _, x in blocks(batches))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()])], ["node", "r"])

    def join(key, table):
        r = fold(np.frombuffer(b).reshape(-1, d) for b in table.column("r").to_pylist())
        return pa.table({"node": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([r.tobytes()])})

    left = fit.rdd.getNumPartitions()
    found = fit.mapInArrow(leaf, "node long, r binary")
    while left > 1:
        left = -(-left // fan)
        found = found.withColumn("node", F.pmod("node", F.lit(left))).groupBy("node").applyInArrow(join, "node long, r binary")
    return fold(np.frombuffer(row.r).reshape(-1, d) for row in found.collect())


def rounds(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Round-robin: every pair of d columns once, disjoint pairs together."""
    ring, out = [*range(d), *([-1] if d % 2 else [])], []
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring, reversed(ring), strict=True)][: len(ring) // 2]
        pairs = [(min(p), max(p)) for p in pairs if -1 not in p]
        out.append((np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def one_sided_jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns), falling. Rotations go on until no pair is left to turn."""
    d = r.shape[1]
    u, v, order = r.T.copy(), np.eye(d), rounds(d)  # rows of u and v are the columns that are rotated
    turned, sweeps = d > 1, 0
    while turned:
        turned = False
        for p, q in order:
            a, b, c = (u[p] * u[p]).sum(1), (u[q] * u[q]).sum(1), (u[p] * u[q]).sum(1)
            on = np.abs(c) > 1e-15 * np.sqrt(a) * np.sqrt(b)
            if not on.any():
                continue
            p, q, zeta = p[on], q[on], (b[on] - a[on]) / (2 * c[on])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            # Rounding leaves pairs just over the bound; turns too small to change a double don't count.
            turned |= bool((np.abs(t) > 1e-15).any())
            cos = 1 / np.hypot(1, t)
            cos, sin = cos[:, None], (cos * t)[:, None]
            for w in (u, v):
                w[p], w[q] = cos * w[p] - sin * w[q], sin * w[p] + cos * w[q]
        sweeps += 1
        if sweeps > 100:
            raise ArithmeticError("Jacobi rotations don't converge")
    sigma = np.sqrt((u * u).sum(1))
    by = np.argsort(-sigma, kind="stable")
    return sigma[by], v[by].T


@dataclass
class Whitening:
    """What whitens a row: the mean, components as columns, their standard deviations and shares of the variance."""

    mean: Mean
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.mean.centred(x) @ self.components / self.deviations


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """``fit``: distinct vectors x of one length."""
    mean = mean_of(fit)
    if mean is None:
        return None
    sigma, v = one_sided_jacobi(triangle(fit, mean))
    keep = int((sigma > TINY * sigma[0]).sum()) if sigma[0] > 0 else 0
    keep = min(keep, components)
    share = sigma**2 / max((sigma**2).sum(), np.finfo(float).tiny)
    return Whitening(mean, v[:, :keep], sigma[:keep] / np.sqrt(mean.n), share[:keep])


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the fit list's whitened covariance minus the identity, measured in a pass over it."""
    k = len(model.deviations)

    def work(batches):
        total = np.zeros((k, k))
        for _, x in blocks(batches):
            w = model.whitened(x)
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["c"])

    rows = fit.mapInArrow(work, "c array<double>").select(F.posexplode("c")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    cov = np.zeros(k * k)
    for r in rows:
        cov[r.pos] = r.s / model.mean.n
    return float(np.abs(cov.reshape(k, k) - np.eye(k)).max(initial=0))


def apply_whitening(rows: DataFrame, model: Whitening, error: float, id_col: str = "vec_id") -> DataFrame:
    """A row for each vector and component."""
    k, n = len(model.deviations), model.mean.n

    def work(batches):
        for part, x in blocks(batches):
            m = len(x)
            take = pa.array(np.repeat(np.arange(m), k), pa.int64())
            yield pa.RecordBatch.from_arrays([
                part.column(id_col).take(take),
                pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, n), pa.int64()),
                pa.array(model.mean.deviation(x), pa.int64()).take(take),
                pa.array(model.whitened(x).ravel(), pa.float64()),
                pa.array(np.tile(model.explained, m), pa.float64()),
                pa.array(np.full(m * k, error), pa.float64()),
            ], [id_col, *(c.split(" ")[0] for c in OUT.split(", "))])

    return rows.mapInArrow(work, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, {OUT}")


def whiten(rows: DataFrame, id_col: str = "vec_id", components: int = COMPONENTS, name: Callable[[str], str] = "whitening-{}".format) -> DataFrame:
    """``rows``: id and integer vectors x, of any lengths."""
    rows = materialise(rows, name("rows"))
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    none = rows.sparkSession.createDataFrame([], f"{id_col} {rows.schema[id_col].dataType.simpleString()}, {OUT}")
    if sizes is None:
        return none
    rows = rows.where(F.size("x") == sizes.d)
    fit = materialise(rows.select("x").distinct(), name("fit"))
    model = fit_whitening(fit, components)
    if model is None or not len(model.deviations):
        return none
    return apply_whitening(rows, model, identity_error(fit, model), id_col)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
