"""Whitening of embeddings by LOBPCG: leading eigenvectors of a covariance that is never formed.

A vector's entries become whole numbers, so sums and means are exact. The covariance is known only by its products with
blocks of vectors: each task centres its rows, multiplies them with the block and back, and the tasks' sums, of the
block's own size, are added up in two levels. On the driver there are blocks of dimension x block columns, never rows of
the table. Each round does a Rayleigh-Ritz step on the iterate, its residuals and the directions before; it ends when the
residuals, by a fresh product, are within the tolerance. Then rows are projected and scaled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as S

from .text import stored

#: Components returned, columns iterated besides, largest residual over the largest eigenvalue, and rounds at most.
COMPONENTS, GUARD, TOLERANCE, ROUNDS = 32, 8, 1e-13, 500
#: A residual that does no longer shrink counts as certified from this bound on: sums of doubles end there.
ROUNDED = 1e-11
#: Entries are multiplied by SCALE and moved by SHIFT; products of more than BOUND in size are cut to it.
SCALE, SHIFT, BOUND = 64, 1_000_000, 2.0**52
#: Tasks of the second level of sums, and numbers of a table that a task multiplies at once.
SPREAD, NUMBERS = 16, 1 << 20


def fit_list(rows: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key and x, the whole numbers of each vector that is complete and finite, as a table."""
    c = F.col(column)
    whole = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    number = lambda v: F.floor(F.greatest(F.least(SCALE * v.cast("double"), F.lit(BOUND)), F.lit(-BOUND))) + SHIFT
    good = rows.select(key, column).filter(c.isNotNull() & whole)
    sizes = good.groupBy(F.size(c).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    return stored(good.filter((F.size(c) == d) & (F.size(c) > 0)).select(key, F.transform(c, number).alias("x")))


def blocks(batch: pa.RecordBatch):
    """First rows and matrices of a batch's rows, NUMBERS numbers at a time."""
    x = batch.column("x")
    d = max(1, len(x[0])) if len(x) else 1
    m = x.flatten().to_numpy().reshape(-1, d)
    step = max(1, NUMBERS // d)
    for a in range(0, len(m), step):
        yield a, m[a : a + step]


def summed(rows: DataFrame, f: Callable[[np.ndarray], np.ndarray], kind: type) -> np.ndarray | None:
    """The sum of f over all blocks of rows: in each task, then in SPREAD tasks, then on the driver; None without rows."""

    def each(batches):
        total = None
        for batch in batches:
            for _, m in blocks(batch):
                total = f(m) if total is None else total + f(m)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(kind).tobytes()], pa.binary())], ["sum"])

    def both(batches):
        total = None
        for batch in batches:
            for part in batch.column("sum"):
                part = np.frombuffer(part.as_buffer(), kind)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

    parts = rows.select("x").mapInArrow(each, "sum binary").repartition(SPREAD).mapInArrow(both, "sum binary").collect()
    return sum(np.frombuffer(p[0], kind) for p in parts) if parts else None


class Centre:
    """Sums of the fit list, by which rows are centred without rounding: the mean is base + rest / n, all whole numbers."""

    def __init__(self, n: int, total: list[int]):
        self.n, self.base = n, np.array([round(s / n) for s in total], np.int64)
        self.rest = np.array([s - n * b for s, b in zip(total, self.base.tolist(), strict=True)], np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n x - S)**2 of each row; None beyond 64 bits."""
        far = x - self.base
        most = int(np.abs(far).max(initial=0)) * self.n + int(np.abs(self.rest).max(initial=0))
        if most * most * x.shape[1] < 2**63:
            return ((far * self.n - self.rest) ** 2).sum(1).tolist()
        exact = ((far.astype(object) * self.n - self.rest.astype(object)) ** 2).sum(1)
        return [v if v < 2**63 else None for v in exact]


def centred(rows: DataFrame) -> Centre | None:
    total = summed(rows, lambda m: np.append(len(m), m.sum(0)), np.int64)
    return None if total is None else Centre(int(total[0]), total[1:].tolist())


def against(block: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what is left of block's columns without their parts in bases; columns of rounding go."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        for b in bases:
            block = block - b @ (b.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False) if block.size else (block, np.zeros(0), None)
    u = u[:, s > 1e-10]
    for b in bases:
        u = u - b @ (b.T @ u)
    return np.linalg.qr(u)[0] if u.size else u


def lobpcg(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, guard: int = GUARD, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The wanted largest eigenvalues, falling, and their unit eigenvectors, of the matrix that product multiplies with.

    Raises ArithmeticError if the residuals can't be certified in so many rounds.
    """
    m = min(d, wanted + guard)
    x = np.linalg.qr(np.random.default_rng(7).standard_normal((d, m)))[0]
    p = ap = np.zeros((d, 0))
    w, aw = np.zeros((d, 0)), np.zeros((d, 0))
    ax, last, stalled = product(x), np.inf, 0
    for _ in range(rounds):
        basis, image = np.hstack([x, w, p]), np.hstack([ax, aw, ap])
        gram = basis.T @ image
        value, c = np.linalg.eigh((gram + gram.T) / 2)
        value, c = value[::-1][:m], c[:, ::-1][:, :m]
        along = c.copy()
        along[:m] = 0
        q = against(along, c)
        x, ax, p, ap = basis @ c, image @ c, basis @ q, image @ q
        residual = ax - x * value
        worst = np.linalg.norm(residual[:, :wanted], axis=0).max() / max(value[0], np.finfo(float).tiny)
        if worst <= tolerance or (worst <= ROUNDED and worst >= last / 2):
            # certified by a fresh product, not by the images that were carried along
            x = np.linalg.qr(x)[0]
            ax, p, ap = product(x), np.zeros((d, 0)), np.zeros((d, 0))
            value = np.sum(x * ax, axis=0)
            residual = ax - x * value
            worst = np.linalg.norm(residual[:, :wanted], axis=0).max() / max(value[0], np.finfo(float).tiny)
            stalled += 1
            if worst <= tolerance or (worst <= ROUNDED and stalled > 1):
                return value[:wanted], x[:, :wanted]
        last = worst
        w = against(residual, x, p)
        aw = product(w) if w.shape[1] else np.zeros((d, 0))
    raise ArithmeticError(f"residuals of {worst:.1e} after {rounds} rounds")


def whiten(rows: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each usable row and component: key, component, n, deviation, whitened, explained, identity_error.

    A vector that is null, or holds null or an entry that isn't finite, has no rows; nor has an empty one, or one whose
    length isn't that of most vectors (of equally many, the longest). Components without variance (rank below the number
    asked for, one row, equal rows) can't be scaled and are left out, so such tables may give no rows, as an empty table
    does. Repeated rows count as often as they occur. deviation is null where 64 bits can't hold it. Extra columns are
    ignored.
    """
    table = fit_list(rows, key, column)
    centre = centred(table)
    kind = S.StructType([table.schema[key], *(S.StructField(c, t) for c, t in (("component", S.IntegerType()), ("n", S.LongType()), ("deviation", S.LongType()), ("whitened", S.DoubleType()), ("explained", S.DoubleType()), ("identity_error", S.DoubleType())))])
    if centre is None:
        return table.sparkSession.createDataFrame([], kind)
    sc, n, d = table.sparkSession.sparkContext, centre.n, len(centre.base)
    fixed = sc.broadcast(centre)

    def product(block: np.ndarray) -> np.ndarray:
        sent = sc.broadcast(block)

        def part(m: np.ndarray) -> np.ndarray:
            y = fixed.value.rows(m)
            return (y.T @ (y @ sent.value)).ravel()

        out = summed(table, part, np.float64).reshape(block.shape) / n
        sent.unpersist()
        return out

    value, vector = lobpcg(product, d, min(components, d))
    usable = value > max(value[0], 0) * 1e-12
    value, vector = value[usable], vector[:, usable]
    k = len(value)
    if not k:
        return table.sparkSession.createDataFrame([], kind)
    scaled = sc.broadcast(vector / np.sqrt(value))

    def moments(m: np.ndarray) -> np.ndarray:
        y = fixed.value.rows(m)
        w = y @ scaled.value
        return np.concatenate([[(y * y).sum()], w.sum(0), (w.T @ w).ravel()])

    sums = summed(table, moments, np.float64) / n
    error = float(np.abs(sums[1 + k :].reshape(k, k) - np.outer(sums[1 : k + 1], sums[1 : k + 1]) - np.eye(k)).max())
    explained = value / sums[0]

    def project(batches):
        for batch in batches:
            for a, m in blocks(batch):
                r = len(m)
                w = fixed.value.rows(m) @ scaled.value
                each = pa.array(np.repeat(np.arange(a, a + r), k))
                cols = [batch.column(key).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)), pa.array(np.full(r * k, n))]
                cols += [pa.array(fixed.value.deviation(m), pa.int64()).take(pa.array(np.repeat(np.arange(r), k))), pa.array(w.ravel()), pa.array(np.tile(explained, r)), pa.array(np.full(r * k, error))]
                yield pa.RecordBatch.from_arrays(cols, kind.names)

    return table.mapInArrow(project, kind)


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
