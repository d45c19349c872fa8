"""Whitening of embeddings: principal components of quantised vectors, scaled to unit variance.

Two passes over the vectors give exact whole numbers: the sums per dimension, then the scatter of the vectors about
their rounded mean. Each task adds up one d x d matrix, and only sums of these matrices reach the driver. There the centred scatter is
factored by Cholesky with pivoting, and one-sided Jacobi rotations make the columns of the factor
orthogonal: their squared norms are the eigenvalues, their directions the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
# Entries beyond this size would leave the range in which doubles hold every whole number.
LARGEST = 2.0 ** 46
# Pivots below this share of the largest one are rounding errors of the factorisation.
RANK_TOLERANCE = 1e-13
_EXACT = 2.0 ** 53


def _vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part, all of one length."""
    usable = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter(
        F.coalesce(F.size("v") > 0, F.lit(False)) & F.forall("v", lambda c: F.coalesce(F.abs(c) <= LARGEST, F.lit(False)) & ~F.isnan(c)))
    lengths = usable.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    most = lengths.agg(F.max(F.struct("n", "d")).alias("m")).first()["m"]
    return usable.filter(F.size("v") == (most["d"] if most else 0))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _quantised(column: pa.Array, d: int) -> np.ndarray:
    return np.floor(SCALE * _matrix(column, d)).astype(np.int64) + OFFSET


def _exact_scatter(y: np.ndarray) -> np.ndarray:
    """y'y in whole numbers: by floating point where no sum can leave its exact range, else by arbitrary precision."""
    reach = float(np.abs(y).max(initial=0))
    if reach * reach * len(y) < _EXACT:
        f = y.astype(np.float64)
        return f.T @ f
    exact = y.astype(object)
    return exact.T @ exact


def _scatter_of_task(centre: np.ndarray, d: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(upper[0]), object)
        n = 0
        for batch in batches:
            if len(batch):
                total = total + np.array([int(q) for q in _exact_scatter(_quantised(batch.column("v"), d) - centre)[upper]], object)
                n += len(batch)
        if n:
            # 38 digits hold the sum of any number of rows that fits a table.
            yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array([str(q) for q in total], pa.string())], names=["i", "j", "q"])
    return run


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """Factor g with a = g g'; one column per pivot, largest remaining diagonal first, until only rounding errors are left."""
    rest = a.astype(np.float64).copy()
    d = len(rest)
    columns = []
    first = rest.diagonal().max(initial=0.0)
    for _ in range(d):
        diagonal = rest.diagonal()
        p = int(diagonal.argmax())
        if diagonal[p] <= RANK_TOLERANCE * first or diagonal[p] <= 0:
            break
        column = rest[:, p] / np.sqrt(diagonal[p])
        rest -= np.outer(column, column)
        rest[p, :] = rest[:, p] = 0.0
        columns.append(column)
    return np.array(columns).T if columns else np.zeros((d, 0))


def one_sided_jacobi(g: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Rotate pairs of columns until all are orthogonal; in each step of a round-robin all pairs are disjoint and turn at once."""
    g = g.copy()
    r = g.shape[1]
    if r < 2:
        return g
    seats = list(range(r + r % 2))
    half = len(seats) // 2
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(seats) - 1):
            pairs = [(a, b) for a, b in zip(seats[:half], reversed(seats[half:])) if max(a, b) < r]
            p, q = (np.array(s, dtype=int) for s in zip(*pairs))
            x, y = g[:, p], g[:, q]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            scale = np.sqrt(alpha * beta)
            turn = np.abs(gamma) > 1e-16 * scale
            worst = max(worst, float((np.abs(gamma[turn]) / scale[turn]).max(initial=0.0)))
            zeta = (beta - alpha) / (2 * np.where(turn, gamma, 1.0))
            t = np.where(turn, np.copysign(1.0, zeta) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            s = c * t
            g[:, p], g[:, q] = c * x - s * y, s * x + c * y
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if worst < 1e-15 * max(1.0, r / 8):
            break
    return g


@dataclass(frozen=True)
class Whitening:
    """What a fit has learned; its size depends on the vectors' length alone."""

    n: int
    sums: list[int]
    # Components as rows, by falling eigenvalue; the entry of largest size is positive.
    axes: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def d(self) -> int:
        return len(self.sums)

    def deviations(self, column: pa.Array) -> list[int | None]:
        """Sum over dimensions of (n * x - sum) squared for each vector, exact; None beyond the range of a long."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        near = _quantised(column, self.d) - whole
        rest = np.array([s % self.n for s in self.sums], np.int64)
        reach = (float(np.abs(near).max(initial=0)) + 1) * self.n
        if reach * reach * self.d < 2.0 ** 62:
            return ((near * self.n - rest) ** 2).sum(axis=1).tolist()
        gaps = near.astype(object) * self.n - rest.astype(object)
        return [v if v < 2 ** 63 else None for v in (gaps * gaps).sum(axis=1)]

    def project(self, column: pa.Array) -> np.ndarray:
        """Whitened values, one row per vector. Whole means are taken off first, so no digits are lost."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([(s % self.n) / self.n for s in self.sums])
        return ((_quantised(column, self.d) - whole) - part) @ (self.axes / np.sqrt(self.eigenvalues)[:, None]).T


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Components of the covariance of the quantised vectors (vec_id, v); None without vectors."""
    quantised = F.posexplode(F.transform("v", lambda c: F.floor(SCALE * c) + OFFSET)).alias("i", "x")
    sums = {r["i"]: (int(r["n"]), int(r["s"])) for r in vectors.select(quantised).groupBy("i").agg(
        F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("s")).collect()}
    if not sums:
        return None
    d, n = len(sums), sums[0][0]
    total = [sums[i][1] for i in range(d)]
    centre = [(2 * s + n) // (2 * n) for s in total]
    parts = vectors.select("v").mapInArrow(_scatter_of_task(np.array(centre, np.int64), d), "i int, j int, q string")
    scatter = np.zeros((d, d))
    off = [s - n * c for s, c in zip(total, centre)]
    for row in parts.groupBy("i", "j").agg(F.sum(F.col("q").cast("decimal(38,0)")).alias("q")).collect():
        # Whole numbers up to here: n times the scatter about the mean is n * q - (sum of one) * (sum of the other).
        scatter[row["i"], row["j"]] = scatter[row["j"], row["i"]] = (n * int(row["q"]) - off[row["i"]] * off[row["j"]]) / n
    rotated = one_sided_jacobi(pivoted_cholesky(scatter))
    squared = (rotated * rotated).sum(axis=0)
    order = np.argsort(-squared, kind="stable")[:components]
    axes = (rotated[:, order] / np.sqrt(squared[order])).T
    signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)]) if len(axes) else np.ones(0)
    return Whitening(n, total, axes * signs[:, None], squared[order] / n, float(np.trace(scatter)) / n)


def _identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened values' covariance less the identity, measured over all vectors."""
    k = len(model.axes)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, plain = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            if len(batch):
                w = model.project(batch.column("v"))
                products += w.T @ w
                plain += w.sum(axis=0)
        cells = [(i, j, products[i, j]) for i in range(k) for j in range(k)] + [(i, -1, plain[i]) for i in range(k)]
        yield pa.RecordBatch.from_pylist([{"i": i, "j": j, "s": s} for i, j, s in cells], pa.schema([("i", pa.int32()), ("j", pa.int32()), ("s", pa.float64())]))
    products, plain = np.zeros((k, k)), np.zeros(k)
    for row in vectors.select("v").mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        if row["j"] < 0:
            plain[row["i"]] = row["s"]
        else:
            products[row["i"], row["j"]] = row["s"]
    mean = plain / model.n
    return float(np.abs(products / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened values of every vector, one row per vector and component.

    Columns: vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error. Vectors
    that are null, empty, hold null or non-finite entries, or entries beyond 2 to the 46th, are left out, and so are
    those of another length than most (of equally common lengths the longest counts). Repeated rows count each; ids are not
    read and may be null. Directions without variance are no components, so there may be fewer than asked for; equal vectors
    have none and give no rows, as does an empty table. A deviation beyond the range of a long is null. Components of equal eigenvalues are any basis of their space. Other columns are not read.
    """
    vectors = _vectors(embeddings)
    model = fit(vectors, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.axes):
        return embeddings.sparkSession.createDataFrame([], schema)
    error, k = _identity_error(vectors, model), len(model.axes)
    explained = model.eigenvalues / model.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = len(batch)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.n)), pa.array(model.deviations(batch.column("v")), pa.int64()).take(each),
                pa.array(model.project(batch.column("v")).ravel() if m else np.zeros(0)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v").mapInArrow(project, schema)
