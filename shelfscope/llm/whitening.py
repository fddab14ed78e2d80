"""Whitening of embeddings: their components by falling variance, scaled to variance one.

Entries are brought to a grid of whole numbers, so that equal vectors are equal exactly and sums are exact. The
distinct vectors are the fit list. Its centred scatter, one row of numbers per dimension, is all that reaches the
driver; there it is factored by Cholesky with pivots, and one-sided Jacobi rotations make the columns of the
triangular factor orthogonal: their squared norms are the scatter's eigenvalues, their directions the components.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import map_batches, map_partition
from shelfscope.session import cut_lineage

GRID, SHIFT = 64, 1_000_000  # an entry c becomes floor(GRID * c) + SHIFT
COMPONENTS = 16
SWEEPS = 60  # of Jacobi rotations; some ten are usual
EXACT = float(1 << 62)
_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """Of ``n`` distinct vectors with sums ``sums``: components as columns, their variances, the trace of the covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float

    def __post_init__(self):
        self.near = np.array([(2 * int(s) + self.n) // (2 * self.n) for s in self.sums], np.int64)  # whole numbers next to the means
        self.rest = np.array([int(s) - self.n * int(m) for s, m in zip(self.sums, self.near)], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near) - self.rest / self.n

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n * x - sum) squared, exactly; None beyond a long."""
        y = x - self.near
        size = np.abs(y).max(initial=0) * float(self.n) + np.abs(self.rest).max(initial=0)
        if size**2 * x.shape[1] < EXACT:
            return ((y * self.n - self.rest) ** 2).sum(axis=1).tolist()
        exact = [sum((int(v) * self.n - int(r)) ** 2 for v, r in zip(row, self.rest)) for row in y]
        return [d if d < 1 << 63 else None for d in exact]


def on_grid(embeddings: DataFrame) -> DataFrame:
    """vec_id and x, the vector as whole numbers; vectors that are null or hold null or non-finite entries drop out."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * GRID) + SHIFT)
    return embeddings.filter(F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def matrix_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def summed(vectors: DataFrame, part: Callable[[np.ndarray], np.ndarray], kind: str, rows: int) -> np.ndarray:
    """Sum of ``part(x)``, a matrix of ``rows`` rows, over all batches of x.

    Each task adds up its own batches; the tasks' matrices are dealt out by row and added there, so that what
    comes together anywhere is one matrix, whatever the number of vectors or tasks.
    """

    def per_task(batches: Iterator[pa.RecordBatch]):
        total = None
        for batch in batches:
            if batch.num_rows:
                found = part(matrix_of(batch))
                total = found if total is None else total + found
        if total is not None:
            yield {"row": np.arange(len(total), dtype=np.int32), "amounts": list(total)}

    def per_row(batches: Iterator[pa.RecordBatch]):
        totals = defaultdict(int)
        for batch in batches:
            for row, amounts in zip(batch.column("row").to_pylist(), batch.column("amounts")):
                totals[row] = totals[row] + amounts.values.to_numpy()
        if totals:
            yield {"row": list(totals), "amounts": list(totals.values())}

    schema = f"row int, amounts array<{kind}>"
    parts = map_partition(vectors.select("x"), per_task, schema)
    found = {r.row: r.amounts for r in map_partition(parts.repartition(rows, "row"), per_row, schema).collect()}
    return np.array([found[i] for i in range(rows)], np.int64 if kind == "long" else np.float64)


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """F with F F' = a, one column per unit of rank: rows in the order of the pivots form a lower triangle."""
    rest = a.astype(float).copy()
    size, columns = len(a), []
    least = size * np.finfo(float).eps * max(rest.diagonal().max(initial=0.0), 0.0)
    for _ in range(size):
        pivot = int(rest.diagonal().argmax())
        height = rest[pivot, pivot]
        if height <= least:
            break
        column = rest[:, pivot] / np.sqrt(height)
        rest -= np.outer(column, column)
        rest[pivot, :] = rest[:, pivot] = 0.0  # done exactly
        columns.append(column)
    return np.array(columns).T.reshape(size, len(columns))


def rounds_of_pairs(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n columns, in rounds in which each column meets one other."""
    even = n + n % 2
    ring, rounds = list(range(even)), []
    for _ in range(even - 1):
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[: even // 2], ring[::-1]) if max(a, b) < n]
        rounds.append((np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return rounds


def orthogonal_columns(factor: np.ndarray) -> np.ndarray:
    """One-sided Jacobi: rotate pairs of columns until all are orthogonal to working precision."""
    f = factor.copy()
    close = np.finfo(float).eps * np.sqrt(max(len(f), 1))
    rounds = rounds_of_pairs(f.shape[1])
    for _ in range(SWEEPS):
        turned = False
        for left, right in rounds:
            a, b = f[:, left], f[:, right]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            turn = np.abs(ab) > close * np.sqrt(aa * bb)
            if turn.any():
                turned = True
                i, j, a, b = left[turn], right[turn], a[:, turn], b[:, turn]
                zeta = (bb[turn] - aa[turn]) / (2 * ab[turn])
                tangent = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                cosine = 1 / np.hypot(1.0, tangent)
                f[:, i], f[:, j] = cosine * a - cosine * tangent * b, cosine * tangent * a + cosine * b
        if not turned:
            break
    return f


def principal_axes(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above zero, falling, and their unit eigenvectors as columns."""
    f = orthogonal_columns(pivoted_cholesky(scatter))
    values = (f * f).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order], f[:, order] / np.sqrt(values[order])


def fit_whitening(fit: DataFrame, size: int, components: int = COMPONENTS) -> tuple[Whitening, float]:
    """Whitening of the vectors of ``fit`` (x of ``size`` entries, distinct), and the largest error of its covariance."""
    counts = summed(fit, lambda x: np.vstack([x.sum(axis=0), np.full(size, len(x))]), "long", 2)
    mean = Whitening(int(counts[1, 0]), counts[0], np.zeros((size, 0)), np.zeros(0), 0.0)

    def scatter_of(x):
        y = mean.centred(x)
        return y.T @ y

    scatter = summed(fit, scatter_of, "double", size)
    values, axes = principal_axes((scatter + scatter.T) / 2)
    found = Whitening(mean.n, mean.sums, axes[:, :components], values[:components] / mean.n, scatter.trace() / mean.n)
    kept = len(found.variances)
    if not kept:
        return found, 0.0

    def products_of(x):
        w = found(x)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    products = summed(fit, products_of, "double", kept + 1) / found.n
    covariance = products[:kept] - np.outer(products[kept], products[kept])
    return found, float(np.abs(covariance - np.eye(kept)).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, or holds a null or non-finite entry, drop out; so do rows whose vector has not the
    commonest length (the longer of two as common), as they lie in no common space. Repeated rows, repeated and null
    ids and equal vectors have their own results each; equal vectors count once in the fit. There are as many components as
    the fit list's rank, if that is under ``components``: none for an empty table, empty vectors or a single distinct
    vector. ``deviation`` is null where it exceeds a long. Entries are below 2^50 in size. Further columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = on_grid(embeddings)
    length = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()  # one row per length
    if length is None or length.size == 0:
        return spark.createDataFrame([], _RESULT)
    rows = rows.filter(F.size("x") == length.size)
    found, error = fit_whitening(cut_lineage(rows.select("x").distinct()), length.size, components)
    kept = len(found.variances)
    if not kept:
        return spark.createDataFrame([], _RESULT)
    explained = found.variances / found.trace

    def apply(batch):
        if not batch.num_rows:
            return None
        x, each = matrix_of(batch), batch.num_rows
        return {
            "vec_id": [v for v in batch.column("vec_id").to_pylist() for _ in range(kept)],
            "component": np.tile(np.arange(1, kept + 1, dtype=np.int32), each),
            "n": np.full(each * kept, found.n),
            "deviation": [d for d in found.deviations(x) for _ in range(kept)],
            "whitened": found(x).ravel(),
            "explained": np.tile(explained, each),
            "identity_error": np.full(each * kept, error),
        }

    return map_batches(rows, apply, _RESULT)
