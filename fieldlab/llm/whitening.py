"""Embedding whitening by mixed-precision refinement of eigenvectors.

Entries become whole numbers, so sums over all vectors are exact and every
vector is centred before anything is multiplied. The covariance is summed in
tasks. Its eigenvectors are first taken in float32 and then corrected by
matrix products in higher precision (Ogita and Aishima); each step squares the
error. Eigenvalues too close for a step to tell apart form a cluster, whose
own small problem, shifted to its centre so that float32 sees the differences,
is solved first.

Rows whose vector is null or holds null or non-finite entries (or entries of
2**54 and more in size, which have no whole number here) have no result and
take no part in the fit. Shorter vectors count as filled up with zeros.
Repeated rows count each, and each gets its rows; a null id is kept. A
component without variance has `whitened` null (with fewer vectors than
dimensions there are some); of one vector all are, and `explained` with them,
and `identity_error` is that of the components that have variance, or null. An
empty table gives no rows. `deviation` is null where it is too large for a
long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlab.llm.common import Scratch, by_value, table
from fieldlab.llm.vectors import fold, packed, unpacked, width_of

#: Fixed values of the whole numbers: entries are scaled, cut down and moved up.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
STEPS = 40
#: Sub-solves of one cluster: what doesn't come apart after these are equal eigenvalues. A correction below DONE is the last.
TRIES, DONE = 3, 1e-10
RAW = "<i8"
LOW_BITS = 31
#: Share of the trace below which a component has no variance.
FLAT = 1e-13


# ---- eigenvectors of a small symmetric matrix -------------------------------------
def clusters(values: np.ndarray, width: float) -> list[np.ndarray]:
    """Groups of two or more eigenvalues, each within `width` of the next."""
    order = np.argsort(values, kind="stable")
    cut = np.flatnonzero(np.diff(values[order]) > width) + 1
    return [g for g in np.split(order, cut) if len(g) > 1]


def measured(a: np.ndarray, x: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Of approximate eigenvectors: what they lack to be orthonormal, the matrix in their terms, eigenvalues, and how far off those may be."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    s, r = (s + s.T) / 2, (r + r.T) / 2  # else rounding over a small gap makes columns less orthogonal
    values = np.diag(s) / (1 - np.diag(r))
    return r, s, values, float(np.linalg.norm((s - np.diag(values)).astype(np.float64), 2)) + norm * float(np.linalg.norm(r.astype(np.float64), 2))


def eigenvectors(matrix: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, unit eigenvectors as columns) to double precision."""
    high = np.longdouble
    size = float(np.abs(matrix).max(initial=0))
    d = len(matrix)
    if size == 0:
        return np.zeros(d), np.eye(d)
    a = np.asarray(matrix, dtype=high) / high(size)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(high)
    one, noise = np.eye(d, dtype=high), d * float(np.finfo(high).eps)
    norm = float(np.linalg.norm(a.astype(np.float64), 2))
    solved: dict[tuple[int, ...], int] = {}
    for _ in range(steps):
        r, s, values, off = measured(a, x, norm)
        close = [tuple(sorted(g)) for g in clusters(values.astype(np.float64), 2 * off)] if off > noise * norm else []
        todo = [list(g) for g in close if solved.get(g, 0) < TRIES]
        if todo:  # sub-solves of clusters that a step can't tell apart
            x = x + x @ (r / 2)
            for g in todo:
                own = x[:, g]
                centre = values[g].mean()
                small = own.T @ (a @ own - centre * own)
                top = np.abs(small).max()
                if top > 0:
                    x[:, g] = own @ np.linalg.eigh((small / top).astype(np.float32))[1].astype(high)
                solved[tuple(g)] = solved.get(tuple(g), 0) + 1
            r, s, values, off = measured(a, x, norm)
        apart = values[None, :] - values[:, None]
        tell = np.abs(apart) > 2 * off
        e = np.where(tell, (s + values[None, :] * r) / np.where(tell, apart, 1), r / 2)
        x = x + x @ e
        if not todo and float(np.abs(e).max()) < DONE:  # the error that is left is its square
            break
    x = x + x @ ((one - x.T @ x) / 2)
    values = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    return (values[order] * high(size)).astype(np.float64), x.astype(np.float64)


# ---- the fit -----------------------------------------------------------------------
def whole_numbers(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    fits = (np.abs(x) < 2.0**54).all(axis=1)
    return np.floor(np.where(fits[:, None], x, 0) * SCALE).astype(np.int64) + SHIFT, fits


class Centre:
    """Exact sums of n vectors: n * x - S and x - S / n without a rounded mean."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = [s % n for s in sums]

    def of(self, raw, width: int) -> np.ndarray:
        """x - S / n in double precision."""
        return (unpacked(raw, width, RAW) - self.whole) - np.array([r / self.n for r in self.rest])

    def deviation(self, raw, width: int) -> list[int | None]:
        """Sum over dimensions of (n * x - S) ** 2; None beyond a long."""
        x = unpacked(raw, width, RAW) - self.whole
        most = (int(np.abs(x).max(initial=0)) + 1) * self.n
        if most * most * max(1, width) < 1 << 63:
            whole = x * self.n - np.array(self.rest, dtype=np.int64)
            return (whole * whole).sum(axis=1).tolist()
        exact = [sum((self.n * c - r) ** 2 for c, r in zip(row, self.rest)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def centre_of(rows: DataFrame, width: int) -> Centre | None:
    """rows: raw, none null. Sums are taken in two halves, so they hold for any number of vectors."""

    def halves(batch: pa.RecordBatch) -> np.ndarray:
        x = unpacked(batch.column(0).to_pylist(), width, RAW)
        return np.concatenate([[len(x)], (x >> LOW_BITS).sum(axis=0), (x & ((1 << LOW_BITS) - 1)).sum(axis=0)])

    found = fold(rows, halves, kind=RAW)
    if found is None:
        return None
    n, hi, lo = int(found[0]), found[1 : 1 + width].tolist(), found[1 + width :].tolist()
    return Centre(n, [(h << LOW_BITS) + v for h, v in zip(hi, lo)])


def covariance(rows: DataFrame, width: int, centre: Centre) -> np.ndarray:
    """Over all rows, divisor n; a d x d matrix a task, summed in tasks."""

    def products(batch: pa.RecordBatch) -> np.ndarray:
        z = centre.of(batch.column(0).to_pylist(), width)
        return z.T @ z

    total = fold(rows, products).reshape(width, width) / centre.n
    return (total + total.T) / 2


def identity_error(rows: DataFrame, width: int, centre: Centre, project: np.ndarray) -> float:
    """Largest absolute entry of the projected rows' covariance minus the identity."""
    k = project.shape[1]

    def products(batch: pa.RecordBatch) -> np.ndarray:
        w = centre.of(batch.column(0).to_pylist(), width) @ project
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    found = fold(rows, products) / centre.n
    return float(np.abs(found[k:].reshape(k, k) - np.outer(found[:k], found[:k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row per vector and component, by falling variance."""
    width = width_of(vectors, vec_col)
    rows = packed(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")), ["id"], "v", width, whole_numbers).where("raw IS NOT NULL")
    rows = Scratch(vectors.sparkSession, "whitening").keep(rows, "vectors")
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    named = lambda out: out.withColumnRenamed("id", id_col)
    centre = centre_of(rows.select("raw"), width) if width else None
    if centre is None:
        return named(vectors.sparkSession.createDataFrame([], schema))
    v = covariance(rows.select("raw"), width, centre)
    values, axes = eigenvectors(v)
    k, trace = min(components, width), float(np.trace(v))
    values, axes = values[:k], axes[:, :k]
    varies = values > FLAT * trace
    project = axes[:, varies] / np.sqrt(values[varies])
    error = identity_error(rows.select("raw"), width, centre, project) if varies.any() else None
    explained = [float(e) / trace if trace > 0 else None for e in values]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                raw, m = part.column(1).to_pylist(), part.num_rows
                w = np.full((m, k), np.nan)
                w[:, varies] = centre.of(raw, width) @ project
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, centre.n, np.int64)),
                        pa.array(centre.deviation(raw, width), pa.int64()).take(pa.array(each)), pa.array(w.ravel(), mask=np.isnan(w.ravel())),
                        pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return named(rows.mapInArrow(work, schema))


def op12_embedding_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))


by_value(__name__)
