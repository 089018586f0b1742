"""Whitening of embeddings by spectral divide and conquer.

1. Entries become whole numbers; each distinct vector enters the fit once.  Repeats are
   reduced in every task before the shuffle, so a vector that a third of all rows repeat is
   one row a task.
2. Sums and then centred products are added up per task and merged by a few tasks; the
   driver gets one matrix of each of these (``MERGERS``), whatever the number of rows.
3. The covariance's eigenvectors come from polar decompositions: with V - sI = UH, (U + I) / 2
   projects onto the components above s.  U is found by the QR-based, dynamically weighted
   Halley iteration (QDWH); orthonormal bases of both sides give two smaller matrices, which
   are split again until they are single numbers.
4. The components (a matrix of vector length times 16) travel to all tasks, which whiten every
   row and, for ``identity_error``, add up the covariance of the whitened fit list.

Only matrices whose size is the square of the vector length reach the driver.

Defined results: rows whose vector is null or holds null, NaN or infinite entries are left
out, and so are empty vectors.  Repeated rows are each whitened.  Vectors of different lengths
are fitted and whitened by themselves.  Entries beyond 2**52 / 64 count as that bound.
Directions without variance (up to rounding) are no components: a length with fewer than 16
others has fewer rows, one with a single distinct vector none.  ``deviation`` is null where
the exact sum exceeds a long.  An empty table gives an empty result.  Only the id and the
vector are read.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.llm.common import column_or_null, staged, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed values of the contract: scale, shift and number of components.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Entries are kept within this bound.
LARGEST = float(1 << 52)
#: Tasks that merge the sums of all others; so many matrices reach the driver.
MERGERS = 16
EPS = float(np.finfo(np.float64).eps)


def whole_numbers(
    vectors: DataFrame, column: str = "embedding", scale: int = SCALE, shift: int = SHIFT
) -> DataFrame:
    """vec_id and x (array of long) of each row that takes part."""
    entry = F.col("c")
    odd = F.exists(entry, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    bounded = lambda e: F.least(F.greatest(scale * e, F.lit(-LARGEST)), F.lit(LARGEST))
    return (
        vectors.select(
            column_or_null(vectors, "vec_id", "bigint").alias("vec_id"),
            column_or_null(vectors, column, "array<double>").alias("c"),
        )
        .where(entry.isNotNull() & (F.size(entry) > 0) & ~odd)
        .select(
            "vec_id",
            F.transform(entry, lambda e: F.floor(bounded(e)).cast("bigint") + F.lit(shift)).alias("x"),
        )
    )


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    x = batch.column("x")
    offsets = np.asarray(x.offsets)
    flat = np.asarray(x.values)
    lengths = np.diff(offsets)
    for d in np.unique(lengths):
        own = np.flatnonzero(lengths == d)
        yield own, flat[offsets[own][:, None] + np.arange(d)]


def sums_by_length(
    rows: DataFrame, part: Callable[[np.ndarray], np.ndarray | None], kind: str
) -> dict[int, np.ndarray]:
    """Sum over all vectors of ``part`` (of a matrix of vectors), per vector length.

    Tasks add up their own rows, ``MERGERS`` tasks what these return.
    """

    def add(held: dict[int, np.ndarray], dim: int, value: np.ndarray) -> None:
        held[dim] = held[dim] + value if dim in held else value

    def emit(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(list(held), pa.int32()),
                pa.array([v.astype(kind).tobytes() for v in held.values()], pa.binary()),
            ],
            ["dim", "total"],
        )

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, matrix in _by_length(batch):
                value = part(matrix)
                if value is not None:
                    add(held, matrix.shape[1], value)
        yield emit(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, total in zip(batch.column("dim").to_pylist(), batch.column("total"), strict=True):
                add(held, dim, np.frombuffer(total.as_buffer(), dtype=kind))
        yield emit(held)

    schema = "dim int, total binary"
    merged = rows.select("x").mapInArrow(of_task, schema).repartition(MERGERS).mapInArrow(merge, schema)
    out: dict[int, np.ndarray] = {}
    for r in merged.collect():  # MERGERS rows a vector length
        add(out, r["dim"], np.frombuffer(r["total"], dtype=kind))
    return out


class Fit:
    """Number, sums and components of the vectors of one length."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        #: mean = base + rest / n, so that differences to it lose no digits
        self.base = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = np.array([s % n for s in sums], dtype=np.int64)
        self.weights = np.empty((len(sums), 0))
        self.explained = np.empty(0)
        self.identity_error = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.weights

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n * x - S) ** 2."""
        near = self.n * self.centred(x)
        about = np.square(near).sum(axis=1)
        out: list[int | None] = [None] * len(x)
        safe = about < 4e18
        with np.errstate(over="ignore"):
            exact = np.square((x - self.base) * self.n - self.rest).sum(axis=1)
        for i in np.flatnonzero(safe).tolist():
            out[i] = int(exact[i])
        for i in np.flatnonzero(~safe & (about < 1e19)).tolist():
            t = [(int(v) - int(b)) * self.n - int(r) for v, b, r in zip(x[i], self.base, self.rest, strict=True)]
            total = sum(v * v for v in t)
            out[i] = total if total < 1 << 63 else None
        return out


# --- eigenvectors --------------------------------------------------------------------------


def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by the QDWH iteration."""
    n = len(a)
    eye = np.eye(n)
    x = a / np.linalg.norm(a)
    try:
        low = 1 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(max(low if np.isfinite(low) else 0.0, EPS / 16), 1.0)
    for _ in range(30):
        d = np.cbrt(4 * (1 - low * low) / low**4)
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low * low) / (low * low * root))) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
            now = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            solved = np.linalg.solve(eye + wc * (x.T @ x), x.T).T
            now = wb / wc * x + (wa - wb / wc) * solved
        low = min(1.0, low * (wa + wb * low * low) / (1 + wc * low * low))
        now = (now + now.T) / 2
        change = np.linalg.norm(now - x)
        x = now
        if change <= np.cbrt(5 * EPS) and 1 - low <= 10 * EPS:
            break
    return x


def _split(a: np.ndarray, shift: float) -> tuple[float, np.ndarray, int] | None:
    """What stays outside the blocks, an orthogonal basis, and how many of its directions
    lie above ``shift``; None if all or none do."""
    n = len(a)
    above = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
    k = int(round(float(np.trace(above))))
    if not 0 < k < n:
        return None
    basis = np.random.default_rng(n).standard_normal((n, k))
    for _ in range(3):
        basis, _ = np.linalg.qr(above @ basis)
    whole, _ = np.linalg.qr(basis, mode="complete")
    whole[:, :k] = basis
    return float(np.linalg.norm(whole[:, k:].T @ a @ whole[:, :k])), whole, k


def components_of(a: np.ndarray, scale: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix."""
    n = len(a)
    scale = float(np.linalg.norm(a)) if scale is None else scale
    diagonal = np.diag(a).copy()
    order = np.argsort(-diagonal, kind="stable")
    mean = float(diagonal.mean())
    spread = float(np.linalg.norm(a - mean * np.eye(n))) / np.sqrt(n)
    beside = float(np.linalg.norm(a - np.diag(diagonal)))
    if n == 1 or beside <= EPS * scale or spread <= EPS * scale:
        return diagonal[order], np.eye(n)[:, order]
    best = None
    for f in (None, 0.0, 0.3, -0.3, 0.7, -0.7, 0.1, -0.1):
        # not all eigenvalues lie on one side of their mean
        split = _split(a, float(np.median(diagonal)) if f is None else mean + f * spread)
        if split is not None and (best is None or split[0] < best[0]):
            best = split
        if best is not None and best[0] <= 4 * n * EPS * scale:
            break
    if best is None:
        return diagonal[order], np.eye(n)[:, order]
    _, whole, k = best
    values, vectors = [], []
    for own in (whole[:, :k], whole[:, k:]):
        inner = own.T @ a @ own
        e, w = components_of((inner + inner.T) / 2, scale)
        values.append(e)
        vectors.append(own @ w)
    e, w = np.concatenate(values), np.hstack(vectors)
    order = np.argsort(-e, kind="stable")
    return e[order], w[:, order]


# --- fit and use ---------------------------------------------------------------------------


def fit_whitening(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """Fit of each vector length to the distinct vectors."""
    half = 26

    def sums(x: np.ndarray) -> np.ndarray:
        high, low = x >> half, x & ((1 << half) - 1)
        return np.concatenate([[len(x)], high.sum(axis=0), low.sum(axis=0)])

    fits = {}
    for d, t in sums_by_length(distinct, sums, "<i8").items():
        high, low = t[1 : d + 1].tolist(), t[d + 1 :].tolist()
        fits[d] = Fit(int(t[0]), [(h << half) + v for h, v in zip(high, low, strict=True)])

    def products(x: np.ndarray) -> np.ndarray:
        c = fits[x.shape[1]].centred(x)
        return (c.T @ c).ravel()

    for d, t in sums_by_length(distinct, products, "<f8").items():
        fit = fits[d]
        cov = t.reshape(d, d) / fit.n
        cov = (cov + cov.T) / 2
        e, w = components_of(cov)
        use = min(components, int((e > d * EPS * max(float(e[0]), 0.0)).sum()))
        fit.weights = w[:, :use] / np.sqrt(e[:use])
        fit.explained = e[:use] / np.trace(cov) if use else np.empty(0)

    def whitened_products(x: np.ndarray) -> np.ndarray | None:
        fit = fits[x.shape[1]]
        if not len(fit.explained):
            return None
        w = fit.whitened(x)
        return (w.T @ w).ravel()

    for d, t in sums_by_length(distinct, whitened_products, "<f8").items():
        use = len(fits[d].explained)
        own = t.reshape(use, use) / fits[d].n
        fits[d].identity_error = float(np.abs(own - np.eye(use)).max())
    return fits


def whiten(
    vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row."""
    rows = staged(whole_numbers(vectors, column), "whole-numbers")
    distinct = staged(rows.select("x").distinct(), "fit-list")
    fits = fit_whitening(distinct, components)
    schema = (
        "vec_id bigint, component int, n bigint, deviation bigint, whitened double, "
        "explained double, identity_error double"
    )
    names = [f.split()[0] for f in schema.split(", ")]

    def use(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, x in _by_length(batch):
                fit = fits[x.shape[1]]
                k = len(fit.explained)
                if not k:
                    continue
                each = np.repeat(np.arange(len(own)), k)
                ids = batch.column("vec_id").take(pa.array(own))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))),
                        pa.array(np.full(len(each), fit.n)),
                        pa.array(fit.deviation(x), pa.int64()).take(pa.array(each)),
                        pa.array(fit.whitened(x).ravel()),
                        pa.array(np.tile(fit.explained, len(own))),
                        pa.array(np.full(len(each), fit.identity_error)),
                    ],
                    names,
                )

    return rows.mapInArrow(use, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their first 16 whitened components."""
    return whiten(table(spark, sf_dir, "embeddings"))
