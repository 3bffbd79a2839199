"""Whitening of embeddings by Jacobi-Davidson on the covariance, which is never formed.

Components become whole numbers, so the sums S, the centred vectors n*x - S and their squared lengths are exact. The eigenproblem sees the
covariance V only through products V*W, each one pass over the stored vectors: every task centres its rows, multiplies them with a block
of columns W and back, and the partial sums are added by component.

Jacobi-Davidson works on a block of columns. A Rayleigh-Ritz step in the subspace gives Ritz pairs; leading pairs whose residual has
reached double precision are locked; for the others the correction equation (I - QQ')(V - t I)(I - QQ') s = -residual, with Q the locked
and the Ritz vectors, is solved by inner MINRES, all columns in step so that an iteration costs one pass; the corrections widen the
subspace, which is cut back to its best Ritz vectors when it is full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.integer_vectors import matrix, packed_vectors, sizes_of

Product = Callable[[np.ndarray], np.ndarray]
EPS = float(np.finfo(np.float64).eps)
OFFSET = 1_000_000
ROWS = 4_096  # rows that a task multiplies at a time


# --- Jacobi-Davidson on any symmetric operator that is given by its product with a block of columns

def _orthonormal(x: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of x add to those of `against`; columns that add nothing go."""
    size = np.linalg.norm(x, axis=0)
    x = x[:, size > 0] / size[size > 0]
    for _ in range(2):
        x = x - against @ (against.T @ x)
        left, strength, _ = np.linalg.svd(x, full_matrices=False)
        x = left[:, strength > 1e-10 * max(1.0, strength.max(initial=0))]
    return x[:, :max(0, x.shape[0] - against.shape[1])]


def minres(apply: Product, b: np.ndarray, steps: int, relative: float) -> np.ndarray:
    """Solutions of A x = b for symmetric A, a column at a time in step: one product with a block per iteration (Paige and Saunders)."""
    x, zero = np.zeros_like(b), np.zeros(b.shape[1])
    beta = np.linalg.norm(b, axis=0)
    start, live = beta.copy(), beta > 0
    v, v_old = np.where(live, b / np.where(live, beta, 1), 0), np.zeros_like(b)
    d, d_old = np.zeros_like(b), np.zeros_like(b)
    c, s, c_old, s_old, eta = zero + 1, zero.copy(), zero + 1, zero.copy(), beta.copy()
    between = zero.copy()
    for _ in range(steps):
        if not live.any():
            break
        w = apply(v) - between * v_old
        alpha = (v * w).sum(0)
        w = w - alpha * v
        after = np.linalg.norm(w, axis=0)
        # the new column of the tridiagonal matrix under the two rotations before it
        third = s_old * between
        second = s * alpha + c * c_old * between
        first = c * alpha - s * c_old * between
        size = np.hypot(first, after)
        live &= size > EPS * start
        safe = np.where(live, size, 1)
        c_new, s_new = np.where(live, first / safe, 1), np.where(live, after / safe, 0)
        d_new = np.where(live, (v - third * d_old - second * d) / safe, 0)
        x = x + np.where(live, c_new * eta, 0) * d_new
        eta = np.where(live, -s_new * eta, eta)
        live &= (np.abs(eta) > relative * start) & (after > EPS * start)
        v_old, v = v, np.where(after > 0, w / np.where(after > 0, after, 1), 0)
        d_old, d, c_old, s_old, c, s, between = d, d_new, c, s, c_new, s_new, after
    return x


def jacobi_davidson(apply: Product, size: int, wanted: int, steps: int = 8, most_rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues, falling, and unit eigenvectors (columns) of a positive semidefinite operator.

    All residuals end below 64 units of double precision of the largest eigenvalue, or where rounding in the products stops their fall
    (below 1e-11 of it); otherwise it raises.
    """
    wanted = min(wanted, size)
    locked, values = np.zeros((size, 0)), np.zeros(0)
    basis = _orthonormal(np.random.default_rng(13).normal(size=(size, min(size, wanted + 4))), locked)
    image, best, since = apply(basis), np.inf, 0
    for turn in range(most_rounds):
        small = basis.T @ image
        theta, turns = np.linalg.eigh((small + small.T) / 2)
        theta, turns = theta[::-1], turns[:, ::-1]
        basis, image = basis @ turns, image @ turns
        need = wanted - locked.shape[1]
        rest = image[:, :need] - basis[:, :need] * theta[:need]
        rest = rest - locked @ (locked.T @ rest)
        error, scale = np.linalg.norm(rest, axis=0), max(np.append(values, theta).max(initial=0), np.finfo(np.float64).tiny)
        since, best = (0, error.max()) if error.max() < 0.5 * best else (since + 1, best)
        precise = 64 * EPS * scale if since < 3 else 1e-11 * scale
        whole = basis.shape[1] + locked.shape[1] >= size
        ready = len(error) if whole and (error <= 1e-11 * scale).all() else int(np.argmin(np.append(error <= precise, False)))
        if ready:
            values, locked = np.append(values, theta[:ready]), np.hstack([locked, basis[:, :ready]])
            basis, image, theta, rest, best, since = basis[:, ready:], image[:, ready:], theta[ready:], rest[:, ready:], np.inf, 0
            need -= ready
        if not need:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        if basis.shape[1] + need > max(4 * wanted, 20):
            basis, image = basis[:, :2 * wanted], image[:, :2 * wanted]
        span = np.hstack([locked, basis[:, :need]])

        def projected(w: np.ndarray, shift: np.ndarray = theta[:need]) -> np.ndarray:
            w = w - span @ (span.T @ w)
            out = apply(w) - shift * w
            return out - span @ (span.T @ out)

        right = -(rest[:, :need] - span @ (span.T @ rest[:, :need]))
        move = minres(projected, right, steps, 2.0 ** -(turn + 2))
        fresh = _orthonormal(np.hstack([move, right]) if turn % 4 == 3 else move, np.hstack([locked, basis]))
        if not fresh.shape[1]:
            fresh = _orthonormal(np.random.default_rng(turn).normal(size=(size, need)), np.hstack([locked, basis]))
        if fresh.shape[1]:
            basis, image = np.hstack([basis, fresh]), np.hstack([image, apply(fresh)])
    raise RuntimeError("the eigenvectors did not reach double precision")


# --- centred products over the stored rows

def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for first in range(0, len(batch), ROWS):
            part = batch.slice(first, ROWS)
            yield part, matrix(part.column("v"), part.column("width").to_numpy(), int(part.column("size")[0].as_py())) + OFFSET


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for _, x in _matrices(batches):
        part = (x.astype(object) if x.size and len(x) * int(np.abs(x).max()) >= 1 << 62 else x).sum(0).astype(object)
        total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([str(t) for t in total], pa.string())], names=["j", "s"])


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n*x - S exactly: 64-bit whole numbers where they suffice, otherwise Python's."""
    if x.size and n * int(np.abs(x).max()) < 1 << 62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _mean_free(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return _centred(x, n, sums).astype(np.float64) / n


def _products(batches: Iterator[pa.RecordBatch], n: int, sums: np.ndarray, columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros(columns.shape)
    for _, x in _matrices(batches):
        y = _mean_free(x, n, sums)
        total += y.T @ (y @ columns)
    yield _cells(total)


def _cells(total: np.ndarray) -> pa.RecordBatch:
    j, c = np.indices(total.shape)
    return pa.RecordBatch.from_arrays([pa.array(j.ravel().astype(np.int32)), pa.array(c.ravel().astype(np.int32)), pa.array(total.ravel())], names=["j", "c", "x"])


def _added(cells: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Sums of partial matrices by cell: as many numbers reach the driver as the matrix has, whatever the number of tasks."""
    out = np.zeros(shape)
    for r in cells.groupBy("j", "c").agg(F.sum("x").alias("x")).collect():
        out[r["j"], r["c"]] = r["x"]
    return out


def _whitened(x: np.ndarray, n: int, sums: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return _mean_free(x, n, sums) @ axes


def _white_sums(batches: Iterator[pa.RecordBatch], n: int, sums: np.ndarray, axes: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros((1, axes.shape[1]))
    for _, x in _matrices(batches):
        total += _whitened(x, n, sums, axes).sum(0)
    yield _cells(total)


def _white_products(batches: Iterator[pa.RecordBatch], n: int, sums: np.ndarray, axes: np.ndarray, mean: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros((axes.shape[1], axes.shape[1]))
    for _, x in _matrices(batches):
        w = _whitened(x, n, sums, axes) - mean
        total += w.T @ w
    yield _cells(total)


def _deviations(batches: Iterator[pa.RecordBatch], n: int, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part, x in _matrices(batches):
        yield pa.RecordBatch.from_arrays([pa.array([str(d) for d in _deviation(x, n, sums)])], names=["d"])


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    y = _centred(x, n, sums)
    top = int(np.abs(y).max()) if y.size else 0
    return (y * y).sum(1) if y.dtype != object and top * top * y.shape[1] < 1 << 62 else (y.astype(object) ** 2).sum(1)


def _rows(batches: Iterator[pa.RecordBatch], n: int, sums: np.ndarray, axes: np.ndarray, explained: np.ndarray, error: float) -> Iterator[pa.RecordBatch]:
    k = axes.shape[1]
    for part, x in _matrices(batches):
        fits = [int(d) if d < 1 << 63 else None for d in _deviation(x, n, sums)]
        each = pa.array(np.repeat(np.arange(len(x)), k))
        yield pa.RecordBatch.from_arrays(
            [part.column("id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n, np.int64)),
             pa.array(fits, pa.int64()).take(each), pa.array(_whitened(x, n, sums, axes).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error))],
            names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


_CELLS = "j int, c int, x double"
_RESULT = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32, scale: float = 64.0) -> DataFrame:
    """Rows (id, component, n, deviation, whitened, explained, identity_error) for each vector and each component up to `components`.

    Vectors that are null or hold null or non-finite components are dropped; x = floor(scale * c) + 1,000,000. Vectors of different
    lengths are fit lists of their own. Repeated and null ids are rows like any other. Directions without variance cannot be scaled to
    one: a component whose eigenvalue is below 1e-12 of the largest has no rows, so equal vectors alone, a single vector and an empty
    table give none. `deviation` is null where it does not fit a long. Other columns are ignored.
    """
    rows = packed_vectors(vectors, id_col, vector_col, scale)
    result = None
    for size, n in sizes_of(rows):
        held = rows.where(F.col("size") == size).select("id", "size", "width", "v")
        found = held.mapInArrow(_totals, "j int, s string").groupBy("j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        sums = np.array([int(r["s"]) for r in sorted(found, key=lambda r: r["j"])], object)
        if not size or n < 2:
            continue
        spread = held.mapInArrow(partial(_deviations, n=n, sums=sums), "d string").agg(F.sum(F.col("d").cast("decimal(38,0)"))).first()[0]
        if not spread:
            continue
        trace = float(spread) / n / n / n

        def product(columns: np.ndarray, held: DataFrame = held, n: int = n, sums: np.ndarray = sums) -> np.ndarray:
            return _added(held.mapInArrow(partial(_products, n=n, sums=sums, columns=columns), _CELLS), columns.shape) / n

        values, axes = jacobi_davidson(product, size, components)
        axes, values = axes[:, values > 1e-12 * values[0]], values[values > 1e-12 * values[0]]
        axes, k = axes / np.sqrt(values), len(values)
        mean = _added(held.mapInArrow(partial(_white_sums, n=n, sums=sums, axes=axes), _CELLS), (1, k)) / n
        spread = _added(held.mapInArrow(partial(_white_products, n=n, sums=sums, axes=axes, mean=mean), _CELLS), (k, k)) / n
        error = float(np.abs(spread - np.eye(k)).max())
        part = held.mapInArrow(partial(_rows, n=n, sums=sums, axes=axes, explained=values / trace, error=error), _RESULT)
        result = part if result is None else result.union(part)
    if result is None:
        result = rows.sparkSession.createDataFrame([], _RESULT)
    return result.withColumnRenamed("id", id_col)
