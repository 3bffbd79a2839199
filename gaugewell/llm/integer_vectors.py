"""Embeddings as whole numbers: each component c becomes floor(scale * c), packed into as few bytes a component as a batch needs.

Inner products and sums of the packed components are exact, so results do not depend on the order in which tasks add.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.shared import bounded_batches, stored

MOST = 1 << 62  # components beyond this magnitude are refused
PACKED = "r long, id long, size int, width int, v binary"


def width_of(x: np.ndarray) -> int:
    """Bytes of the narrowest signed integer that holds all of x."""
    top = max(abs(int(x.min())), abs(int(x.max()) + 1)) if x.size else 0
    return next(w for w in (1, 2, 4, 8) if top <= 1 << (8 * w - 1))


def binary_rows(x: np.ndarray, width: int) -> pa.Array:
    """Each row of a matrix as one binary value of little-endian integers."""
    data = np.ascontiguousarray(x.astype(f"<i{width}"))
    offsets = np.arange(len(x) + 1, dtype=np.int64) * (x.shape[1] * width)
    return pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def matrix(v: pa.Array | pa.ChunkedArray, widths: np.ndarray, size: int) -> np.ndarray:
    """The whole numbers of packed rows that all have `size` components."""
    out = np.empty((len(v), size), np.int64)
    packed = v.to_pylist()
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        out[at] = np.frombuffer(b"".join(packed[i] for i in at), f"<i{width}").reshape(len(at), size)
    return out


def _pack(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        ends = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
        bad = np.append(0, np.cumsum(~np.isfinite(values)))
        good = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[ends[1:]] == bad[ends[:-1]])
        with np.errstate(over="ignore", invalid="ignore"):
            whole = np.floor(values * scale)
        sizes = np.diff(ends)
        for size in np.unique(sizes[good]):
            at = np.flatnonzero(good & (sizes == size))
            x = whole[ends[at][:, None] + np.arange(size)]
            if x.size and np.abs(x).max() > MOST:
                raise ValueError("a component is too large for a whole number of 64 bits")
            x = x.astype(np.int64)
            width = width_of(x)
            index = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(index), batch.column(1).take(index), pa.array(np.full(len(at), size, np.int32)), pa.array(np.full(len(at), width, np.int32)),
                 binary_rows(x, width)], names=["r", "id", "size", "width", "v"])


def packed_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """A written table (r, id, size, width, v) of the vectors that are not null and hold only finite components; r numbers the rows."""
    rows = vectors.select(F.monotonically_increasing_id().alias("r"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return stored(bounded_batches(rows).mapInArrow(partial(_pack, scale=scale), PACKED))


def sizes_of(rows: DataFrame) -> list[tuple[int, int]]:
    """(components, number of vectors), one for each length of vector."""
    return sorted((r["size"], r["count"]) for r in rows.groupBy("size").count().collect())
