"""Arrow batches and numpy: lists as matrices, packed vectors, and the rows of a key together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def flat_list(col: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Start and length of each list, and the values they point into; a null list has length 0."""
    offsets = col.offsets.to_numpy()
    length = np.diff(offsets)
    if col.null_count:
        length = np.where(col.is_null().to_numpy(zero_copy_only=False), 0, length)
    return offsets[:-1].astype(np.int64), length.astype(np.int64), col.values


def matrix(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose list has exactly ``dim`` elements, all non-null and finite; and their vectors."""
    starts, lengths, values = flat_list(col)
    flat = values.to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dim)
    if len(rows) == len(lengths) and len(rows):
        x = flat[starts[0] : starts[0] + len(rows) * dim].reshape(-1, dim).astype(np.float64)
    else:
        x = flat[starts[rows][:, None] + np.arange(dim)].astype(np.float64)
    good = np.isfinite(x).all(1)
    return rows[good], x[good]


def lists(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists of doubles."""
    x = np.asarray(x, np.float64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def packed(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    offsets = np.arange(len(x) + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x.tobytes())])


def unpacked(col: pa.Array, dtype: type, dim: int) -> np.ndarray:
    """The inverse of ``packed``."""
    if not len(col):
        return np.zeros((0, dim), dtype)
    at = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4)
    return np.frombuffer(col.buffers()[2], np.uint8)[at[0] : at[-1]].view(dtype).reshape(len(col), dim)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def by_key(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[pa.RecordBatch]:
    """The rows of each key (the first ``keys`` columns, whole numbers) of a sorted partition, together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if held and a == 0 and all(held[0].column(i)[0].as_py() == batch.column(i)[0].as_py() for i in range(keys)):
                held.append(batch.slice(a, b - a))
                continue
            if held:
                yield joined(held)
            held = [batch.slice(a, b - a)]
    if held:
        yield joined(held)


def changes(columns: list[pa.Array]) -> np.ndarray:
    """True where a row differs from the one before it in any of the columns; the first row is True."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    out[:1] = True
    for c in columns:
        if n > 1:
            a, b = c.slice(1), c.slice(0, n - 1)
            same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
            out[1:] |= ~same.to_numpy(zero_copy_only=False)
    return out


def scan_tasks(rows: DataFrame, keys: list[str], then: list[str], f: Callable, schema: str, parts: int | None = None) -> DataFrame:
    """Rows of each key together, by one shuffle and a sort; ``f`` gets an iterator of Arrow batches. ``parts`` sets the
    number of partitions, for few keys with much work each."""
    return (rows.repartition(*keys) if parts is None else rows.repartition(parts, *keys)).sortWithinPartitions(*keys, *then).mapInArrow(f, schema)
