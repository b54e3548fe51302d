"""What the operators on vectors share: usable vectors, centring, hot keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..arrowtools import matrix, packed
from ..session import write_table

#: Most rows of one key that one task takes at once; a key with more is cut into blocks.
BLOCK_ROWS = 8192
#: Most hot keys that are sent to all tasks: 2 MB.
MOST_SENT = 100_000


def usable(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose list has exactly ``dim`` elements, all non-null and finite, not all zero; and their vectors."""
    rows, x = matrix(col, dim)
    good = (x != 0).any(1)
    return rows[good], x[good]


def vector_rows(segments: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return segments.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("x")).where("id is not null and x is not null")


def is_usable(column: str) -> Column:
    """The same test as ``usable``, but for the length, as an expression; for few rows."""
    return F.expr(f"not exists({column}, v -> v is null or isnan(v) or abs(v) = float('Infinity')) and exists({column}, v -> v <> 0)")


def centre(rows: DataFrame, dim: int) -> tuple[np.ndarray, int]:
    """Mean vector and number of the usable vectors of ``id, x``, each id once.

    Ids that repeat are found from the id column alone. Each row then counts one over its repeats, so the vectors
    are read once and not shuffled; the sums are added up per dimension.
    """
    repeated = write_table(rows.groupBy("id").agg(F.count("*").alias("repeats")).where("repeats > 1"), "repeats")
    weighted = rows.join(repeated.df, "id", "left").select("x", (F.lit(1.0) / F.coalesce("repeats", F.lit(1))).alias("w"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim), 0.0
        for batch in batches:
            at, x = usable(batch.column(0), dim)
            w = batch.column(1).to_numpy()[at]
            total += w @ x
            n += w.sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([n])], names=["s", "n"])

    sums = weighted.mapInArrow(add, "s array<double>, n double").select(F.posexplode(F.concat("s", F.array("n"))).alias("dim", "v"))
    found = {r["dim"]: r["v"] for r in sums.groupBy("dim").agg(F.sum("v").alias("v")).collect()}
    repeated.drop()
    n = round(found.get(dim, 0.0))
    return np.array([found.get(i, 0.0) for i in range(dim)]) / max(n, 1), n


def fixed_point(x: np.ndarray) -> np.ndarray:
    """Numbers from -1 to 1 in three bytes each, to within 1e-7."""
    return np.ascontiguousarray(np.rint(x * ((1 << 23) - 1)).astype("<i4").view(np.uint8).reshape(*x.shape, 4)[..., :3]).reshape(len(x), -1)


def from_fixed_point(b: np.ndarray) -> np.ndarray:
    """The inverse of ``fixed_point``."""
    wide = np.zeros((len(b), b.shape[1] // 3, 4), np.uint8)
    wide[..., 1:] = b.reshape(len(b), -1, 3)
    return (wide.view("<i4")[..., 0] >> 8) / float((1 << 23) - 1)


def unit_vectors(rows: DataFrame, mean: np.ndarray, dim: int) -> DataFrame:
    """``id, x`` (packed ``fixed_point``) of the usable vectors of ``id, x``, centred and of length 1."""
    shared = rows.sparkSession.sparkContext.broadcast(mean)

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = usable(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), packed(fixed_point(unit(x, shared.value)))], names=["id", "x"])

    return rows.select("id", "x").mapInArrow(units, "id bigint, x binary")


def unit(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Centred vectors of length 1; a vector that equals the mean stays zero."""
    x = x - mean
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def in_blocks(rows: DataFrame, key: str, id_col: str, counted: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with the columns ``lo, hi, block``, so that (key, lo, hi) is a task of bounded size.

    A key of at most ``block_rows`` rows is one task with lo = hi = block = 0. A larger one is cut into blocks by
    a hash of the id, and each pair of blocks is one task, which has both blocks' rows; ``block`` tells them
    apart. Every pair of rows of a key thus meets in a task: pairs of two blocks once, pairs within a block in the
    task with lo = hi. ``counted`` has the keys in as many rows, where they are cheaper to read than in ``rows``. Hot
    keys are at most one for each ``block_rows`` rows; they are sent to all tasks if they are ``MOST_SENT`` or fewer,
    and joined by a shuffle if more.
    """
    counts = (rows if counted is None else counted).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > block_rows)
    hot = write_table(counts.select(key, F.ceil(F.col("n") / block_rows).cast("int").alias("n_blocks")), "hot-keys").df
    n = hot.count()
    if not n:
        return rows.select("*", *(F.lit(0).alias(c) for c in ("lo", "hi", "block")))
    sized = rows.join(F.broadcast(hot) if n <= MOST_SENT else hot, key, "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
    own = F.pmod(F.xxhash64(F.lit(11), F.col(id_col)), F.col("n_blocks")).cast("int")
    spread = sized.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return spread.select("*", F.least("block", "other").cast("int").alias("lo"), F.greatest("block", "other").cast("int").alias("hi")).drop("n_blocks", "other")


def hashed(*columns: Column) -> Column:
    """An order that looks random and is the same in every run."""
    return F.xxhash64(F.lit(20240601), *columns)
