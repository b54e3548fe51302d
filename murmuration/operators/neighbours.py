"""The nearest of a set of centroids for each vector, and partial sums by centroid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrowtools import lists, matrix

#: Most numbers of centroids that are sent to all tasks at once: 64 MB. More take more passes.
MAX_VALUES = 8_000_000


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centroid of each row (ties: the lowest) and the squared distance."""
    own, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    half = 0.5 * np.einsum("ij,ij->i", c, c)
    for i in range(0, len(x), 2048):
        s = half[None, :] - x[i : i + 2048] @ c.T
        own[i : i + 2048] = s.argmin(1)
        d = x[i : i + 2048] - c[own[i : i + 2048]]
        far[i : i + 2048] = np.einsum("ij,ij->i", d, d)
    return own, far


def centroid_matrix(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and vectors of ``k, x``, in order of k, on the driver; the caller bounds the number."""
    rows = centroids.select(F.col("k").cast("bigint").alias("k"), F.col("x").cast("array<double>").alias("x")).orderBy("k").toArrow()
    if not rows.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    values = np.array(rows["x"].to_pylist(), float)
    return rows["k"].to_numpy(), values


def centroid_table(spark: object, c: np.ndarray) -> DataFrame:
    """``k, x`` of a matrix of centroids."""
    table = pa.table({"k": pa.array(np.arange(len(c), dtype=np.int64)), "x": lists(c) if len(c) else pa.array([], pa.list_(pa.float64()))})
    return spark.createDataFrame(table)


def assign_nearest(vectors: DataFrame, centroids: DataFrame, id_col: str = "seg_id") -> DataFrame:
    """``id_col, k, distance2``: the nearest centroid of each vector by Euclidean distance; ties: the lowest k.

    ``vectors``: ``id_col, x``; ``centroids``: ``k, x``. Vectors that are null, of another dimension or not finite
    give no row. Centroids are sent to the tasks in blocks of at most ``MAX_VALUES`` numbers; more than one block
    takes a pass each and a minimum over the passes. No centroid gives an empty result.
    """
    size = centroids.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    dim, n = size["d"] or 0, size["n"]
    blocks = max(1, -(-n * max(dim, 1) // MAX_VALUES))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col("x").cast("array<double>").alias("x")).where("x is not null")
    out = None
    for b in range(blocks):
        part = centroids if blocks == 1 else centroids.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b)
        shared = vectors.sparkSession.sparkContext.broadcast(centroid_matrix(part))

        def assign(batches: Iterator[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            ks, c = shared.value
            for batch in batches:
                if not len(c):
                    continue
                at, x = matrix(batch.column(1), c.shape[1])
                own, far = nearest(x, c)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(ks[own]), pa.array(far)], names=["id", "k", "distance2"])

        found = rows.mapInArrow(assign, "id bigint, k bigint, distance2 double")
        out = found if out is None else out.unionByName(found)
    if blocks > 1:
        out = out.groupBy("id").agg(F.min(F.struct("distance2", "k")).alias("m")).select("id", "m.k", "m.distance2")
    return out.withColumnRenamed("id", id_col)
