"""Scaler and principal components fitted on a stream of frames: mergeable moments, one row a micro-batch.

Each micro-batch adds the count, the sum and the products of all pairs of dimensions, under its own number. A
batch that is run again, after a failure, replaces itself, so every frame counts once. The fit merges all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..arrowtools import matrix


def partial_moments(frames: DataFrame, dim: int) -> DataFrame:
    """``v``, one row: count, sums, and products row by row, of the valid vectors ``x``. Summed within tasks."""

    def add(batches: object) -> object:
        total = np.zeros(1 + dim + dim * dim)
        for batch in batches:
            _, x = matrix(batch.column(0), dim)
            total[0] += len(x)
            total[1 : dim + 1] += x.sum(0)
            total[dim + 1 :] += (x.T @ x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    rows = frames.select(F.col("x").cast("array<double>").alias("x")).where("x is not null")
    return rows.mapInArrow(add, "v array<double>").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))


def fit_stream(frames: DataFrame, dim: int, path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that adds the moments of the streaming ``frames`` (``x``) below ``path``, over what is there
    now. ``path`` and ``checkpoint`` are folders that all executors share."""

    def save(batch: DataFrame, number: int) -> None:
        partial_moments(batch, dim).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return frames.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fitted(spark: SparkSession, path: str, dim: int, n_components: int) -> tuple[DataFrame, np.ndarray]:
    """What ``operators.scaling.fit_scaler_pca`` gives for all frames so far: moments, and loadings."""
    total = spark.read.parquet(path).agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).first()["v"]
    if total is None or not total[0]:
        raise ValueError("there are no frames to fit")
    n, s, q = total[0], np.array(total[1 : dim + 1]), np.array(total[dim + 1 :]).reshape(dim, dim)
    mean = s / n
    cov = q / n - np.outer(mean, mean)
    var = np.maximum(np.diag(cov), 0)
    scale = np.where(var > 1e-12, 1 / np.sqrt(np.where(var > 1e-12, var, 1)), 0.0)
    values, vectors = np.linalg.eigh(cov * np.outer(scale, scale))
    loadings = vectors[:, np.argsort(-values)][:, :n_components]
    sign = np.sign(loadings[np.abs(loadings).argmax(0), np.arange(loadings.shape[1])])
    stats = spark.createDataFrame([(int(n), mean.tolist(), np.where(scale > 0, var, 0.0).tolist())], "n bigint, mean array<double>, var array<double>")
    return stats, loadings * np.where(sign == 0, 1, sign)
