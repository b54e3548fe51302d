"""Standardisation and principal components of frame vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrowtools import lists, matrix
from .segments import moments


def fit_scaler_pca(frames: DataFrame, n_components: int = 350) -> tuple[DataFrame, np.ndarray]:
    """The ``moments`` of the frames, and the loadings (dimensions by components) of the standardised frames.

    The products of all pairs of dimensions are summed within tasks in one pass over the frames, and are combined;
    the driver decomposes a matrix of dimensions by dimensions. Fewer dimensions than ``n_components`` give all.
    """
    stats = moments(frames)
    row = stats.first()
    if not row["n"]:
        raise ValueError("there are no frames to fit")
    mean, var = np.array(row["mean"]), np.array(row["var"])
    scale = np.where(var > 0, 1 / np.sqrt(np.where(var > 0, var, 1)), 0.0)
    shared = frames.sparkSession.sparkContext.broadcast((mean, scale))

    def add(batches: object) -> object:
        mean, scale = shared.value
        total = np.zeros((len(mean), len(mean)))
        for batch in batches:
            _, x = matrix(batch.column(0), len(mean))
            z = (x - mean) * scale
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(mean))), lists(total)], names=["i", "s"])

    rows = frames.select(F.col("x").cast("array<double>").alias("x")).where("x is not null")
    sums = rows.mapInArrow(add, "i bigint, s array<double>").groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s")).orderBy("i").toArrow()
    values, vectors = np.linalg.eigh(np.array(sums["s"].to_pylist()) / row["n"])
    loadings = vectors[:, np.argsort(-values)][:, :n_components]
    sign = np.sign(loadings[np.abs(loadings).argmax(0), np.arange(loadings.shape[1])])
    return stats, loadings * np.where(sign == 0, 1, sign)


def project(frames: DataFrame, stats: DataFrame, loadings: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep, x``: standardised frames in principal components, in one pass; frames of another dimension, or with
    elements that are null or not finite, are left out."""
    row = stats.first()
    mean, var = np.array(row["mean"]), np.array(row["var"])
    scale = np.where(var > 0, 1 / np.sqrt(np.where(var > 0, var, 1)), 0.0)
    shared = frames.sparkSession.sparkContext.broadcast((mean, scale[:, None] * loadings))
    rows = frames.select(*keep, F.col("x").cast("array<double>").alias("x")).where("x is not null")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def apply(batches: object) -> object:
        mean, m = shared.value
        for batch in batches:
            at, x = matrix(batch.column(batch.num_columns - 1), len(mean))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns[:-1]), lists((x - mean) @ m)], names=batch.schema.names)

    return rows.mapInArrow(apply, schema)
