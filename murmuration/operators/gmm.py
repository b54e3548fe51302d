"""Gaussian mixture with one variance a component (spherical), fitted by expectation maximisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrowtools import lists, matrix
from ..session import write_table
from .kmeans import kmeans, partial_sums
from .neighbours import centroid_matrix

REGULARISER = 1e-6


class Spherical:
    """Weights, means and variances."""

    def __init__(self, weight: np.ndarray, mean: np.ndarray, var: np.ndarray) -> None:
        self.weight, self.mean, self.var = weight, mean, var

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density, of each row under each component."""
        d = x.shape[1]
        far = (x**2).sum(1)[:, None] - 2 * x @ self.mean.T + (self.mean**2).sum(1)[None, :]
        return np.log(self.weight) - 0.5 * (d * np.log(2 * np.pi * self.var) + np.maximum(far, 0) / self.var)


def responsibilities(joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each component, and the log likelihood of each row."""
    top = joint.max(1, keepdims=True)
    total = top + np.log(np.exp(joint - top).sum(1, keepdims=True))
    return np.exp(joint - total), total[:, 0]


def em_step(vectors: DataFrame, model: Spherical) -> tuple[Spherical, float]:
    """One round over all rows, and the mean log likelihood under the model before it. Tasks give sums."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k, d = m.mean.shape
        s = np.zeros((k, d + 3))
        for batch in batches:
            _, x = matrix(batch.column(0), d)
            if len(x):
                r, ll = responsibilities(m.log_joint(x))
                s[:, :d] += r.T @ x
                s[:, d] += r.sum(0)
                s[:, d + 1] += r.T @ (x**2).sum(1)
                s[0, d + 2] += ll.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), lists(s)], names=["k", "s"])

    rows = vectors.select(F.col("x").cast("array<double>").alias("x")).where("x is not null")
    sums = rows.mapInArrow(add, "k bigint, s array<double>").groupBy("k").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s")).orderBy("k").toArrow()
    s = np.array(sums["s"].to_pylist())
    d = model.mean.shape[1]
    n = s[:, d] + 10 * np.finfo(float).eps
    mean = s[:, :d] / n[:, None]
    var = (s[:, d + 1] / n - (mean**2).sum(1)) / d + REGULARISER
    return Spherical(n / n.sum(), mean, np.maximum(var, REGULARISER)), float(s[0, d + 2] / max(s[:, d].sum(), 1e-300))


def packed_rows(vectors: DataFrame, id_col: str = "seg_id") -> DataFrame:
    """``id_col, x`` written once as arrays of doubles, for operators that read them in every round."""
    return write_table(vectors.select(id_col, F.col("x").cast("array<double>").alias("x")).where("x is not null"), "vectors").df


def fit_gmm(vectors: DataFrame, k: int, max_iter: int = 1000, tol: float = 1e-3, seed: int = 42, id_col: str = "seg_id", init: Spherical | None = None) -> tuple[DataFrame, Spherical]:
    """``id_col, k, log_likelihood`` (hard labels) of all vectors, and the model. It starts from ``init`` or from k-means
    and ends when the mean log likelihood gains less than ``tol``. No vector gives an empty result."""
    vectors = packed_rows(vectors, id_col)
    if init is None and (init := _from_kmeans(vectors, k, seed, id_col)) is None:
        return vectors.sparkSession.createDataFrame([], f"{id_col} bigint, k bigint, log_likelihood double"), Spherical(np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    model, before = init, -np.inf
    for _ in range(max_iter):
        model, now = em_step(vectors, model)
        if abs(now - before) < tol:
            break
        before = now
    return label(vectors, model, id_col), model


def _from_kmeans(vectors: DataFrame, k: int, seed: int, id_col: str) -> Spherical | None:
    """The clusters of k-means as components; None if there is no vector."""
    _, centroids = kmeans(vectors, k, 10, seed, id_col=id_col)
    _, c = centroid_matrix(centroids)
    if not len(c):
        return None
    stats = partial_sums(vectors, c).groupBy("k").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost")).orderBy("k").toArrow()
    n = stats["n"].to_numpy()
    return Spherical(n / n.sum(), c[stats["k"].to_numpy()], stats["cost"].to_numpy() / n / c.shape[1] + REGULARISER)


def label(vectors: DataFrame, model: Spherical, id_col: str = "seg_id") -> DataFrame:
    """``id_col, k, log_likelihood``: the most probable component of each vector (ties: the lowest)."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            at, x = matrix(batch.column(1), m.mean.shape[1])
            joint = m.log_joint(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(joint.argmax(1) if len(x) else np.zeros(0, np.int64)), pa.array(responsibilities(joint)[1] if len(x) else np.zeros(0))], names=["id", "k", "log_likelihood"])

    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col("x").cast("array<double>").alias("x")).where("x is not null")
    return rows.mapInArrow(assign, "id bigint, k bigint, log_likelihood double").withColumnRenamed("id", id_col)
