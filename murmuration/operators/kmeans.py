"""k-means: seeding on a bounded sample, Lloyd's rounds over all rows, and the codebook of frame vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrowtools import lists, matrix
from ..functions import arrays
from ..session import write_table
from .neighbours import assign_nearest, centroid_matrix, centroid_table, nearest
from .segments import hash_sample


def seed_centroids(vectors: DataFrame, k: int, seed: int = 0, id_col: str = "seg_id") -> DataFrame:
    """``k, x``: k-means++ on a sample of ``min(3 k, N)`` vectors, chosen by a hash of the id. Each next centroid is
    drawn with a probability in proportion to its squared distance from those before. Fewer different vectors than
    ``k`` give fewer centroids. The sample, of ``3 k`` vectors, is held by the driver."""
    rows = hash_sample(vectors.where("x is not null").select(F.col(id_col).alias("k"), "x"), "k", 3 * k, seed)
    _, x = centroid_matrix(rows)
    rng = np.random.default_rng(seed)
    chosen: list[int] = []
    if len(x):
        q = np.einsum("ij,ij->i", x, x)

        def from_row(i: int) -> np.ndarray:
            d = q + q[i] - 2 * (x @ x[i])
            return np.where(d > 1e-12 * (q + q[i]), d, 0.0)  # what rounding leaves of an equal vector is no distance

        chosen.append(int(rng.integers(len(x))))
        far = from_row(chosen[0])
        while len(chosen) < k and (total := np.cumsum(far))[-1] > 0:
            chosen.append(min(int(np.searchsorted(total, rng.random() * total[-1], side="right")), len(x) - 1))
            far = np.minimum(far, from_row(chosen[-1]))
    return centroid_table(vectors.sparkSession, x[chosen])


def lloyd_step(vectors: DataFrame, centroids: DataFrame, id_col: str = "seg_id") -> DataFrame:
    """``k, x, n``: the mean of the vectors nearest to each centroid, by joins and aggregations alone. A centroid
    to which no vector is nearest gives no row."""
    assigned = assign_nearest(vectors, centroids, id_col).select(id_col, "k")
    mean = vector_to_array(Summarizer.mean(array_to_vector(arrays.doubles(F.col("x")))))
    return vectors.join(assigned, id_col).groupBy("k").agg(mean.alias("x"), F.count("*").alias("n"))


def partial_sums(vectors: DataFrame, c: np.ndarray) -> DataFrame:
    """``k, n, s, cost`` summed over each task: what a round of Lloyd needs, in one pass without a shuffle of
    vectors. A task gives one row a centroid."""
    shared = vectors.sparkSession.sparkContext.broadcast(c)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        n, s, cost = np.zeros(len(c), np.int64), np.zeros_like(c), np.zeros(len(c))
        for batch in batches:
            _, x = matrix(batch.column(0), c.shape[1])
            own, far = nearest(x, c)
            n += np.bincount(own, minlength=len(c))
            cost += np.bincount(own, far, len(c))
            order = np.argsort(own, kind="stable")
            filled = np.unique(own)
            if len(filled):
                s[filled] += np.add.reduceat(x[order], np.searchsorted(own[order], filled), axis=0)
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n[k]), lists(s[k]) if len(k) else pa.array([], pa.list_(pa.float64())), pa.array(cost[k])], names=["k", "n", "s", "cost"])

    rows = vectors.select(F.col("x").cast("array<double>").alias("x")).where("x is not null")
    return rows.mapInArrow(add, "k bigint, n bigint, s array<double>, cost double")


def kmeans(vectors: DataFrame, k: int, rounds: int = 15, seed: int = 0, init: DataFrame | None = None, id_col: str = "seg_id") -> tuple[DataFrame, DataFrame]:
    """``(id_col, k, distance2)`` of all vectors and the centroids ``k, x``.

    Each round reads the vectors once and sums within tasks; what is shuffled is one row for each task and
    centroid, and the driver holds the centroids. A centroid without vectors stays where it is. It ends early once
    no centroid moves. Empty clusters do not appear among the assignments.
    """
    _, c = centroid_matrix(init if init is not None else seed_centroids(vectors, k, seed, id_col))
    for _ in range(rounds if len(c) else 0):
        sums = partial_sums(vectors, c).groupBy("k").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s")).toArrow()
        at, n = sums["k"].to_numpy(), sums["n"].to_numpy()
        moved = c.copy()
        if len(at):
            moved[at] = np.array(sums["s"].to_pylist()) / n[:, None]
        if np.array_equal(moved, c):
            break
        c = moved
    centroids = write_table(centroid_table(vectors.sparkSession, c), "centroids").df
    return assign_nearest(vectors, centroids, id_col), centroids


def fit_codebook(frames: DataFrame, k: int = 500, seed: int = 42, rounds: int = 20, init: DataFrame | None = None) -> DataFrame:
    """``k, x``: the codebook of frame vectors ``utt_id, frame, x``, from ``init`` or from k-means++."""
    keyed = frames.select(F.xxhash64("utt_id", "frame").alias("seg_id"), "x")
    return kmeans(keyed, k, rounds, seed, init)[1]


def quantise(frames: DataFrame, codebook: DataFrame) -> DataFrame:
    """``utt_id, frame, unit``: the number of the codebook vector nearest to each frame, in one pass."""
    shared = frames.sparkSession.sparkContext.broadcast(centroid_matrix(codebook))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ks, c = shared.value
        for batch in batches:
            at, x = matrix(batch.column(2), c.shape[1])
            own, _ = nearest(x, c)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(ks[own].astype(np.int32))], names=["utt_id", "frame", "unit"])

    rows = frames.select("utt_id", F.col("frame").cast("int").alias("frame"), F.col("x").cast("array<double>").alias("x")).where("x is not null")
    return rows.mapInArrow(predict, "utt_id string, frame int, unit int")
