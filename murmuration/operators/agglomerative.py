"""Hierarchical clustering by nearest-neighbour chains and Lance-Williams updates.

With a distance threshold, average, complete and single linkage never join vectors that no chain of pairs within
the threshold connects: the clusters of each connected component are found on their own, in parallel. Ward and a
fixed number of clusters need all distances and run in one task, for at most ``MAX_ROWS`` vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrowtools import by_key, joined, matrix, scan_tasks
from ..functions import arrays
from .community import components
from .pairs import cosine_links

#: Vectors of one task: their distances take 4 N**2 bytes.
MAX_ROWS = 24_000
LINKAGES = ("average", "complete", "single", "ward")


def distances(x: np.ndarray, metric: str) -> np.ndarray:
    """All distances; a zero vector has the cosine distance 1 from all."""
    if metric == "cosine":
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        u = x / np.where(norm > 0, norm, 1)
        d = 1 - u @ u.T
    elif metric == "euclidean":
        q = (x**2).sum(1)
        d = np.sqrt(np.maximum(q[:, None] + q[None, :] - 2 * x @ x.T, 0))
    else:
        raise ValueError("metric is 'euclidean' or 'cosine'")
    return np.maximum(d, 0).astype(np.float32 if len(x) > 4096 else np.float64)


def merges(d: np.ndarray, linkage: str) -> list[tuple[int, int, float]]:
    """The joins (member of one cluster, member of the other, height), in order of height. ``d`` is used up."""
    if linkage not in LINKAGES:
        raise ValueError(f"linkage is one of {LINKAGES}")
    n = len(d)
    if linkage == "ward":
        np.square(d, out=d)
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(n), np.ones(n, bool)
    out: list[tuple[int, int, float]] = []
    chain: list[int] = []
    while len(out) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            row = d[a]
            b = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        a, b, h = min(a, b), max(a, b), float(d[a, b])
        if linkage == "average":
            new = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        elif linkage == "complete":
            new = np.maximum(d[a], d[b])
        elif linkage == "single":
            new = np.minimum(d[a], d[b])
        else:
            new = ((size[a] + size) * d[a] + (size[b] + size) * d[b] - size * h) / (size[a] + size[b] + size)
        new[~alive] = np.inf
        new[[a, b]] = np.inf
        d[a], d[:, a] = new, new
        d[b], d[:, b] = np.inf, np.inf
        size[a] += size[b]
        alive[b] = False
        out.append((a, b, float(np.sqrt(h)) if linkage == "ward" else h))
    return sorted(out, key=lambda m: m[2])


def cut(n: int, joins: list[tuple[int, int, float]], k: int | None, threshold: float | None) -> np.ndarray:
    """Labels by first appearance: the first ``n - k`` joins are made, or those below the threshold."""
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    done = 0
    for a, b, h in joins:
        if (threshold is None and done >= n - k) or (threshold is not None and h >= threshold):
            break
        parent[max(root(a), root(b))] = min(root(a), root(b))
        done += 1
    return np.unique([root(i) for i in range(n)], return_inverse=True)[1] if n else np.zeros(0, np.int64)


def _labelled(batch: pa.RecordBatch, id_at: int, linkage: str, metric: str, k: int | None, threshold: float | None) -> pa.RecordBatch:
    at, x = matrix(batch.column(id_at + 1), len(batch.column(id_at + 1)[0]))
    ids = batch.column(id_at).to_numpy()[at]
    order = np.argsort(ids)
    ids, x = ids[order], x[order]
    if len(x) > MAX_ROWS:
        raise ValueError(f"{len(x)} vectors need all distances in one task, which takes {MAX_ROWS} at most")
    labels = cut(len(x), merges(distances(x, metric), linkage), k, threshold)
    first = np.full(labels.max() + 1 if len(labels) else 0, np.iinfo(np.int64).max)
    np.minimum.at(first, labels, ids)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(first[labels] if len(labels) else np.zeros(0, np.int64))], names=["id", "cluster"])


def agglomerative(vectors: DataFrame, n_clusters: int | None = None, threshold: float | None = None, linkage: str = "average", metric: str = "euclidean", id_col: str = "seg_id", parts: DataFrame | None = None) -> DataFrame:
    """``id_col, cluster``: the smallest id of its cluster, for each vector ``id_col, x``.

    Clusters are joined while their distance is less than ``threshold``, in which case ``n_clusters`` does not
    count, or until ``n_clusters`` are left. Ward needs the Euclidean metric. Vectors that are null or not finite
    take no part. ``parts`` passes the components ``seg_id, component`` of the pairs within the threshold, if they are known.
    """
    if linkage == "ward" and metric != "euclidean":
        raise ValueError("ward needs the euclidean metric")
    if threshold is None and n_clusters is None:
        raise ValueError("n_clusters or threshold is needed")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col("x").cast("array<double>").alias("x")).where("id is not null and x is not null")
    if threshold is None or linkage == "ward":
        if rows.count() > MAX_ROWS:
            raise ValueError(f"all distances are needed in one task, which takes {MAX_ROWS} vectors at most")

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [b for b in batches if b.num_rows]
            if parts:
                yield _labelled(joined(parts), 0, linkage, metric, n_clusters, threshold)

        return rows.coalesce(1).mapInArrow(whole, "id bigint, cluster bigint").withColumnRenamed("id", id_col)
    if parts is None:
        parts = components(rows.select(F.col("id").alias("seg_id")), near_links(rows, threshold, metric))
    groups = parts.select(F.col("seg_id").alias("id"), "component")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_key(batches):
            yield _labelled(batch, 1, linkage, metric, None, threshold)

    tasks = rows.join(groups, "id").select("component", "id", "x")
    return scan_tasks(tasks, ["component"], ["id"], part, "id bigint, cluster bigint").withColumnRenamed("id", id_col)


def near_links(rows: DataFrame, threshold: float, metric: str) -> DataFrame:
    """``src, dst``: links with the components of the pairs of vectors nearer than the threshold. Euclidean distances become inner products of vectors with
    two more dimensions, so that the cosine join serves for both."""
    q = arrays.dot(F.col("x"), F.col("x"))
    if metric == "cosine":
        unit = rows.select(F.col("id").alias("seg_id"), arrays.l2_normalise(F.col("x")).alias("x"))
        return cosine_links(unit, 1.0 - threshold - 1e-9)
    # -|x - y|^2 / 2 is the product of (x, -|x|^2 / 2, 1) with (y, 1, -|y|^2 / 2): the last two are swapped.
    both = rows.select(F.col("id").alias("seg_id"), F.concat("x", F.array(-q / 2, F.lit(1.0))).alias("x"))
    return cosine_links(both, -threshold * threshold / 2 - 1e-9, swap_last_two=True)
