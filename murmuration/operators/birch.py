"""BIRCH: clustering features (count, sum, sum of squared lengths) in trees, one a partition, then joined.

Each partition builds a tree of its own rows; what leaves it are its leaf features. These are joined by further trees,
each of some of those before, down to one; clustered by Ward's linkage on their centroids; and every vector goes to
the cluster of its nearest feature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrowtools import lists, matrix
from ..session import write_table
from .agglomerative import MAX_ROWS, cut, distances, merges
from .neighbours import assign_nearest, centroid_table


class Node:
    """Up to ``branching`` features, with their children unless it is a leaf."""

    def __init__(self, branching: int, dim: int, leaf: bool) -> None:
        self.n = np.zeros(branching + 1)
        self.s = np.zeros((branching + 1, dim))
        self.q = np.zeros(branching + 1)
        self.size, self.leaf = 0, leaf
        self.children: list[Node] = []

    def nearest(self, c: np.ndarray) -> int:
        d = self.s[: self.size] / self.n[: self.size, None] - c
        return int(np.einsum("ij,ij->i", d, d).argmin())

    def put(self, n: float, s: np.ndarray, q: float, child: Node | None = None) -> None:
        self.n[self.size], self.s[self.size], self.q[self.size] = n, s, q
        self.size += 1
        if child is not None:
            self.children.append(child)

    def total(self) -> tuple[float, np.ndarray, float]:
        return self.n[: self.size].sum(), self.s[: self.size].sum(0), self.q[: self.size].sum()


class Tree:
    """A height-balanced tree of features whose radius is at most ``threshold``."""

    def __init__(self, dim: int, threshold: float = 0.5, branching: int = 50) -> None:
        self.dim, self.threshold, self.branching = dim, threshold, branching
        self.root = Node(branching, dim, True)

    def insert(self, n: float, s: np.ndarray, q: float) -> None:
        pair = self._insert(self.root, n, s, q)
        if pair is not None:
            self.root = Node(self.branching, self.dim, False)
            for half in pair:
                self.root.put(*half.total(), half)

    def _insert(self, node: Node, n: float, s: np.ndarray, q: float) -> tuple[Node, Node] | None:
        if node.size:
            i = node.nearest(s / n)
            if node.leaf:
                m, t, u = node.n[i] + n, node.s[i] + s, node.q[i] + q
                if max(u / m - (t / m) @ (t / m), 0.0) <= self.threshold**2:
                    node.n[i], node.s[i], node.q[i] = m, t, u
                    return None
            else:
                pair = self._insert(node.children[i], n, s, q)
                if pair is None:
                    node.n[i] += n
                    node.s[i] += s
                    node.q[i] += q
                    return None
                node.children[i] = pair[0]
                node.n[i], node.s[i], node.q[i] = pair[0].total()
                node.put(*pair[1].total(), pair[1])
                return self._split(node) if node.size > self.branching else None
        node.put(n, s, q)
        return self._split(node) if node.size > self.branching else None

    def _split(self, node: Node) -> tuple[Node, Node]:
        """Two nodes around the two features that are farthest apart."""
        c = node.s[: node.size] / node.n[: node.size, None]
        d = distances(c, "euclidean")
        a, b = divmod(int(d.argmax()), node.size)
        halves = (Node(self.branching, self.dim, node.leaf), Node(self.branching, self.dim, node.leaf))
        for i in range(node.size):
            side = int(i == b or (i != a and d[i, b] < d[i, a]))
            halves[side].put(node.n[i], node.s[i], node.q[i], None if node.leaf else node.children[i])
        return halves

    def leaves(self) -> Iterator[tuple[float, np.ndarray, float]]:
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node.leaf:
                yield from zip(node.n[: node.size].tolist(), node.s[: node.size], node.q[: node.size].tolist())
            else:
                todo += node.children


def _leaf_batch(tree: Tree) -> pa.RecordBatch:
    rows = list(tree.leaves())
    s = np.array([r[1] for r in rows]).reshape(len(rows), tree.dim)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.float64()), lists(s), pa.array([r[2] for r in rows], pa.float64())], names=["n", "s", "q"])


def features(vectors: DataFrame, dim: int, threshold: float = 0.5, branching: int = 50) -> DataFrame:
    """``n, s, q``: the leaf features of each partition's tree."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(dim, threshold, branching)
        for batch in batches:
            _, x = matrix(batch.column(0), dim)
            for v, q in zip(x, (x**2).sum(1).tolist()):
                tree.insert(1.0, v, q)
        yield _leaf_batch(tree)

    return vectors.select(F.col("x").cast("array<double>").alias("x")).where("x is not null").mapInArrow(build, "n double, s array<double>, q double")


def joined_features(parts: DataFrame, dim: int, tasks: int, threshold: float = 0.5, branching: int = 50) -> DataFrame:
    """The features of ``parts`` joined in ``tasks`` trees."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(dim, threshold, branching)
        for batch in batches:
            for n, s, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                tree.insert(n, np.array(s), q)
        yield _leaf_batch(tree)

    return parts.repartition(tasks).mapInArrow(join, "n double, s array<double>, q double")


def fit_features(vectors: DataFrame, dim: int, threshold: float = 0.5, branching: int = 50) -> DataFrame:
    """The leaf features of all vectors: each partition's, joined on the executors in ever fewer trees, down to one."""
    parts = write_table(features(vectors, dim, threshold, branching), "features").df
    tasks = parts.select(F.spark_partition_id()).distinct().count()
    while True:
        tasks = max(1, -(-tasks // 4))
        parts = write_table(joined_features(parts, dim, tasks, threshold, branching), "features").df
        if tasks <= 1:
            return parts


def birch(vectors: DataFrame, n_clusters: int, dim: int, threshold: float = 0.5, branching: int = 50, id_col: str = "seg_id") -> DataFrame:
    """``id_col, k``: cluster 0 to ``n_clusters - 1`` of each vector ``id_col, x`` of ``dim`` elements.

    Trees are joined on the executors. Ward's linkage of the features runs on the driver, which takes
    ``agglomerative.MAX_ROWS`` of them; if there are more, an error says so, and a larger ``threshold`` gives fewer.
    Fewer features than ``n_clusters`` give fewer clusters; no vector gives an empty result.
    """
    fitted = fit_features(vectors, dim, threshold, branching)
    if (found := fitted.count()) > MAX_ROWS:
        raise ValueError(f"{found} features at a threshold of {threshold}; at most {MAX_ROWS} can be clustered: raise the threshold")
    t = fitted.toArrow()
    spark = vectors.sparkSession
    if not t.num_rows:
        return spark.createDataFrame([], f"{id_col} bigint, k bigint")
    c = np.array(t["s"].to_pylist(), float).reshape(t.num_rows, dim) / t["n"].to_numpy()[:, None]
    label = cut(len(c), merges(distances(c, "euclidean"), "ward"), n_clusters, None)
    names = spark.createDataFrame(pa.table({"k": pa.array(np.arange(len(c))), "cluster": pa.array(label.astype(np.int64))}))
    near = assign_nearest(vectors, centroid_table(spark, c), id_col)
    return near.join(names, "k").select(id_col, F.col("cluster").alias("k"))
