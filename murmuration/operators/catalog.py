"""Tables of fitted models and graphs that are kept under a name and read again if they are there."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .neighbours import centroid_matrix, centroid_table


class Catalog:
    """Parquet tables below one folder. What a table was made from is in its columns and its key, not in its name."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, kind: str, key: dict) -> str:
        parts = "/".join(f"{k}={quote(str(key[k]), safe='')}" for k in sorted(key))
        return f"{self.folder}/{kind}/{parts}" if parts else f"{self.folder}/{kind}"

    def exists(self, kind: str, **key: object) -> bool:
        """Whether a whole table is there: a table that was cut short has no mark of success."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(kind, key) + "/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def load(self, kind: str, **key: object) -> DataFrame:
        return self.spark.read.parquet(self._path(kind, key))

    def save(self, kind: str, df: DataFrame, **key: object) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(kind, key))
        return self.load(kind, **key)

    def cached(self, kind: str, make: Callable[[], DataFrame], **key: object) -> DataFrame:
        """The table, which is made and saved if it is not there."""
        return self.load(kind, **key) if self.exists(kind, **key) else self.save(kind, make(), **key)


def graph_edges(catalog: Catalog, source: str, vectors: DataFrame, kind: str, min_similarity: float, make: Callable[[DataFrame, float], DataFrame]) -> DataFrame:
    """The edges of a similarity graph, kept by what the vectors are, the kind and the threshold; one form for all sizes.
    ``source`` names the vectors: whatever is made from other data must have another name."""
    if not source:
        raise ValueError("the vectors need a name, so that other ones do not get their edges")
    return catalog.cached("edges", lambda: make(vectors, min_similarity), source=source, graph=kind, threshold=min_similarity).select("src", "dst", "weight")


def kept_matrix(catalog: Catalog, kind: str, make: Callable[[], np.ndarray], **key: object) -> np.ndarray:
    """A matrix on the driver, such as loadings, kept as rows."""
    return centroid_matrix(catalog.cached(kind, lambda: centroid_table(catalog.spark, make()), **key))[1]
