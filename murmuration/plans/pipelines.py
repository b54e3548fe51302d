"""One function for each command of the analysis: tables in, tables out.

With a ``catalog`` and a ``source``, which names the data, fitted models, initial centroids and graphs are kept there and
read again where they are known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import agglomerative, birch, community, gibbs, gmm, kmeans, mixture, pairs, partition, scaling, segments
from ..operators.catalog import Catalog, graph_edges, kept_matrix
from ..session import write_table


def _keeps(catalog: Catalog | None, source: str) -> bool:
    if catalog is not None and not source:
        raise ValueError("what is kept in a catalog needs the name of its source")
    return catalog is not None


def pool(frames: DataFrame, boundaries: DataFrame, n_components: int = 350, catalog: Catalog | None = None, source: str = "") -> DataFrame:
    """Segment embeddings ``seg_id, utt_id, start_frame, end_frame, features`` of ``frames`` (``utt_id, frame, x``):
    standardised, projected, and averaged between the boundaries."""
    if _keeps(catalog, source):
        stats = catalog.cached("scaler", lambda: segments.moments(frames), source=source)
        loadings = kept_matrix(catalog, "loadings", lambda: scaling.fit_scaler_pca(frames, n_components)[1], source=source, n_components=n_components)
    else:
        stats, loadings = scaling.fit_scaler_pca(frames, n_components)
    projected = write_table(scaling.project(frames, stats, loadings, ["utt_id", "frame"]), "projected").df
    n = frames.groupBy("utt_id").agg((F.max("frame") + 1).alias("n_frames"))
    pooled = segments.mean_pool(projected, segments.pooling_intervals(boundaries, n))
    return segments.numbered(pooled).withColumnRenamed("x", "features")


def quantise(train: DataFrame, frames: DataFrame, boundaries: DataFrame, k: int = 500, total_hours: float = 2.0, collapsed: bool = False, seed: int = 42, catalog: Catalog | None = None, source: str = "") -> tuple[DataFrame, DataFrame]:
    """Unit sequences ``seg_id, utt_id, start_frame, end_frame, units``, and the codebook, which is fitted on whole
    utterances of ``train`` up to the hours given."""

    def fit() -> DataFrame:
        lengths = train.groupBy("utt_id").agg((F.max("frame") + 1).alias("n_frames"))
        prefix = segments.bounded_prefix(lengths, total_hours)
        return kmeans.fit_codebook(train.join(prefix.select("utt_id"), "utt_id", "left_semi"), k, seed)

    codebook = catalog.cached("codebook", fit, source=source, k=k, hours=total_hours, seed=seed) if _keeps(catalog, source) else fit()
    units = kmeans.quantise(frames, codebook)
    sequences = segments.unit_sequences(units, segments.quantising_intervals(boundaries), collapsed)
    return segments.numbered(sequences), codebook


def embeddings(segment_table: DataFrame, dim: int) -> DataFrame:
    """``seg_id, x``: valid embeddings, centred and of length 1, as all clusterings of embeddings take them."""
    return write_table(segments.centred_unit(segments.valid_vectors(segment_table, dim)), "embeddings").df


def cosine_graph(vectors: DataFrame, n_clusters: int, min_similarity: float = 0.5, resolution: float = 0.5, max_iter: int = 15, tolerance: int = 5, quality: str = "cpm", catalog: Catalog | None = None, source: str = "") -> tuple[DataFrame, float, list[dict]]:
    """Communities of the cosine graph, tuned to about ``n_clusters``: assignments, resolution, history."""
    edges = graph_edges(catalog, source, vectors, "cosine", min_similarity, pairs.cosine_edges) if _keeps(catalog, source) else pairs.cosine_edges(vectors, min_similarity)
    return community.tuned_partition(pairs.graph_vertices(vectors), edges, n_clusters, quality, resolution, max_iter, tolerance)


def edit_graph(sequences: DataFrame, n_clusters: int, min_similarity: float = 0.5, resolution: float = 0.5, max_iter: int = 15, tolerance: int = 5, length_filter: str = "reference", catalog: Catalog | None = None, source: str = "") -> tuple[DataFrame, float, list[dict]]:
    """Communities of the edit graph of ``seg_id, units``, always by CPM."""
    make = lambda rows, least: pairs.edit_edges(rows, least, length_filter)
    edges = graph_edges(catalog, source, sequences, f"edit-{length_filter}", min_similarity, make) if _keeps(catalog, source) else make(sequences, min_similarity)
    return community.tuned_partition(pairs.graph_vertices(sequences), edges, n_clusters, "cpm", resolution, max_iter, tolerance)


def kmeans_clusters(vectors: DataFrame, n_clusters: int, seed: int = 0, catalog: Catalog | None = None, source: str = "") -> DataFrame:
    """``seg_id, cluster`` by k-means with 15 rounds; the initial centroids are what a catalog keeps."""
    init = catalog.cached("initial-centroids", lambda: kmeans.seed_centroids(vectors, n_clusters, seed), source=source, k=n_clusters, seed=seed) if _keeps(catalog, source) else None
    return kmeans.kmeans(vectors, n_clusters, 15, seed, init)[0].select("seg_id", F.col("k").alias("cluster"))


def birch_clusters(vectors: DataFrame, n_clusters: int, dim: int) -> DataFrame:
    return birch.birch(vectors, n_clusters, dim).select("seg_id", F.col("k").alias("cluster"))


def gmm_clusters(vectors: DataFrame, n_clusters: int, seed: int = 42) -> DataFrame:
    return gmm.fit_gmm(vectors, n_clusters, seed=seed)[0].select("seg_id", F.col("k").alias("cluster"))


def agglomerative_clusters(vectors: DataFrame, n_clusters: int | None = None, threshold: float | None = None, linkage: str = "average", metric: str = "euclidean") -> DataFrame:
    return agglomerative.agglomerative(vectors, n_clusters, threshold, linkage, metric)


def fbgmm_clusters(vectors: DataFrame, n_clusters: int, n_iter: int = 1, alpha: float = 1.0, k_0: float = 0.05, s_0: float = 0.1, family: str = "fixed", each_in_own: bool = False, seed: int = 0, checkpoint: str | None = None, resume: bool = False) -> tuple[DataFrame, DataFrame]:
    """``seg_id, cluster`` and the trace. With ``checkpoint``, a folder, the state is written after every sweep, and
    each sweep is a job; with ``resume`` they go on from the latest one there, as if they had not been cut off."""
    spark = vectors.sparkSession
    if family == "fixed":
        prior: mixture.FixedPrior | mixture.ConjugatePrior = mixture.fixed_prior(vectors, k_0, s_0)
    else:
        d = vectors.agg(F.max(F.size("x")).alias("d")).first()["d"] or 1
        scale = [s_0] * d if family == "diag" else [[s_0 * (i == j) for j in range(d)] for i in range(d)]
        prior = mixture.ConjugatePrior([0.0] * d, k_0, d + 3, scale)
    init = "each-in-own" if each_in_own else "rand"
    if not checkpoint:
        found, trace = gibbs.fbgmm(vectors, prior, n_clusters, family, alpha, n_iter, init, seed)
        return found.select("seg_id", F.col("k").alias("cluster")), trace
    k_max = vectors.count() if each_in_own else n_clusters
    done, found, _ = (gibbs.resume(spark, checkpoint) if resume else None) or (0, None, None)
    for i in range(done + 1, done + n_iter + 1):
        found, trace = gibbs.fbgmm(vectors, prior, k_max, family, alpha, 1, init, seed, start=found, first_iter=i)
        gibbs.save_checkpoint(spark, checkpoint, found, trace, i)
    _, found, trace = gibbs.resume(spark, checkpoint)
    return found.select("seg_id", F.col("k").alias("cluster")), trace


def members(assignments: DataFrame, segment_table: DataFrame, order: str = "first") -> DataFrame:
    """What the partition file holds of a clustering."""
    return partition.partition_members(assignments, segment_table, order)
