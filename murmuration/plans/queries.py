"""The queries of the core operators; each runs over its whole tables."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, special, timebase
from ..operators import agglomerative, birch, community, gibbs, gmm, kmeans, mixture, neighbours, pairs, partition, scaling, segments, zipf
from ..session import shared_dir, write_table
from ..sources import files, segment_files
from ..streaming import scaler
from . import pipelines

DIM, LABELLED_DIM = 96, 64
QUERIES: dict[str, object] = {}


def query(f: object) -> object:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shown(x: str) -> list[Column]:
    """A vector as its ends, its sum, a sum that depends on the order, and its squared length, rounded."""
    v = arrays.doubles(F.col(x))
    total = F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    ordered = F.aggregate(F.transform(v, lambda e, i: e * (i + 1) / 100), F.lit(0.0), lambda s, e: s + e)
    parts = {"x_first": F.element_at(v, 1), "x_last": F.element_at(v, -1), "x_sum": total, "x_ordered": ordered, "x_square": arrays.dot(v, v)}
    return [(F.round(c, 4) + F.lit(0.0)).alias(name) for name, c in parts.items()]  # no negative zero


def _frames(spark: SparkSession, folder: str) -> DataFrame:
    """Segments stand for frames, numbered by their first frame."""
    rows = table(spark, folder, "segments").where("utt_id is not null and start_frame is not null")
    good = segments.valid_vectors(rows, DIM, keep=["utt_id", "start_frame"])
    return good.groupBy("utt_id", F.col("start_frame").alias("frame")).agg(F.min_by("x", "seg_id").alias("x"))


def _utterances(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "unit_segments").where("utt_id is not null").groupBy("utt_id").agg(F.max("end_frame").alias("n_frames"))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return segments.centred_unit(segments.valid_vectors(table(spark, folder, "segments"), DIM).where("exists(x, v -> v <> 0)"))


def _labelled(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "embeddings")
    return rows.select(F.col("vec_id").alias("seg_id"), F.col("embedding").alias("x")), rows.select(F.col("vec_id").alias("seg_id"), F.col("label").cast("bigint").alias("k"))


def _assignments(spark: SparkSession, folder: str) -> DataFrame:
    """All runs' clusters as one: the run's number times a million, plus the cluster."""
    rows = table(spark, folder, "partition_file").where("cluster >= 0 and run_id is not null").dropDuplicates(["member_id"])
    return rows.select(F.col("member_id").alias("seg_id"), (F.col("run_id").cast("bigint") * 1000000 + F.col("cluster")).alias("cluster"))


def _graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of the edge list: weights in (0, 1], one edge a pair, with its largest weight."""
    rows = table(spark, folder, "edge_list").where("src is not null and dst is not null and src <> dst and weight > 0 and weight <= 1 and not isnan(weight)")
    edges = rows.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight"))
    return edges.select(F.explode(F.array("src", "dst")).alias("seg_id")).distinct(), edges


@query
def time_conversion(spark: SparkSession, folder: str) -> DataFrame:
    """Boundary times in frames and back."""
    rows = table(spark, folder, "boundaries").where("end_sec is not null").select("utt_id", "pos", "end_sec").distinct()
    frame = timebase.seconds_to_frames(F.col("end_sec"))
    return rows.select("utt_id", "pos", frame.alias("frame"), timebase.frames_to_seconds(frame).alias("sec"))


@query
def pooling_intervals(spark: SparkSession, folder: str) -> DataFrame:
    return segments.pooling_intervals(table(spark, folder, "boundaries"), _utterances(spark, folder))


@query
def quantising_intervals(spark: SparkSession, folder: str) -> DataFrame:
    return segments.quantising_intervals(table(spark, folder, "boundaries"))


@query
def mean_pool(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of the vectors that begin within each boundary interval."""
    frames = write_table(_frames(spark, folder), "frames").df  # read three times
    n = frames.groupBy("utt_id").agg((F.max("frame") + 1).alias("n_frames"))
    pooled = segments.mean_pool(frames, segments.pooling_intervals(table(spark, folder, "boundaries"), n), DIM)
    return pooled.select("utt_id", "start_frame", "end_frame", *shown("x"))


@query
def pool_command(spark: SparkSession, folder: str) -> DataFrame:
    """The pooling command from frames to numbered segments, with eight components: places, and whether each is whole."""
    found = pipelines.pool(_frames(spark, folder), table(spark, folder, "boundaries"), 8)
    return found.select("seg_id", "utt_id", "start_frame", "end_frame", (F.size("features") == 8).alias("whole"))


@query
def quantise_command(spark: SparkSession, folder: str) -> DataFrame:
    """The quantising command with a codebook of five: numbered sequences, their lengths, and whether all units are known."""
    frames = _frames(spark, folder)
    found, _ = pipelines.quantise(frames, frames, table(spark, folder, "boundaries"), 5)
    return found.select("seg_id", "utt_id", "start_frame", "end_frame", F.size("units").alias("n_units"), F.forall("units", lambda u: u.between(0, 4)).alias("known"))


def _frame_units(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "unit_segments").where("utt_id is not null").select("utt_id", "start_frame", F.posexplode("quantised").alias("pos", "unit"))
    return rows.where("unit >= 0").groupBy("utt_id", (F.col("start_frame") + F.col("pos")).alias("frame")).agg(F.min("unit").alias("unit"))


@query
def unit_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Unit sequences between boundaries, collapsed."""
    found = segments.unit_sequences(write_table(_frame_units(spark, folder), "frame-units").df, segments.quantising_intervals(table(spark, folder, "boundaries")), True)
    return found.select("utt_id", "start_frame", "end_frame", F.concat_ws(" ", F.transform("units", lambda u: u.cast("string"))).alias("units"))


@query
def collapsed_units(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "unit_segments").dropDuplicates(["seg_id"]).where("quantised is not null")
    units = arrays.collapse(F.col("quantised"))
    return rows.select("seg_id", F.size("quantised").alias("n_units"), F.size(units).alias("n_collapsed"), F.concat_ws(" ", F.transform(units, lambda u: F.coalesce(u.cast("string"), F.lit("?")))).alias("units"))


@query
def sliced_units(spark: SparkSession, folder: str) -> DataFrame:
    """Frames 2 to 6 of each sequence."""
    rows = table(spark, folder, "unit_segments").dropDuplicates(["seg_id"]).where("quantised is not null")
    part = arrays.slice_units(F.col("quantised"), F.lit(2), F.lit(6))
    return rows.select("seg_id", F.concat_ws(" ", F.transform(part, lambda u: F.coalesce(u.cast("string"), F.lit("?")))).alias("units"))


@query
def new_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments without a unit sequence that has units."""
    rows = table(spark, folder, "segments").where("utt_id is not null").select("utt_id", "start_frame", "end_frame").distinct()
    return segments.new_segments(rows, table(spark, folder, "unit_segments").where("size(quantised) > 0"))


@query
def numbered_segments(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "segments").where("utt_id is not null").select("utt_id", "start_frame", "end_frame").distinct()
    return segments.numbered(rows, "vertex")


@query
def normalised_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder).select("seg_id", *shown("x"))


@query
def rejected_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that the embedding loader leaves out, by reason."""
    return segments.rejected_vectors(table(spark, folder, "segments"), DIM)


@query
def frame_moments(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and variance of each dimension."""
    row = segments.moments(_labelled(spark, folder)[0])
    zipped = row.select("n", F.posexplode(F.arrays_zip("mean", "var")).alias("dim", "z"))
    return zipped.select("n", "dim", F.round("z.mean", 6).alias("mean"), F.round("z.var", 6).alias("var"))


@query
def streamed_moments(spark: SparkSession, folder: str) -> DataFrame:
    """``frame_moments`` of frames that arrive as a stream, in micro-batches."""
    path = _folder(spark, "moments")
    arrived = write_table(_labelled(spark, folder)[0].select("x").repartition(3), "frames")
    frames = spark.readStream.schema(arrived.df.schema).option("maxFilesPerTrigger", 1).parquet(arrived.path)
    scaler.fit_stream(frames, LABELLED_DIM, path, _folder(spark, "stream-state")).awaitTermination()
    row = scaler.fitted(spark, path, LABELLED_DIM, 1)[0]
    zipped = row.select("n", F.posexplode(F.arrays_zip("mean", "var")).alias("dim", "z"))
    return zipped.select("n", "dim", F.round("z.mean", 6).alias("mean"), F.round("z.var", 6).alias("var"))


@query
def standardised_frames(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _labelled(spark, folder)[0]
    return segments.standardised(vectors, segments.moments(vectors), ["seg_id"]).select("seg_id", *shown("x"))


@query
def bounded_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Utterances up to a hundredth of all frames' time."""
    return segments.bounded_prefix(_utterances(spark, folder), hours=0.02)


@query
def batch_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each batch of 1,000 ids."""
    rows = table(spark, folder, "segments").where("seg_id is not null").select("seg_id").distinct()
    n = rows.agg(F.coalesce(F.max("seg_id") + 1, F.lit(0)).alias("n")).first()["n"]
    ranges = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(segments.batch_ranges(n, 1000))], "batch bigint, start bigint, stop bigint")
    counts = rows.groupBy(F.floor(F.col("seg_id") / 1000).alias("batch")).agg(F.count("*").alias("n"))
    return counts.join(ranges, "batch").select("batch", "start", "stop", "n")


@query
def cosine_edges(spark: SparkSession, folder: str) -> DataFrame:
    vectors = write_table(_vectors(spark, folder), "vectors").df
    return pairs.cosine_edges(vectors, 0.74).select("src", "dst", F.round("weight", 5).alias("weight"))


@query
def vertex_degrees(spark: SparkSession, folder: str) -> DataFrame:
    vertices, edges = _graph(spark, folder)
    found = pairs.vertex_degrees(vertices.unionByName(table(spark, folder, "anchor_segments").select("seg_id")).distinct(), edges)
    return found.select("seg_id", "degree", F.round("strength", 4).alias("strength"))


def _unit_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences of the table's units, without missing frames."""
    rows = table(spark, folder, "unit_segments").dropDuplicates(["seg_id"]).where("quantised is not null")
    return rows.select("seg_id", F.filter("quantised", lambda u: u >= 0).alias("units"))


@query
def edit_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of sequences at an edit similarity of 0.4, dropping pairs by length as the behaviour to be matched does."""
    return pairs.edit_edges(_unit_sequences(spark, folder), 0.4).select("src", "dst", F.round("weight", 5).alias("weight"))


@query
def edit_edges_lossless(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.edit_edges(_unit_sequences(spark, folder), 0.4, "lossless").select("src", "dst", F.round("weight", 5).alias("weight"))


def _first_centroids(vectors: DataFrame, n: int = 20) -> DataFrame:
    return vectors.where(F.col("seg_id") < n).select(F.col("seg_id").alias("k"), "x")


@query
def nearest_centroid(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest of twenty vectors."""
    vectors = _labelled(spark, folder)[0]
    return neighbours.assign_nearest(vectors, _first_centroids(vectors)).select("seg_id", "k", F.round("distance2", 4).alias("distance2"))


@query
def lloyd_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Centroids after two rounds of k-means."""
    vectors = _labelled(spark, folder)[0]
    once = kmeans.lloyd_step(vectors, _first_centroids(vectors))
    return kmeans.lloyd_step(vectors, write_table(once.select("k", "x"), "centroids").df).select("k", "n", *shown("x"))


@query
def class_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return partition.class_numbers(_assignments(spark, folder))


@query
def class_numbers_by_size(spark: SparkSession, folder: str) -> DataFrame:
    return partition.class_numbers(_assignments(spark, folder), "size")


@query
def member_lists(spark: SparkSession, folder: str) -> DataFrame:
    found = partition.member_lists(_assignments(spark, folder))
    return found.select("class", F.size("members").alias("n_members"), F.concat_ws(" ", F.transform("members", lambda m: m.cast("string"))).alias("members"))


@query
def partition_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of a partition file of all clusters."""
    rows = table(spark, folder, "partition_file").where("utt_id is not null and end_sec > start_sec").dropDuplicates(["member_id"])
    places = rows.select(F.col("member_id").alias("seg_id"), "utt_id", timebase.seconds_to_frames(F.col("start_sec")).alias("start_frame"), timebase.seconds_to_frames(F.col("end_sec")).alias("end_frame"))
    return files.partition_lines(partition.partition_members(_assignments(spark, folder).join(places.select("seg_id"), "seg_id", "left_semi"), places))


@query
def cluster_sizes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "partition_file").dropDuplicates(["member_id"]).where("cluster >= 0")
    return partition.cluster_sizes(rows, ["run_id"])


@query
def size_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "partition_file").dropDuplicates(["member_id"]).where("cluster >= 0")
    found = partition.size_summary(partition.cluster_sizes(rows, ["run_id"]), ["run_id"], 1000)
    return found.withColumn("mean_size", F.round("mean_size", 6))


@query
def cluster_count(spark: SparkSession, folder: str) -> DataFrame:
    return partition.cluster_count(_assignments(spark, folder))


@query
def contiguous_labels(spark: SparkSession, folder: str) -> DataFrame:
    return partition.labels_are_contiguous(_assignments(spark, folder))


@query
def relabelled(spark: SparkSession, folder: str) -> DataFrame:
    return partition.relabelled(_assignments(spark, folder))


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    return zipf.clean_tokens(table(spark, folder, "textgrid").dropDuplicates(["token_id"]))


@query
def clean_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _tokens(spark, folder).select("token_id", "token")


@query
def token_ranks(spark: SparkSession, folder: str) -> DataFrame:
    found = zipf.rank_frequency(zipf.token_counts(_tokens(spark, folder)), "token")
    return found.withColumn("prob", F.round("prob", 8))


def _cluster_ranks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "partition_file").dropDuplicates(["member_id"]).where("cluster >= 0")
    return zipf.rank_frequency(partition.cluster_sizes(rows, ["run_id"]).withColumnRenamed("n_members", "cnt"), "cluster", ["run_id"])


@query
def cluster_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return _cluster_ranks(spark, folder).withColumn("prob", F.round("prob", 8))


@query
def rank_extent(spark: SparkSession, folder: str) -> DataFrame:
    """Largest share and rank of each run."""
    return zipf.extent(_cluster_ranks(spark, folder), ["run_id"]).withColumn("max_prob", F.round("max_prob", 8))


@query
def reference_curve(spark: SparkSession, folder: str) -> DataFrame:
    span = zipf.extent(_cluster_ranks(spark, folder))
    return zipf.reference_curve(span).select("i", F.round("r", 4).alias("r"), F.round("p", 8).alias("p"))


@query
def run_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return files.run_metadata(table(spark, folder, "runs").select("run_id", "path"))


@query
def plotted_runs(spark: SparkSession, folder: str) -> DataFrame:
    return zipf.plotted_runs(files.run_metadata(table(spark, folder, "runs").select("run_id", "path"))).select("run_id", "run_method")


@query
def component_stats(spark: SparkSession, folder: str) -> DataFrame:
    found = mixture.component_stats(*_labelled(spark, folder))
    return found.select("k", "n", *shown("s"), F.round(F.aggregate("ss", F.lit(0.0), lambda s, e: s + e), 4).alias("ss_sum"))


@query
def component_outer(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of outer products: their trace and their sum."""
    found = mixture.component_outer(*_labelled(spark, folder))
    d = F.size("s")
    trace = F.aggregate(F.transform(F.sequence(F.lit(0), d - 1), lambda i: F.get("outer", i * (d + 1))), F.lit(0.0), lambda s, e: s + e)
    return found.select("k", "n", F.round(trace, 4).alias("trace"), F.round(F.aggregate("outer", F.lit(0.0), lambda s, e: s + e), 4).alias("total"))


def _diag_prior() -> mixture.ConjugatePrior:
    return mixture.ConjugatePrior([0.0] * LABELLED_DIM, 0.05, LABELLED_DIM + 3, [0.1] * LABELLED_DIM)


def _fixed_prior() -> mixture.FixedPrior:
    return mixture.FixedPrior([0.02] * LABELLED_DIM, [0.0] * LABELLED_DIM, [0.4] * LABELLED_DIM)


@query
def fixed_prior(spark: SparkSession, folder: str) -> DataFrame:
    """The prior's variances, from the data."""
    row = segments.moments(_labelled(spark, folder)[0])
    return row.select(F.posexplode("var").alias("dim", "v")).select("dim", F.round((F.col("v") + 1e-6) * 0.1, 8).alias("var"), F.round((F.col("v") + 1e-6) * 0.1 / 0.05, 8).alias("var_0"))


@query
def log_marginal_fixed(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.log_marginal_fixed(mixture.component_stats(*_labelled(spark, folder)), _fixed_prior()).withColumn("log_marg", F.round("log_marg", 4))


@query
def log_marginal_diag(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.log_marginal_diag(mixture.component_stats(*_labelled(spark, folder)), _diag_prior()).withColumn("log_marg", F.round("log_marg", 4))


def _full_prior() -> mixture.ConjugatePrior:
    return mixture.ConjugatePrior([0.0] * LABELLED_DIM, 0.05, LABELLED_DIM + 3, [[0.1 * (i == j) for j in range(LABELLED_DIM)] for i in range(LABELLED_DIM)])


@query
def map_estimates(spark: SparkSession, folder: str) -> DataFrame:
    """Most probable mean and covariance of each full component: the covariance's trace and sum."""
    found = mixture.map_table(mixture.component_outer(*_labelled(spark, folder)), _full_prior())
    trace = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(LABELLED_DIM - 1)), lambda i: F.get("cov", i * (LABELLED_DIM + 1))), F.lit(0.0), lambda s, e: s + e)
    total = F.aggregate("cov", F.lit(0.0), lambda s, e: s + e)
    return found.select("k", "n", *shown("mean"), (F.round(trace, 6) + F.lit(0.0)).alias("trace"), (F.round(total, 6) + F.lit(0.0)).alias("total"))


@query
def log_marginal_full(spark: SparkSession, folder: str) -> DataFrame:
    found = mixture.marginals_full(mixture.component_outer(*_labelled(spark, folder)), _full_prior())
    return found.withColumn("log_marg", F.round("log_marg", 4))


@query
def log_prior_assignments(spark: SparkSession, folder: str) -> DataFrame:
    found = mixture.log_prior_assignments(mixture.component_stats(*_labelled(spark, folder)), 1.0, 16)
    return found.withColumn("log_prob_z", F.round("log_prob_z", 4))


@query
def predictive_fixed(spark: SparkSession, folder: str) -> DataFrame:
    """The most probable component of each vector, fixed variances."""
    vectors, labels = _labelled(spark, folder)
    found = mixture.score_predictive(vectors, mixture.component_stats(vectors, labels), _fixed_prior())
    return found.withColumn("log_pred", F.round("log_pred", 4))


@query
def predictive_diag(spark: SparkSession, folder: str) -> DataFrame:
    vectors, labels = _labelled(spark, folder)
    found = mixture.score_predictive(vectors, mixture.component_stats(vectors, labels), _diag_prior())
    return found.withColumn("log_pred", F.round("log_pred", 4))


@query
def assignment_posteriors(spark: SparkSession, folder: str) -> DataFrame:
    """Probability of each component for each vector, fixed variances."""
    vectors, labels = _labelled(spark, folder)
    found = mixture.assignment_posteriors(vectors, mixture.component_stats(vectors, labels), _fixed_prior(), 1.0, 16)
    return found.withColumn("prob", F.round("prob", 6) + F.lit(0.0))


@query
def gmm_step(spark: SparkSession, folder: str) -> DataFrame:
    """One round of expectation maximisation from twenty vectors with equal weights and variances."""
    vectors = _labelled(spark, folder)[0]
    _, c = neighbours.centroid_matrix(_first_centroids(vectors))
    model, _ = gmm.em_step(vectors, gmm.Spherical(np.full(len(c), 1 / len(c)), c, np.full(len(c), 0.05)))
    means = neighbours.centroid_table(spark, np.column_stack([model.weight, model.var, model.mean]))
    rows = means.select("k", F.round(F.element_at("x", 1), 6).alias("weight"), F.round(F.element_at("x", 2), 6).alias("var"), F.slice("x", 3, LABELLED_DIM).alias("m"))
    return rows.select("k", "weight", "var", *shown("m"))


@query
def log_densities(spark: SparkSession, folder: str) -> DataFrame:
    """Normal and Student t densities of the events' values."""
    rows = table(spark, folder, "events").where("value is not null")
    x = F.col("value")
    return rows.select("event_id", F.round(special.log_normal(x, F.lit(10.0), F.lit(25.0)), 5).alias("normal"), F.round(special.log_student_t(x, F.lit(10.0), F.lit(25.0), F.lit(7.0)), 5).alias("student"), F.round(special.lgamma(x + 0.25), 5).alias("lgamma"))


@query
def quality_cpm(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of a partition of the edge list by number."""
    vertices, edges = _graph(spark, folder)
    found = community.partition_quality(vertices.select("seg_id", (F.col("seg_id") % 50).alias("cluster")), edges, "cpm", 0.01)
    return found.withColumn("quality", F.round("quality", 4))


@query
def quality_modularity(spark: SparkSession, folder: str) -> DataFrame:
    vertices, edges = _graph(spark, folder)
    found = community.partition_quality(vertices.select("seg_id", (F.col("seg_id") % 50).alias("cluster")), edges, "modularity")
    return found.withColumn("quality", F.round("quality", 4))


@query
def graph_components(spark: SparkSession, folder: str) -> DataFrame:
    vertices, edges = _graph(spark, folder)
    return community.components(vertices, edges.where("weight >= 0.7"))


@query
def quality_rb(spark: SparkSession, folder: str) -> DataFrame:
    vertices, edges = _graph(spark, folder)
    found = community.partition_quality(vertices.select("seg_id", (F.col("seg_id") % 50).alias("cluster")), edges, "rb", 0.7)
    return found.withColumn("quality", F.round("quality", 4))


# Files: tables written as the files that the analysis works on, and read again.


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@query
def frame_files(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors by recording, in order of their first frame, through matrix files."""
    to = _folder(spark, "frames")
    segment_files.write_frames(_frames(spark, folder), to)
    return files.read_frames(spark, to).select("utt_id", "frame", *shown("x"))


@query
def boundary_files(spark: SparkSession, folder: str) -> DataFrame:
    """Boundary times through list files."""
    rows = table(spark, folder, "boundaries").where("utt_id is not null and pos is not null and end_sec is not null").distinct()
    lines = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("pos", "end_sec"))), lambda r: r["end_sec"].cast("string")))
    to = _folder(spark, "boundaries")
    segment_files.write_files(rows.groupBy("utt_id").agg(lines.alias("content")).select(F.concat("utt_id", F.lit(".list")).alias("name"), "content"), to)
    return files.read_boundaries(spark, to)


@query
def textgrid_files(spark: SparkSession, folder: str) -> DataFrame:
    """Gold intervals with times through TextGrid files, one tier a file."""
    rows = table(spark, folder, "textgrid").where("utt_id is not null and tier is not null and interval_start is not null and interval_end is not null").dropDuplicates(["token_id"])
    label = F.regexp_replace(F.coalesce("label", F.lit("")), '"', '""')
    one = F.format_string('        intervals [1]:\n            xmin = %s\n            xmax = %s\n            text = "%s"\n', F.col("interval_start").cast("string"), F.col("interval_end").cast("string"), label)
    head = F.format_string('    item [1]:\n        class = "IntervalTier"\n        name = "%s"\n', "tier")
    content = F.concat(head, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_id", one.alias("t")))), lambda r: r["t"]), ""))
    to = _folder(spark, "textgrids")
    by_tier = rows.groupBy("utt_id", "tier").agg(content.alias("content"))
    segment_files.write_files(by_tier.select(F.concat("utt_id", F.lit("."), "tier", F.lit(".TextGrid")).alias("name"), "content"), to)
    return files.read_textgrids(spark, to).withColumn("utt_id", F.regexp_replace("utt_id", r"\.[^.]*$", ""))


@query
def partition_files(spark: SparkSession, folder: str) -> DataFrame:
    """All clusters through a partition file in parts."""
    rows = table(spark, folder, "partition_file").where("utt_id is not null and end_sec > start_sec").dropDuplicates(["member_id"])
    places = rows.select(F.col("member_id").alias("seg_id"), "utt_id", timebase.seconds_to_frames(F.col("start_sec")).alias("start_frame"), timebase.seconds_to_frames(F.col("end_sec")).alias("end_frame"))
    to = _folder(spark, "partition")
    files.write_partition(partition.partition_members(_assignments(spark, folder).join(places.select("seg_id"), "seg_id", "left_semi"), places), to)
    return files.read_partition(spark, to, in_parts=True).select("class", "pos", "utt_id", "start_sec", "end_sec")


@query
def pooled_files(spark: SparkSession, folder: str) -> DataFrame:
    """Segment vectors through files named by recording and frames; of segments at one place the first counts."""
    rows = segments.valid_vectors(table(spark, folder, "segments").where("utt_id is not null"), DIM, keep=["utt_id", "start_frame", "end_frame"])
    one = rows.groupBy("utt_id", "start_frame", "end_frame").agg(F.min_by("x", "seg_id").alias("features"))
    to = _folder(spark, "pooled")
    segment_files.write_segments(one, to)
    return segment_files.read_pooled(spark, to).select("utt_id", "start_frame", "end_frame", *shown("features"))


@query
def unit_files(spark: SparkSession, folder: str) -> DataFrame:
    """Unit sequences without missing frames through files; of sequences at one place the first counts."""
    rows = table(spark, folder, "unit_segments").where("utt_id is not null and quantised is not null").dropDuplicates(["seg_id"])
    one = rows.groupBy("utt_id", "start_frame", "end_frame").agg(F.min_by(F.filter("quantised", lambda u: u >= 0), "seg_id").alias("units"))
    to = _folder(spark, "units")
    segment_files.write_segments(one, to, "units")
    return segment_files.read_units(spark, to).select("utt_id", "start_frame", "end_frame", F.concat_ws(" ", F.col("units").cast("array<string>")).alias("units"))


# Iterated fits, from given starts where the result is compared in full.


@query
def kmeans_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """k-means from the first ten vectors, eight rounds."""
    vectors = _labelled(spark, folder)[0]
    return kmeans.kmeans(vectors, 10, 8, init=_first_centroids(vectors, 10))[0].select("seg_id", "k", F.round("distance2", 4).alias("distance2"))


@query
def gmm_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """A Gaussian mixture from the first ten vectors with equal weights and variances, five rounds."""
    vectors = _labelled(spark, folder)[0]
    _, c = neighbours.centroid_matrix(_first_centroids(vectors, 10))
    start = gmm.Spherical(np.full(len(c), 1 / len(c)), c, np.full(len(c), 0.05))
    found = gmm.fit_gmm(vectors, 10, max_iter=5, tol=0.0, init=start)[0]
    return found.select("seg_id", "k", F.round("log_likelihood", 3).alias("log_likelihood"))


@query
def codebook_units(spark: SparkSession, folder: str) -> DataFrame:
    """Each frame's nearest vector of a codebook of 20, fitted from the first vectors in five rounds."""
    vectors = _labelled(spark, folder)[0]
    frames = vectors.select(F.lit("all").alias("utt_id"), F.col("seg_id").cast("int").alias("frame"), "x")
    return kmeans.quantise(frames, kmeans.fit_codebook(frames, 20, rounds=5, init=_first_centroids(vectors)))


@query
def predictive_full(spark: SparkSession, folder: str) -> DataFrame:
    """The most probable full-covariance component of each vector."""
    vectors, labels = _labelled(spark, folder)
    found = mixture.score_predictive_full(vectors, mixture.component_outer(vectors, labels), _full_prior())
    return found.withColumn("log_pred", F.round("log_pred", 3))


@query
def principal_components(spark: SparkSession, folder: str) -> DataFrame:
    """Squared length of each standardised frame in all principal components, which keep it."""
    frames = _labelled(spark, folder)[0]
    stats, loadings = scaling.fit_scaler_pca(frames, LABELLED_DIM)
    found = scaling.project(frames, stats, loadings, ["seg_id"])
    return found.select("seg_id", F.round(arrays.dot(F.col("x"), F.col("x")), 4).alias("x_square"))


@query
def principal_variances(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the components are uncorrelated and in order of variance, and their variance in all."""
    frames = _labelled(spark, folder)[0]
    stats, loadings = scaling.fit_scaler_pca(frames, LABELLED_DIM)
    projected = write_table(scaling.project(frames, stats, loadings, ["seg_id"]), "projected").df
    outer = mixture.component_outer(projected, projected.select("seg_id", F.lit(0).alias("k"))).first()
    cov = np.array(outer["outer"]).reshape(LABELLED_DIM, LABELLED_DIM) / outer["n"]
    apart = bool(np.abs(cov - np.diag(np.diag(cov))).max() < 1e-6)
    row = (apart, bool((np.diff(np.diag(cov)) < 1e-9).all()), round(float(np.trace(cov)), 4))
    return spark.createDataFrame([row], "uncorrelated boolean, in_order boolean, variance double")


@query
def agglomerative_single(spark: SparkSession, folder: str) -> DataFrame:
    """Single linkage of normalised segments up to a cosine distance of 0.26: the components of the similarity graph."""
    vectors = write_table(_vectors(spark, folder), "vectors").df
    return agglomerative.agglomerative(vectors, threshold=0.26, linkage="single", metric="cosine")


# What seeds or ties decide is compared by what must hold of any right result.


@query
def seeded_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """k-means++: how many centroids, and how many of them are different vectors of the table."""
    vectors = _labelled(spark, folder)[0]
    found = kmeans.seed_centroids(vectors, 10).select(F.col("x").cast("array<float>").alias("x"))
    known = found.join(vectors.select(F.col("x").cast("array<float>").alias("x")).distinct(), "x", "left_semi").distinct()
    return found.agg(F.count("*").alias("n")).crossJoin(known.agg(F.count("*").alias("n_known")))


@query
def sampled_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """A sample of sixty vectors for seeding twenty centroids: how many, and how many different ones of the table."""
    vectors = _labelled(spark, folder)[0]
    found = segments.hash_sample(vectors, "seg_id", 60).select("seg_id")
    return found.agg(F.count("*").alias("n")).crossJoin(found.join(vectors, "seg_id", "left_semi").distinct().agg(F.count("*").alias("n_known")))


@query
def birch_features(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf features of all trees: their counts and sums, which add up to those of the vectors, and whether each radius
    is within the threshold."""
    found = birch.fit_features(_labelled(spark, folder)[0], LABELLED_DIM)
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    fits = q / n - arrays.dot(s, s) / (n * n) <= 0.25 + 1e-9
    total = F.aggregate(s, F.lit(0.0), lambda a, b: a + b)
    return found.agg(F.sum("n").cast("bigint").alias("n"), F.round(F.sum(total), 3).alias("s"), F.round(F.sum("q"), 3).alias("q"), F.every(fits).alias("within"))


@query
def birch_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors and clusters, and vectors that are in none or several."""
    vectors = _labelled(spark, folder)[0]
    found = write_table(birch.birch(vectors, 10, LABELLED_DIM), "birch").df
    return found.agg(F.count("*").alias("n"), F.countDistinct("k").alias("n_clusters"), (F.count("*") - F.countDistinct("seg_id")).alias("n_repeated"))


@query
def agglomerative_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Average linkage of normalised segments up to a cosine distance of 0.26: vectors, clusters that span components of
    the similarity graph, and pairs of clusters of a component that could still be joined."""
    vectors = write_table(_vectors(spark, folder), "vectors").df
    within = community.components(pairs.graph_vertices(vectors), pairs.cosine_links(vectors, 0.74 - 1e-9))
    found = write_table(agglomerative.agglomerative(vectors, threshold=0.26, metric="cosine", parts=within), "clusters").df
    placed = found.join(within, "seg_id")
    spanning = placed.groupBy("cluster").agg(F.countDistinct("component").alias("n")).where("n > 1").agg(F.count("*").alias("n_spanning"))
    sums = segments.mean_vector(placed.join(vectors, "seg_id"), ["component", "cluster"], "x", "m")
    a, b = sums.alias("a"), sums.alias("b")
    near = a.join(b, F.expr("a.component = b.component and a.cluster < b.cluster")).where(1 - arrays.dot(F.col("a.m"), F.col("b.m")) < 0.26 - 1e-6)
    return found.agg(F.count("*").alias("n")).crossJoin(spanning).crossJoin(near.agg(F.count("*").alias("n_joinable")))


def _checked_communities(vertices: DataFrame, edges: DataFrame, found: DataFrame, within: DataFrame, resolution: float) -> DataFrame:
    """Vertices, vertices in none or several communities, communities that are not connected, and whether CPM prefers
    them to the components and to single vertices."""
    a, b = found.select(F.col("seg_id").alias("src"), F.col("cluster").alias("ca")), found.select(F.col("seg_id").alias("dst"), F.col("cluster").alias("cb"))
    inner = write_table(edges.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst", "weight"), "inner").df  # all that CPM counts
    pieces = community.components(vertices, inner).select("component").distinct().count() - found.select("cluster").distinct().count()
    parts = within.select("seg_id", F.col("component").alias("cluster"))
    quality = [community.partition_quality(p, e, "cpm", resolution).first()["quality"] for p, e in ((found, inner), (parts, edges))]
    counts = found.agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("seg_id")).alias("n_repeated"))
    return counts.select("n", "n_repeated", F.lit(pieces).cast("bigint").alias("n_in_pieces"), F.lit(quality[0] >= max(quality[1], 0.0) - 1e-9).alias("preferred"))


@query
def leiden_communities(spark: SparkSession, folder: str) -> DataFrame:
    """Communities of the similarity graph at 0.5, and what must hold of them."""
    vectors = write_table(_vectors(spark, folder), "vectors").df
    vertices, edges = pairs.graph_vertices(vectors), write_table(pairs.cosine_edges(vectors, 0.5), "edges").df
    within = community.components(vertices, edges)
    found = write_table(community.leiden_partition(vertices, edges, "cpm", 0.5, parts=within), "communities").df
    return _checked_communities(vertices, edges, found, within, 0.5)


@query
def tuned_communities(spark: SparkSession, folder: str) -> DataFrame:
    """Communities of the edge list, tuned to a tenth as many as there are vertices: vertices, vertices that are in none or
    several, and whether no partition of the search came nearer to that number."""
    vertices, edges = (write_table(t, "graph").df for t in _graph(spark, folder))
    target = max(1, vertices.count() // 10)
    found, _, history = community.tuned_partition(vertices, edges, target, resolution=0.1, max_iter=3)
    k = found.select("cluster").distinct().count()
    best = abs(k - target) <= min(abs(h["diff"]) for h in history)
    return found.agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("seg_id")).alias("n_repeated"), F.lit(best).alias("best"))


@query
def fbgmm_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Two sweeps of the Gibbs sampler: vectors, vectors whose component is out of range, sweeps, and whether the recorded
    log probability is that of the data and the assignments by the operators for these."""
    vectors = _labelled(spark, folder)[0]
    found, trace = gibbs.fbgmm(vectors, _fixed_prior(), 20, n_iter=2)
    stats = write_table(mixture.component_stats(vectors, found), "stats").df
    data = mixture.log_marginal_fixed(stats, _fixed_prior()).agg(F.sum("log_marg").alias("v")).first()["v"]
    prior = mixture.log_prior_assignments(stats, 1.0, 20).first()["log_prob_z"]
    recorded = trace.orderBy(F.desc("iter")).first()["log_marg"]
    out = F.count(F.when(~F.col("k").between(0, 19), 1)).alias("n_outside")
    return found.agg(F.count("*").alias("n"), out).crossJoin(trace.agg(F.count("*").alias("n_sweeps"))).withColumn("agrees", F.lit(abs(recorded - data - prior) < 1e-6 * abs(recorded)))


@query
def similarity_degrees(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: segments, centred and normalised, joined by similarity, and each one's degree."""
    vectors = write_table(_vectors(spark, folder), "vectors").df
    return pairs.cosine_degrees(vectors, 0.74).select("seg_id", "degree", F.round("strength", 3).alias("strength"))
