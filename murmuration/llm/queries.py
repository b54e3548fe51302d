"""The queries of this subpackage: each takes a session and a folder of tables, and runs over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import asof, components, groups, knn, leaks, runs, terms, textstats, tokens, vectors


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    pairs = terms.label_pairs(_table(spark, folder, "textgrid")).unionByName(terms.cluster_pairs(_table(spark, folder, "partition_file")))
    return terms.marked_terms(pairs)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms that are too rare or too common."""
    marks = F.array_compact(F.array(F.when(F.col("rare"), "rare"), F.when(F.col("common"), "common")))
    return _terms(spark, folder).select("field", "term", F.explode(marks).alias("mark"))


def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences and records of every term."""
    return _terms(spark, folder).select("field", "term", "n_rows", "n_records")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of groups whose members are all alike, and like none outside."""
    found = groups.similarity_groups(_table(spark, folder, "segments"))
    return found.where("tight and n_component > 1").select(F.col("id").alias("seg_id"), "group_id")


def p2_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Size and most typical members of every group, and of every discovered cluster.

    ``kind`` is ``tight`` or ``loose`` for a group, whose ``number`` is its group_id and ``run_id`` -1, and ``cluster``
    for a cluster, whose ``number`` is its own. ``n_segments`` of a cluster's members have a segment. ``typical_ids``
    are set apart by blanks, the most typical first."""
    segments = _table(spark, folder, "segments")
    centred = vectors.centre(vectors.vector_rows(segments, "seg_id", "features"), 96)
    of_groups = groups.group_profiles(groups.similarity_groups(segments, centred=centred), segments, centred=centred)
    of_clusters = groups.cluster_profiles(_table(spark, folder, "partition_file"), segments, centred=centred)
    ids = F.concat_ws(" ", F.col("typical_ids").cast("array<string>")).alias("typical_ids")
    rows = of_groups.select(F.when(F.col("tight"), "tight").otherwise("loose").alias("kind"), F.lit(-1).alias("run_id"), F.col("group_id").alias("number"), "n_members", F.col("n_members").alias("n_segments"), ids)
    return rows.unionByName(of_clusters.select(F.lit("cluster").alias("kind"), "run_id", F.col("cluster").cast("bigint").alias("number"), "n_members", "n_segments", ids))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of segments at 0.97 or more that are among one another's five most similar."""
    pairs = knn.similar_pairs(_table(spark, folder, "segments"), k=5, min_similarity=0.97)
    return pairs.select(F.col("id_a").alias("seg_id_a"), F.col("id_b").alias("seg_id_b"))


#: Wider lists for a set of queries that have no near neighbour: most of the recall is lost on these.
KNN_OPTIONS = {"k": 10, "queries": "id % 50 = 0", "store_ratio": 1.15, "query_ratio": 1.4, "most_stored": 5, "most_searched": 64}


def p3_knn(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most similar segments of every segment whose id is divisible by 50, among all segments."""
    found = knn.nearest_vectors(_table(spark, folder, "segments"), **KNN_OPTIONS)
    return found.select(F.col("id").alias("seg_id"), F.col("neighbour").alias("neighbour_id"), "place", F.round("similarity", 5).alias("similarity"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The gold word nearest to each discovered segment, at most 0.1 s away."""
    members = _table(spark, folder, "partition_file").where("end_sec > start_sec")
    clean = terms.cleaned_label(F.col("label"))
    words = _table(spark, folder, "textgrid").where((F.col("tier") == "words") & F.col("label").isNotNull() & ~terms.is_silence(clean) & (F.col("interval_end") > F.col("interval_start")))
    left = members.select(F.col("utt_id").alias("entity"), ((F.col("start_sec") + F.col("end_sec")) / 2).alias("time"), F.col("member_id").alias("id"))
    right = words.select(F.col("utt_id").alias("entity"), ((F.col("interval_start") + F.col("interval_end")) / 2).alias("time"), F.col("token_id").alias("id"))
    return asof.match_nearest(left, right, tolerance=0.1).select(F.col("left_id").alias("member_id"), F.col("right_id").alias("token_id"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of at least five near-identical units."""
    found = runs.sequence_runs(_table(spark, folder, "unit_segments"), _table(spark, folder, "codebook"), min_length=5)
    return found.select("seg_id", "run_start", "base_unit", "run_length")


def p5_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """Every sequence with each run as one unit, with its count and duration."""
    return runs.sequence_runs(_table(spark, folder, "unit_segments"), _table(spark, folder, "codebook")).select("seg_id", "run_start", "base_unit", "run_length", F.round("duration_sec", 2).alias("duration_sec"))


def p5_events(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of equal consecutive gold labels of each recording and tier."""
    rows = _table(spark, folder, "textgrid").where("utt_id is not null and tier is not null")
    events = rows.select(F.concat("utt_id", F.lit("/"), "tier").alias("entity"), F.col("interval_start").alias("time"), F.col("token_id").alias("id"), F.col("label").alias("event"))
    return runs.event_runs(events).withColumn("event", F.coalesce("event", F.lit("(none)")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The group of every segment that is linked with another."""
    return components.connected_components(components.countable_links(_table(spark, folder, "edge_list")), id_col="seg_id")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_corpus(_table(spark, folder, "documents"))


def p7_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text, encoded and decoded again: its length and a digest of it."""
    back = tokens.decode_corpus(tokens.encode_corpus(_table(spark, folder, "documents")))
    return back.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold twelve consecutive words of an evaluation item."""
    return leaks.leaked_items(_table(spark, folder, "documents"), _table(spark, folder, "eval_items"))


def p8_near(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold twelve consecutive words of an evaluation item with up to two edits."""
    return leaks.leaked_items(_table(spark, folder, "documents"), _table(spark, folder, "eval_items"), max_edits=2)


def _statistics(spark: SparkSession, folder: str) -> DataFrame:
    return textstats.text_statistics(_table(spark, folder, "documents"), _table(spark, folder, "common_words"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Marks of every document, by the ranks of its statistics within its language."""
    return textstats.ranked_marks(_statistics(spark, folder))


def p9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every document."""
    return _statistics(spark, folder).select("doc_id", *textstats.COUNTS)


def p9_outliers(spark: SparkSession, folder: str) -> DataFrame:
    """How unusual every document is within its language."""
    return textstats.outlier_scores(_statistics(spark, folder)).withColumn("outlier_score", F.round("outlier_score", 4))


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p2_found, p2_profiles, p3_found, p3_knn, p4_found, p5_found, p5_collapsed, p5_events, p6_found, p7_ids, p7_decoded, p8_found, p8_near, p9_found, p9_statistics, p9_outliers)}
