"""Clusters as tables: class numbers, sizes, and members for the partition file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import number_rows


def class_numbers(assignments: DataFrame, order: str = "first") -> DataFrame:
    """``cluster, class, n_members``: classes numbered from 0 in order of their smallest member (``"first"``), or
    by falling size, then smallest member (``"size"``). ``assignments``: ``seg_id, cluster``; a null cluster is
    none. Clusters are range-partitioned and numbered with offsets, so that there may be any number of them."""
    sizes = assignments.where("cluster is not null").groupBy("cluster").agg(F.count("*").alias("n_members"), F.min("seg_id").alias("first_id"))
    keys = ["first_id"] if order == "first" else ["neg", "first_id"]
    numbers = number_rows(sizes.withColumn("neg", -F.col("n_members")), keys, "class", "classes")
    return numbers.select("cluster", F.col("class").cast("int").alias("class"), "n_members")


def member_lists(assignments: DataFrame) -> DataFrame:
    """``class, members``: the sorted ids of each class as one list, which is the list form of a partition; a
    class must fit into a row."""
    classes = class_numbers(assignments)
    return assignments.join(classes, "cluster").groupBy("class").agg(F.array_sort(F.collect_list("seg_id")).alias("members"))


def partition_members(assignments: DataFrame, segments: DataFrame, order: str = "first") -> DataFrame:
    """``class, pos, utt_id, start_frame, end_frame``: what ``sources.files.write_partition`` takes."""
    classes = class_numbers(assignments, order)
    rows = assignments.join(classes, "cluster").join(segments.select("seg_id", "utt_id", "start_frame", "end_frame"), "seg_id")
    return rows.select("class", F.col("seg_id").alias("pos"), "utt_id", "start_frame", "end_frame")


def cluster_sizes(assignments: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of each cluster, and of each of ``keys``; a null cluster is none."""
    return assignments.where("cluster is not null").groupBy(*(keys or []), "cluster").agg(F.count("*").alias("n_members"))


def size_summary(sizes: DataFrame, keys: list[str] | None = None, k_target: int | None = None) -> DataFrame:
    """``active, min_size, median_size, mean_size, max_size`` (and ``empty``, against ``k_target``) of cluster sizes."""
    s = sizes.groupBy(*(keys or [])).agg(F.count("*").alias("active"), F.min("n_members").alias("min_size"), F.median("n_members").alias("median_size"), F.avg("n_members").alias("mean_size"), F.max("n_members").alias("max_size"))
    return s if k_target is None else s.withColumn("empty", F.lit(k_target) - F.col("active"))


def cluster_count(assignments: DataFrame) -> DataFrame:
    """``n_clusters``, one row."""
    return assignments.agg(F.count_distinct("cluster").alias("n_clusters"))


def labels_are_contiguous(assignments: DataFrame) -> DataFrame:
    """``contiguous``, one row: whether the clusters other than -1 are numbered from 0 without gaps."""
    used = assignments.where("cluster >= 0").agg(F.count_distinct("cluster").alias("n"), F.max("cluster").alias("m"))
    return used.select((F.coalesce(F.col("m") + 1, F.lit(0)) == F.col("n")).alias("contiguous"))


def relabelled(assignments: DataFrame) -> DataFrame:
    """``seg_id, cluster`` with clusters numbered from 0 without gaps, in their order; -1 and null stay."""
    used = assignments.where("cluster >= 0").select("cluster").distinct()
    numbers = number_rows(used, ["cluster"], "number", "clusters")
    return assignments.join(numbers, "cluster", "left").select("seg_id", F.coalesce("number", "cluster").cast("int").alias("cluster"))
