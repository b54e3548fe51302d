"""Feature matrices, boundary lists, partition files, TextGrids and run names, read in parallel by executors."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.timebase import frames_to_seconds
from ..operators.numbering import number_rows
from ..session import write_table


def stem(path: Column) -> Column:
    """A path's last part without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def read_frames(spark: SparkSession, folder: str) -> DataFrame:
    """``utt_id, frame, x`` of all ``*.npy`` files below ``folder``: one matrix an utterance, whose name is the
    file's. A matrix of one dimension is one frame. Empty matrices give no row; pickled objects are refused."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(folder).select(stem(F.col("path")).alias("utt_id"), "content")
    schema = pa.schema([("utt_id", pa.string()), ("frame", pa.int32()), ("x", pa.list_(pa.float32()))])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                x = x.reshape(1, -1) if x.ndim == 1 else x
                for begin in range(0, len(x) if x.size else 0, 4096):
                    part = np.asarray(x[begin : begin + 4096], np.float32)
                    values = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(begin, begin + len(part), dtype=np.int32)), values], schema=schema)

    return files.mapInArrow(load, "utt_id string, frame int, x array<float>")


def read_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    """``utt_id, pos, end_sec`` of all ``*.list`` files below ``folder``: one time a line, blank lines and what
    follows a ``#`` left out. ``pos`` counts the times of a file from 0."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.list").text(folder, wholetext=True)
    lines = files.select(stem(F.col("_metadata.file_path")).alias("utt_id"), F.split("value", r"\r?\n").alias("lines"))
    clean = F.filter(F.transform("lines", lambda v: F.trim(F.regexp_replace(v, "#.*$", ""))), lambda v: v != "")
    return lines.select("utt_id", F.posexplode(clean).alias("pos", "v")).select("utt_id", "pos", F.col("v").cast("double").alias("end_sec"))


def partition_lines(members: DataFrame) -> DataFrame:
    """``class, part, pos, line`` of a partition file, whose order is that of the first three: for each class a
    heading ``Class k`` (part 0), a line ``utterance start end`` for each member, with times in seconds (part 1),
    and an empty line (part 2). ``members`` has ``class, pos, utt_id, start_frame, end_frame``."""
    start, end = (frames_to_seconds(F.col(c)).cast("string") for c in ("start_frame", "end_frame"))
    none = F.lit(-1).cast("bigint")
    body = members.select("class", F.lit(1).alias("part"), F.col("pos").cast("bigint").alias("pos"), F.concat_ws(" ", "utt_id", start, end).alias("line"))
    classes = members.select("class").distinct()
    heads = classes.select("class", F.lit(0).alias("part"), none.alias("pos"), F.concat(F.lit("Class "), F.col("class").cast("string")).alias("line"))
    return heads.unionByName(body).unionByName(classes.select("class", F.lit(2).alias("part"), none.alias("pos"), F.lit("").alias("line")))


def write_partition(members: DataFrame, path: str) -> None:
    """Write a partition as text files that, in the order of their names, are one partition file: the lines are
    range-partitioned by class and position, so no task holds more than its share."""
    order = ("class", "part", "pos")
    partition_lines(members).repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path)


def read_partition(spark: SparkSession, path: str, in_parts: bool = False) -> DataFrame:
    """``path, class, pos, utt_id, start_sec, end_sec`` of partition files: one file, or a folder of whole ones. With
    ``in_parts`` the files of the folder, in the order of their names, are one partition, as ``write_partition`` leaves
    it; ``path`` is the folder then.

    A line of three parts is a member, one of two parts is a heading, all others do not count. A heading without
    members gives no class, so classes are numbered by the headings that have members. A file is read in splits, by
    many tasks: lines are numbered within their split, and what precedes a split comes from one row a split.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.filter(F.split(F.trim("value"), r"\s+"), lambda v: v != "").alias("part"))
    source = F.lit(path) if in_parts else F.col("file")
    kept = lines.where(F.size("part").isin(2, 3)).select(source.alias("path"), "file", "start", "at", (F.size("part") == 2).cast("bigint").alias("heading"), "part")
    inside = Window.partitionBy("path", "file", "start").orderBy("at")
    counted = write_table(kept.withColumn("h", F.sum("heading").over(inside)).withColumn("m", F.sum(1 - F.col("heading")).over(inside)), "partition").df
    splits = counted.groupBy("path", "file", "start").agg(F.max("h").alias("hs"), F.max("m").alias("ms"))
    before = Window.partitionBy("path").orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("path", "file", "start", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("hs", "ms")))
    members = counted.where("heading = 0").join(offsets, ["path", "file", "start"]).select("path", (F.col("h") + F.col("hs")).alias("block"), (F.col("m") + F.col("ms")).alias("number"), "part")
    blocks = write_table(members.groupBy("path", "block").agg(F.min("number").alias("first")), "classes").df
    numbered = number_rows(blocks, ["path", "block"], "nth")
    zero = numbered.groupBy("path").agg(F.min("nth").alias("least"))
    classes = numbered.join(F.broadcast(zero), "path").select("path", "block", "first", (F.col("nth") - F.col("least")).cast("int").alias("class"))
    seconds = [F.element_at("part", i).cast("double").alias(c) for i, c in ((2, "start_sec"), (3, "end_sec"))]
    return members.join(classes, ["path", "block"]).select("path", "class", (F.col("number") - F.col("first")).cast("int").alias("pos"), F.element_at("part", 1).alias("utt_id"), *seconds)


_ITEM = re.compile(r'^\s*(item\s*\[\d+\]:|intervals\s*\[\d+\]:?|class\s*=\s*"(?P<cls>[^"]*)"|name\s*=\s*"(?P<name>(?:[^"]|"")*)"|xmin\s*=\s*(?P<xmin>\S+)|xmax\s*=\s*(?P<xmax>\S+)|text\s*=\s*"(?P<text>(?:[^"]|"")*)")', re.M)


def parse_textgrid(content: str) -> list[tuple[str, float, float, str]]:
    """(tier, start, end, label) of the interval tiers of a TextGrid in the long text form. A doubled quote in a
    label is one quote; labels may hold line breaks."""
    out: list[tuple[str, float, float, str]] = []
    tier, kind, start, end, inside = "", "", 0.0, 0.0, False
    for m in _ITEM.finditer(content):
        head = m.group(1)
        if head.startswith("item"):
            tier, kind, inside = "", "", False
        elif m.group("cls") is not None:
            kind = m.group("cls")
        elif m.group("name") is not None:
            tier = m.group("name").replace('""', '"')
        elif head.startswith("intervals"):
            inside = True
        elif m.group("xmin") is not None:
            start = float(m.group("xmin"))
        elif m.group("xmax") is not None:
            end = float(m.group("xmax"))
        elif m.group("text") is not None and inside and kind == "IntervalTier":
            out.append((tier, start, end, m.group("text").replace('""', '"')))
    return out


def read_textgrids(spark: SparkSession, folder: str) -> DataFrame:
    """``utt_id, tier, interval_start, interval_end, label`` of all ``*.TextGrid`` files below ``folder``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.TextGrid").load(folder).select(stem(F.col("path")).alias("utt_id"), "content")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py()
                text = data.decode("utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig")
                rows = parse_textgrid(text)
                columns = [[name] * len(rows), *([r[i] for r in rows] for i in range(4))]
                types = [pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["utt_id", "tier", "interval_start", "interval_end", "label"])

    return files.mapInArrow(load, "utt_id string, tier string, interval_start double, interval_end double, label string")


def run_metadata(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """``paths`` with ``stem, run_threshold, run_resolution, run_method``, parsed from the name.

    The threshold is the number that begins with ``t0``, the resolution the one that begins with ``r0``; null where
    there is none. The method is the first of these that the name contains: kmeans, birch, agglomerative, cosine
    or graph, fbgmm; null if none. A null path gives nulls.
    """
    name = stem(F.col(path_col))
    low = F.lower(name)

    def number(letter: str) -> Column:
        # What stands between the first ``t0`` and the next underscore, with the zero before it.
        part = F.regexp_extract(name, rf"{letter}(0[^_]*)", 1)
        return F.when(part != "", part.try_cast("double"))

    method = F.when(low.contains("kmeans"), "K-means").when(low.contains("birch"), "BIRCH").when(low.contains("agglomerative"), "Agglomerative").when(low.contains("cosine") | low.contains("graph"), "Graph").when(low.contains("fbgmm"), "FBGMM")
    return paths.select("*", name.alias("stem"), number("t").alias("run_threshold"), number("r").alias("run_resolution"), method.alias("run_method"))
