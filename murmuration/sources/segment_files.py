"""Segments as files ``<utterance>_<start>_<end>.npy``: pooled vectors and unit sequences, written and read by executors.

The folder may be on any file system that pyarrow knows by its URI; all executors must see it.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import stem

# Parts of file names that mark kept models, and of names that end in two whole numbers.
MODEL_MARK = "model"
_KEY = r"^(.*)_(-?\d+)_(-?\d+)$"
_KEYS = ("utt_id", "start_frame", "end_frame")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(folder)
    name = stem(F.col("path"))
    return found.select("path", "content", name.alias("name")).where(~F.col("name").contains(MODEL_MARK))


def segment_keys(names: DataFrame, name_col: str = "name") -> DataFrame:
    """``names`` with ``utt_id, start_frame, end_frame``, parsed from the end of the name; null where it has no such end."""
    part = [F.regexp_extract(name_col, _KEY, i) for i in (1, 2, 3)]
    known = F.col(name_col).rlike(_KEY)
    return names.select("*", *(F.when(known, p.cast(t)).alias(k) for k, p, t in zip(_KEYS, part, ("string", "int", "int"))))


def _read(spark: SparkSession, folder: str, out: str, kind: pa.DataType, sql: str) -> DataFrame:
    files = segment_keys(_files(spark, folder)).where("utt_id is not null").select(*_KEYS, "content")
    schema = pa.schema([("utt_id", pa.string()), ("start_frame", pa.int32()), ("end_frame", pa.int32()), (out, pa.list_(kind))])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.load(io.BytesIO(c.as_py()), allow_pickle=False).ravel().astype(kind.to_pandas_dtype()) for c in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(values, pa.list_(kind))], schema=schema)

    return files.mapInArrow(load, f"utt_id string, start_frame int, end_frame int, {out} array<{sql}>")


def read_pooled(spark: SparkSession, folder: str) -> DataFrame:
    """``utt_id, start_frame, end_frame, features`` of all pooled vectors below ``folder``. Files whose name contains
    ``model`` are no segments; names without two numbers at the end are left out, see ``unread_files``."""
    return _read(spark, folder, "features", pa.float32(), "float")


def read_units(spark: SparkSession, folder: str) -> DataFrame:
    """``utt_id, start_frame, end_frame, units``: as ``read_pooled``, for unit sequences of any length."""
    return _read(spark, folder, "units", pa.int32(), "int")


def unread_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` of the files that the readers leave out for their name."""
    return segment_keys(_files(spark, folder).select("path", "name")).where("utt_id is null").select("path")


def write_segments(segments: DataFrame, folder: str, x: str = "features") -> int:
    """Write each row ``utt_id, start_frame, end_frame, x`` to a file of its own, and return how many were written.

    Vectors (floats or doubles) become float32 and unit sequences int32 arrays. A file that is there already stays, and
    is not counted; of rows with the same key one is written. Rows with a null key or a null ``x`` are left out.
    """
    whole = dict(segments.dtypes)[x] in ("array<int>", "array<bigint>")
    rows = segments.select(*_KEYS, F.col(x).cast("array<int>" if whole else "array<float>").alias("x")).where(" and ".join(f"{c} is not null" for c in (*_KEYS, "x"))).dropDuplicates(list(_KEYS))

    def content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [f"{u}_{a}_{b}.npy" for u, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            data = [npy(np.array(v.as_py(), np.int32 if whole else np.float32)) for v in batch.column(3)]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(data, pa.binary())], names=["name", "content"])

    return write_files(rows.mapInArrow(content, "name string, content binary"), folder)


def npy(x: np.ndarray) -> bytes:
    data = io.BytesIO()
    np.save(data, x)
    return data.getvalue()


def write_files(files: DataFrame, folder: str) -> int:
    """Write each ``content`` (binary or string) to the file ``name`` of the folder, unless it is there; how many were
    written. Rows with a null are left out."""
    target = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(target)
        system.create_dir(base, recursive=True)
        for batch in batches:
            paths, done = [f"{base}/{n}" for n in batch.column(0).to_pylist()], 0
            for path, info, value in zip(paths, system.get_file_info(paths), batch.column(1)):
                if info.type == fs.FileType.NotFound:
                    with system.open_output_stream(path) as f:
                        f.write(value.as_py())
                    done += 1
            yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

    rows = files.select("name", F.col("content").cast("binary").alias("content")).where("name is not null and content is not null")
    return rows.mapInArrow(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def write_frames(frames: DataFrame, folder: str) -> int:
    """Write the vectors of each utterance ``utt_id, frame, x``, in order of frames, as one matrix ``<utterance>.npy`` of
    float32; an utterance is in one row while it is written. How many files were written."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("frame", F.col("x").cast("array<float>").alias("x")))), lambda r: r["x"])
    rows = frames.where("utt_id is not null and frame is not null and x is not null").groupBy("utt_id").agg(ordered.alias("m"))

    def content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [npy(np.array(m.as_py(), np.float32)) for m in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array([f"{u}.npy" for u in batch.column(0).to_pylist()]), pa.array(data, pa.binary())], names=["name", "content"])

    return write_files(rows.mapInArrow(content, "name string, content binary"), folder)
