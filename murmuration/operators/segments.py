"""From frames and boundary times to segments: intervals, pooled vectors, unit sequences, centring."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays
from ..functions.timebase import seconds_to_frames
from ..session import write_table
from .numbering import number_rows

#: Boundaries of one utterance that one task scans; a longer list is cut, and the pieces are joined by their totals.
CHUNK = 10_000


def boundary_frames(boundaries: DataFrame) -> DataFrame:
    """``utt_id, pos, end`` in frames from ``utt_id, pos, end_sec``. Repeated rows count once; rows with a null in
    one of the three, or a time that is not finite, are left out."""
    rows = boundaries.select("utt_id", F.col("pos").cast("bigint").alias("pos"), F.col("end_sec").cast("double").alias("end_sec"))
    return rows.where("utt_id is not null and pos is not null and not isnan(end_sec) and abs(end_sec) < double('Infinity')").select("utt_id", "pos", seconds_to_frames(F.col("end_sec")).alias("end")).dropDuplicates(["utt_id", "pos"])


def _before(rows: DataFrame, highest: bool) -> DataFrame:
    """``rows`` with ``prior``: of the rows of the same utterance before this one, the highest ``end``, or the last.

    An utterance with very many rows is spread over tasks: each piece of ``CHUNK`` positions is scanned alone, and
    what precedes a piece comes from one row for each piece.
    """
    piece = rows.withColumn("piece", F.floor(F.col("pos") / F.lit(CHUNK)))
    inside = Window.partitionBy("utt_id", "piece").orderBy("pos")
    ahead = inside.rowsBetween(Window.unboundedPreceding, -1)
    own = F.max("end").over(ahead) if highest else F.lag("end").over(inside)
    totals = piece.groupBy("utt_id", "piece").agg((F.max("end") if highest else F.max_by("end", "pos")).alias("total"))
    across = Window.partitionBy("utt_id").orderBy("piece")
    earlier = F.max("total").over(across.rowsBetween(Window.unboundedPreceding, -1)) if highest else F.lag("total").over(across)
    carried = totals.select("utt_id", "piece", earlier.alias("earlier"))
    with_own = piece.withColumn("own", own).join(carried, ["utt_id", "piece"])
    prior = F.greatest("own", "earlier") if highest else F.coalesce("own", "earlier")
    return with_own.select("utt_id", "pos", "end", prior.alias("prior"))


def pooling_intervals(boundaries: DataFrame, utterances: DataFrame) -> DataFrame:
    """``utt_id, start_frame, end_frame`` for pooling.

    ``boundaries``: ``utt_id, pos, end_sec``; ``utterances``: ``utt_id, n_frames``. A segment begins where the last
    kept one ended, so at the highest end so far and never before 0. An end that is not after the start, or a
    start past the last frame, gives no segment and does not move the start. The end in the result is not
    clipped. An utterance without any boundary is one segment from 0 to ``n_frames``. Each segment appears once.
    """
    known = utterances.where("n_frames > 0").select("utt_id", F.col("n_frames").cast("int").alias("n_frames"))
    starts = _before(boundary_frames(boundaries), True).select("utt_id", F.greatest(F.coalesce("prior", F.lit(0)), F.lit(0)).alias("start_frame"), F.col("end").alias("end_frame"))
    cut = starts.join(known, "utt_id").where("end_frame > start_frame and start_frame < n_frames").select("utt_id", "start_frame", "end_frame")
    whole = known.join(boundaries.select("utt_id").distinct(), "utt_id", "left_anti").select("utt_id", F.lit(0).alias("start_frame"), F.col("n_frames").alias("end_frame"))
    return cut.unionByName(whole).dropDuplicates(["utt_id", "start_frame", "end_frame"])


def quantising_intervals(boundaries: DataFrame) -> DataFrame:
    """``utt_id, start_frame, end_frame`` for unit sequences: each end after the one before, which may also lie
    after it; equal ones give no segment. Each segment appears once. Utterances without a boundary give none."""
    rows = _before(boundary_frames(boundaries), False).select("utt_id", F.coalesce("prior", F.lit(0)).alias("start_frame"), F.col("end").alias("end_frame"))
    return rows.where("end_frame <> start_frame").dropDuplicates(["utt_id", "start_frame", "end_frame"])


def new_segments(segments: DataFrame, existing: DataFrame) -> DataFrame:
    """The segments that a sink does not have yet, by utterance, start and end."""
    return segments.join(existing, ["utt_id", "start_frame", "end_frame"], "left_anti")


def mean_vector(rows: DataFrame, keys: list[str], x: str, out: str) -> DataFrame:
    """Mean of the vectors ``x`` of each key, combined before the shuffle, without one row a dimension."""
    return rows.groupBy(*keys).agg(vector_to_array(Summarizer.mean(array_to_vector(arrays.doubles(F.col(x))))).alias(out))


def mean_pool(frames: DataFrame, intervals: DataFrame, dim: int | None = None) -> DataFrame:
    """``utt_id, start_frame, end_frame, x`` (array of float): the mean of the frames in each interval.

    ``frames``: ``utt_id, frame, x``. Frames with a null, or, if ``dim`` is given, of another length, are left out.
    An interval without a frame gives no row. Intervals are taken apart into frame numbers, so the join is on
    utterance and frame: a long utterance is spread over all tasks, and no frame meets an interval that it is not
    in. The last frame of an interval is bounded by the utterance's.
    """
    good = frames.where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull()) & ((F.size("x") == dim) if dim else (F.size("x") > 0)))
    n = good.groupBy("utt_id").agg(F.max("frame").alias("last"))
    numbers = intervals.join(n, "utt_id").where("start_frame <= last and end_frame > start_frame").select("utt_id", "start_frame", "end_frame", F.explode(F.sequence("start_frame", F.least(F.col("end_frame") - 1, "last"))).alias("frame"))
    keys = ["utt_id", "start_frame", "end_frame"]
    pooled = mean_vector(numbers.join(good.select("utt_id", "frame", "x"), ["utt_id", "frame"]), keys, "x", "m")
    return pooled.select(*keys, F.col("m").cast("array<float>").alias("x"))


def unit_sequences(frame_units: DataFrame, intervals: DataFrame, collapsed: bool = False) -> DataFrame:
    """``utt_id, start_frame, end_frame, units``: the units of each interval in order of frames; an interval
    without a frame is an empty sequence. With ``collapsed``, consecutive equal units become one.

    ``frame_units``: ``utt_id, frame, unit``. Only utterances that have frames give rows."""
    n = frame_units.groupBy("utt_id").agg(F.max("frame").alias("last"))
    begin = F.greatest("start_frame", F.lit(0))
    stop = F.least(F.col("end_frame") - 1, "last")
    known = intervals.join(n, "utt_id")
    numbers = known.select("utt_id", "start_frame", "end_frame", F.explode_outer(F.when(stop >= begin, F.sequence(begin, stop))).alias("frame"))
    keys = ["utt_id", "start_frame", "end_frame"]
    rows = numbers.join(frame_units.select("utt_id", "frame", "unit"), ["utt_id", "frame"], "left")
    units = F.transform(F.array_sort(F.collect_list(F.when(F.col("unit").isNotNull(), F.struct("frame", "unit")))), lambda s: s["unit"])
    out = rows.groupBy(*keys).agg(units.alias("units"))
    return out.select(*keys, (arrays.collapse(F.col("units")) if collapsed else F.col("units")).alias("units"))


def numbered(segments: DataFrame, out: str = "seg_id") -> DataFrame:
    """``segments`` with the position of each in the order of utterance, start and end, from 0: the vertex number."""
    return number_rows(segments, ["utt_id", "start_frame", "end_frame"], out)


def has_valid_vector(x: str, dim: int) -> Column:
    """Whether a vector has ``dim`` elements, all non-null and finite; false for a null."""
    v = F.col(x)
    return v.isNotNull() & (F.size(v) == dim) & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))


def valid_vectors(segments: DataFrame, dim: int, x: str = "features", id_col: str = "seg_id", keep: list[str] | None = None) -> DataFrame:
    """``seg_id, *keep, x`` of segments whose vector has ``dim`` elements, all non-null and finite, one row an id."""
    good = segments.where(F.col(id_col).isNotNull() & has_valid_vector(x, dim)).dropDuplicates([id_col])
    return good.select(F.col(id_col).cast("bigint").alias("seg_id"), *(keep or []), F.col(x).alias("x"))


def rejected_vectors(segments: DataFrame, dim: int, x: str = "features", id_col: str = "seg_id") -> DataFrame:
    """``reason, n``: how many rows ``valid_vectors`` leaves out, by the first reason that holds: ``null_id``,
    ``null_vector``, ``length``, ``not_finite`` (null elements included), ``repeated``. Reasons without a row are left out."""
    v = F.col(x)
    reason = F.when(F.col(id_col).isNull(), "null_id").when(v.isNull(), "null_vector").when(F.size(v) != dim, "length").when(~has_valid_vector(x, dim), "not_finite")
    marked = segments.select(F.col(id_col).alias("id"), reason.alias("reason")).groupBy("id", "reason").agg(F.count("*").alias("n"))
    rest = F.when(F.col("reason").isNull() & (F.col("n") > 1), F.struct(F.lit("repeated").alias("reason"), (F.col("n") - 1).alias("n")))
    first = F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))
    return marked.select(F.coalesce(first, rest).alias("r")).where("r is not null").groupBy("r.reason").agg(F.sum("r.n").alias("n"))


def centred_unit(vectors: DataFrame) -> DataFrame:
    """``seg_id, x``: vectors less their mean, divided by their length plus 1e-10. The mean is one row, so it is sent
    to all tasks."""
    mean = vectors.agg(vector_to_array(Summarizer.mean(array_to_vector(arrays.doubles(F.col("x"))))).alias("mu"))
    return vectors.crossJoin(F.broadcast(mean)).select("seg_id", arrays.subtract(F.col("x"), F.col("mu")).alias("c")).select("seg_id", arrays.l2_normalise(F.col("c")).alias("x"))


def moments(vectors: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``n, mean, var`` (population) per dimension of ``x``, for each key if any; one combined aggregation."""
    v = array_to_vector(arrays.doubles(F.col("x")))
    s = Summarizer.metrics("count", "mean", "variance").summary(v).alias("s")
    grouped = vectors.groupBy(*(keys or [])).agg(s)
    n = F.col("s.count").cast("double")
    var = F.transform(vector_to_array(F.col("s.variance")), lambda u: u * (n - 1) / n)
    return grouped.select(*(keys or []), F.col("s.count").alias("n"), vector_to_array(F.col("s.mean")).alias("mean"), var.alias("var"))


def standardised(frames: DataFrame, stats: DataFrame, keep: list[str]) -> DataFrame:
    """``keep, x``: vectors less the mean, divided by the population deviation; a dimension without variance is 0.
    ``stats`` is the one row of ``moments``."""
    z = F.zip_with(arrays.subtract(F.col("x"), F.col("mean")), F.col("var"), lambda d, v: F.when(v > 0, d / F.sqrt(v)).otherwise(F.lit(0.0)))
    return frames.crossJoin(F.broadcast(stats)).select(*keep, z.alias("x"))


def bounded_prefix(utterances: DataFrame, hours: float = 2.0, frames_per_second: int = 50) -> DataFrame:
    """The utterances ``utt_id, n_frames``, in order of name, as long as the frames of those before are fewer than
    the hours hold: the one that crosses the bound is taken whole.

    Ranges of names are summed first, so only one row for each of some hundred ranges is in one task.
    """
    cap = hours * 3600 * frames_per_second
    ordered = utterances.select("utt_id", "n_frames").repartitionByRange("utt_id").withColumn("pid", F.spark_partition_id())
    table = write_table(ordered, "prefix").df
    totals = table.groupBy("pid").agg(F.sum("n_frames").alias("n"))
    offsets = totals.select("pid", F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    inside = F.coalesce(F.sum("n_frames").over(Window.partitionBy("pid").orderBy("utt_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return table.withColumn("inside", inside).join(F.broadcast(offsets), "pid").where(F.col("inside") + F.col("offset") < cap).select("utt_id", "n_frames")


def hash_sample(rows: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows (or all, if fewer) in an order that a hash of the id and the seed gives: the same in every run."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), F.col(id_col)).limit(n)


def batch_ranges(n: int, size: int) -> list[tuple[int, int]]:
    """Ranges of at most ``size`` numbers that make up 0 to ``n``."""
    return [(i, min(i + size, n)) for i in range(0, n, size)]
