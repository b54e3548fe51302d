"""Runs of equal consecutive units: start positions in sorted arrays, found again by binary search.

Sequences come as arrays, one a row; ``event_runs`` takes events as rows. A batch of rows is one chunk: its elements lie in one flat array. The
positions at which a run starts are gathered, in order; a boundary of a sequence always starts one, so no run
crosses it. Each element's run is found by binary search among the starts, and counts and durations are
aggregated by run. There is no shuffle, and a long sequence costs no more than its elements.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..arrowtools import changes, flat_list
from ..session import write_table

#: Most rows of a codebook that are sent to all tasks: 16 MB. A larger one is joined instead.
MAX_CODEBOOK = 1_000_000
_SCHEMA = pa.schema([("seg_id", pa.int64()), ("run_start", pa.int32()), ("base_unit", pa.int32()), ("run_length", pa.int32())])


def runs_of(seg_id: np.ndarray, starts: np.ndarray, lengths: np.ndarray, units: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """Owner, start position, unit and length of every run of valid equal neighbours in the lists."""
    total = int(lengths.sum())
    owner = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    pos = np.arange(total) - first[owner]
    at = starts[owner] + pos
    unit, ok = units[at], valid[at]
    new = np.ones(total, bool)
    new[1:] = (owner[1:] != owner[:-1]) | (unit[1:] != unit[:-1]) | (ok[1:] != ok[:-1])
    begins = np.flatnonzero(new)
    run = np.searchsorted(begins, np.arange(total), side="right") - 1  # the run of each element
    length = np.bincount(run, minlength=len(begins))
    keep = ok[begins]
    begins, length = begins[keep], length[keep]
    return seg_id[owner[begins]], pos[begins], unit[begins], length


def sequence_runs(sequences: DataFrame, codebook: DataFrame | None = None, min_length: int = 1, frame_sec: float = 0.02) -> DataFrame:
    """All runs of at least ``min_length`` equal neighbours.

    ``sequences`` has ``seg_id bigint, quantised array<int>``; other columns are not read. ``codebook`` has
    ``unit, base_unit``; a unit is replaced by its base unit, and one that the codebook lacks (or gives a null
    base) stands for itself; if it has several base units, the smallest. Null and negative elements are missing
    frames: they belong to no run and end the one before. Null and empty sequences give no row, nor do rows with a
    null ``seg_id``. Repeated rows count once. The result is ``seg_id, run_start, base_unit, run_length`` (int)
    and ``duration_sec``.
    """
    rows = sequences.select(F.col("seg_id").cast("bigint").alias("seg_id"), F.col("quantised").cast("array<int>").alias("quantised")).where("seg_id is not null and size(quantised) > 0")
    units: dict[int, int] = {}
    if codebook is not None:
        book = codebook.where("unit >= 0 and base_unit is not null").groupBy(F.col("unit").cast("int").alias("unit")).agg(F.min("base_unit").cast("int").alias("base_unit"))
        head = book.limit(MAX_CODEBOOK + 1).toArrow()
        if head.num_rows <= MAX_CODEBOOK:
            units = dict(zip(head["unit"].to_pylist(), head["base_unit"].to_pylist()))
        else:
            rows = _map_by_join(rows, book)
    known = np.array(sorted(units), np.int64)
    bases = np.array([units[u] for u in known.tolist()], np.int64)
    shared = sequences.sparkSession.sparkContext.broadcast((known, bases))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bases = shared.value
        for batch in batches:
            starts, lengths, values = flat_list(batch.column(1))
            present = ~values.is_null().to_numpy(zero_copy_only=False)
            raw = values.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            unit = raw
            if len(known):
                at = np.minimum(np.searchsorted(known, raw), len(known) - 1)
                unit = np.where(known[at] == raw, bases[at], raw)
            seg, pos, unit, length = runs_of(batch.column(0).to_numpy(), starts, lengths, unit, present & (raw >= 0))
            keep = length >= min_length
            yield pa.RecordBatch.from_arrays([pa.array(x[keep].astype(t.to_pandas_dtype())) for x, t in zip((seg, pos, unit, length), _SCHEMA.types)], schema=_SCHEMA)

    found = rows.mapInArrow(scan, "seg_id bigint, run_start int, base_unit int, run_length int")
    return found.dropDuplicates(["seg_id", "run_start"]).withColumn("duration_sec", F.col("run_length") * F.lit(frame_sec))


def event_runs(events: DataFrame) -> DataFrame:
    """All runs of equal consecutive events of an entity, where events are rows.

    ``events`` has ``entity string, time double, event string`` and ``id bigint``, which orders events at one time; other
    columns are not read. Rows that repeat all four count once. A null event is an event like others, equal to a null; rows
    with a null entity, time or id are left out. The result is ``entity, start_time, end_time, event, n``: the times of a
    run's first and last event, and its count; its duration is the difference of the times.

    Rows are range-partitioned and sorted by entity, time and id, so an entity that holds a third of all rows is spread over
    many tasks. A task gathers the places where a run starts in a sorted array and finds each event's run in it by binary
    search. Runs that touch an edge of a partition are put together by one row a partition.
    """
    order = ["entity", "time", "id"]
    rows = events.select(F.col("entity").cast("string").alias("entity"), F.col("time").cast("double").alias("time"), F.col("id").cast("bigint").alias("id"), F.col("event").cast("string").alias("event")).where("entity is not null and time is not null and id is not null").distinct()
    names = ["pid", "at", "entity", "start_time", "end_time", "event", "n"]
    schema = pa.schema([("pid", pa.int32()), ("at", pa.int64()), ("entity", pa.string()), ("start_time", pa.float64()), ("end_time", pa.float64()), ("event", pa.string()), ("n", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            entity, event, time = batch.column(0), batch.column(3), batch.column(1)
            new = changes([entity, event])
            begins = np.flatnonzero(new)
            run = np.searchsorted(begins, np.arange(batch.num_rows), side="right") - 1
            n = np.bincount(run, minlength=len(begins))
            first, last = pa.array(begins), pa.array(begins + n - 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), batch.column(4)[0].as_py(), np.int32)), pa.array(done + begins), entity.take(first), time.take(first), time.take(last), event.take(first), pa.array(n)], schema=schema)
            done += batch.num_rows

    # Written once: runs and what joins them must see the same partitions.
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, "event", F.spark_partition_id().alias("pid"))
    local = write_table(ordered.mapInArrow(scan, ", ".join(f"{f} {t}" for f, t in zip(names, ("int", "bigint", "string", "double", "double", "string", "bigint")))), "runs").df
    # A batch or a partition may end within a run: pieces that follow one another and are equal get one number.
    inside = Window.partitionBy("pid").orderBy("at")
    edge = (F.lag("entity").over(inside).eqNullSafe(F.col("entity"))) & (F.lag("event").over(inside).eqNullSafe(F.col("event")))
    numbered = local.withColumn("starts", F.when(edge, 0).otherwise(1)).withColumn("run", F.sum("starts").over(inside))
    whole = numbered.groupBy("pid", "run").agg(F.first("entity").alias("entity"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.first("event").alias("event"), F.sum("n").alias("n"))
    pieces = write_table(whole, "run-pieces").df
    ends = pieces.groupBy("pid").agg(F.min_by(F.struct("entity", "event"), "run").alias("head"), F.max_by(F.struct("entity", "event"), "run").alias("tail"), F.max("run").alias("runs"))
    across = Window.orderBy("pid")  # one row a partition
    goes_on = F.lag("tail").over(across).eqNullSafe(F.col("head"))
    # A partition's first run goes on from the one before; through partitions of a single run, from further back.
    chains = ends.withColumn("on", F.coalesce(goes_on, F.lit(False))).withColumn("previous", F.lag("pid").over(across)).withColumn("opens", F.when(F.col("on") & (F.lag("runs").over(across) == 1), 0).otherwise(1)).withColumn("chain", F.sum("opens").over(across))
    first = chains.groupBy("chain").agg(F.min_by(F.when(F.col("on"), F.col("previous")).otherwise(F.col("pid")), "pid").alias("home"))
    homes = chains.join(first, "chain").select("pid", "on", "home")
    placed = pieces.join(F.broadcast(homes), "pid")
    owner = F.when((F.col("run") == 1) & F.col("on"), F.col("home")).otherwise(F.col("pid"))
    totals = ends.select(F.col("pid").alias("owner"), "runs")
    keyed = placed.withColumn("owner", owner).join(F.broadcast(totals), "owner").withColumn("key", F.when((F.col("run") == 1) & F.col("on"), F.col("runs")).otherwise(F.col("run")))
    out = keyed.groupBy("owner", "key").agg(F.first("entity").alias("entity"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.first("event").alias("event"), F.sum("n").alias("n"))
    return out.select("entity", "start_time", "end_time", "event", "n")


def _map_by_join(rows: DataFrame, book: DataFrame) -> DataFrame:
    """The sequences in base units where the codebook is too large to send: exploded, joined, put together."""
    items = rows.dropDuplicates(["seg_id"]).select("seg_id", F.posexplode("quantised").alias("pos", "unit"))
    mapped = items.join(book, "unit", "left").select("seg_id", "pos", F.coalesce("base_unit", "unit").alias("unit"))
    return mapped.groupBy("seg_id").agg(F.expr("transform(array_sort(collect_list(struct(pos, unit))), x -> x.unit)").alias("quantised"))


def collapsed(sequences: DataFrame, codebook: DataFrame | None = None) -> DataFrame:
    """``seg_id, units, counts, durations``: each sequence with every run as one unit, its count and duration.

    As in ``sequence_runs``; a sequence without any run, such as an empty one, gives no row.
    """
    runs = sequence_runs(sequences, codebook)
    rows = F.array_sort(F.collect_list(F.struct("run_start", "base_unit", "run_length", "duration_sec")))
    return runs.groupBy("seg_id").agg(rows.alias("r")).select("seg_id", F.col("r.base_unit").alias("units"), F.col("r.run_length").alias("counts"), F.col("r.duration_sec").alias("durations"))
