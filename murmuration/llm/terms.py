"""Frequency of every distinct term: one range-partitioned sort and a run-length scan.

Rows ``(field, scope, term, record, row id)`` are range-partitioned and sorted on all five columns, so that a hot
term, and even a hot pair of term and record, is spread over many tasks and sorted externally. One pass over each
sorted partition counts, for every term, rows and records by comparing neighbours. Repeated rows have the same
key and lie side by side, so the scan drops them without a shuffle of their own. What leaves a partition is one
row a term: counts, and the first and last record, since only these can go on in another partition. Counts
therefore add up exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..arrowtools import changes

# Labels that mark silence.
SILENCE = ("", "<unk>", "sp", "sil", "spn")
KEYS = ("field", "scope", "term")
_PARTIAL = "field string, scope int, term string, n_rows bigint, n_inner bigint, first_record string, last_record string"
_SCHEMA = pa.schema([("field", pa.string()), ("scope", pa.int32()), ("term", pa.string()), ("n_rows", pa.int64()), ("n_inner", pa.int64()), ("first_record", pa.string()), ("last_record", pa.string())])


def cleaned_label(label: Column) -> Column:
    """``label`` without spaces, tabs and no-break spaces at both ends, in lower case; null stays null."""
    return F.lower(F.btrim(label, F.lit(" \t\u00a0")))


def is_silence(cleaned: Column) -> Column:
    """Whether a cleaned label marks silence."""
    return cleaned.isin(*SILENCE)


def scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of each term of one sorted partition. The open run at a batch's end goes on in the next."""
    held: dict | None = None  # the last term so far: its counts, its first and last record, its last row
    for batch in batches:
        if not batch.num_rows:
            continue
        field, scope, term, record, row = (batch.column(i) for i in range(5))
        new_term = changes([field, scope, term])
        new_record = new_term | changes([record])
        new_row = new_record | changes([row])
        starts = np.flatnonzero(new_term)
        ends = np.append(starts[1:], batch.num_rows) - 1
        rows = np.add.reduceat(new_row.astype(np.int64), starts)
        records = np.add.reduceat(new_record.astype(np.int64), starts)
        key = [c.take(pa.array(starts)).to_pylist() for c in (field, scope, term)]
        first, last = record.take(pa.array(starts)).to_pylist(), record.take(pa.array(ends)).to_pylist()
        last_row = row[batch.num_rows - 1].as_py()
        done: list[dict] = []
        now = [{"key": k, "rows": int(n), "records": int(m), "first": a, "last": b} for *k, n, m, a, b in zip(*key, rows, records, first, last)]
        if held is not None:
            if held["key"] == now[0]["key"]:
                again = held["last"] == now[0]["first"]
                now[0]["rows"] += held["rows"] - (again and held["row"] == row[0].as_py())
                now[0]["records"] += held["records"] - again
                now[0]["first"] = held["first"]
            else:
                done.append(held)
        held = now.pop() | {"row": last_row}
        if done := done + now:
            yield _partial(done)
    if held is not None:
        yield _partial([held])


def _partial(runs: list[dict]) -> pa.RecordBatch:
    inner = [r["records"] - (1 if r["records"] == 1 else 2) for r in runs]
    columns = [*zip(*(r["key"] for r in runs)), [r["rows"] for r in runs], inner, [r["first"] for r in runs], [r["last"] for r in runs]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCHEMA.types)], schema=_SCHEMA)


def term_counts(pairs: DataFrame) -> DataFrame:
    """Occurrences and records of every term.

    ``pairs`` has ``field string, scope int, term string, record string, row_id bigint`` and may have more
    columns, which are not read. Rows that are equal in these five columns count once; a row whose term or record
    is null is left out; a null scope is a scope of its own. The result has one row a (field, scope, term):
    ``n_rows`` and ``n_records``. An empty input gives an empty result. Terms are compared as they are.
    """
    rows = pairs.select(F.col("field").cast("string").alias("field"), F.col("scope").cast("int").alias("scope"), F.col("term").cast("string").alias("term"), F.col("record").cast("string").alias("record"), F.col("row_id").cast("bigint").alias("row_id")).where("term is not null and record is not null")
    order = [*KEYS, "record", "row_id"]
    partial = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(scan_runs, _PARTIAL)
    # Records at the edges of partitions: at most two a partition and term.
    edges = F.size(F.array_distinct(F.flatten(F.collect_list(F.array("first_record", "last_record")))))
    return partial.groupBy(*KEYS).agg(F.sum("n_rows").alias("n_rows"), (F.sum("n_inner") + edges).cast("bigint").alias("n_records"))


def record_totals(pairs: DataFrame) -> DataFrame:
    """``total``: the number of different records with at least one term, for each field and scope."""
    return pairs.where("term is not null and record is not null").select("field", "scope", "record").distinct().groupBy("field", "scope").agg(F.count("*").alias("total"))


def marked_terms(pairs: DataFrame, rare_records: int = 2, common_share: float = 0.25) -> DataFrame:
    """``term_counts`` with ``total`` and the flags ``rare`` (in at most ``rare_records`` records) and ``common``
    (in more than ``common_share`` of the records of its field and scope). A term may have both flags."""
    counts, totals = term_counts(pairs), record_totals(pairs)
    joined = counts.alias("c").join(totals.alias("t"), F.expr("c.field = t.field and c.scope <=> t.scope"))
    return joined.select(*(F.col(f"c.{k}") for k in (*KEYS, "n_rows", "n_records")), F.col("t.total"), (F.col("n_records") <= rare_records).alias("rare"), (F.col("n_records") > common_share * F.col("total")).alias("common"))


def label_pairs(textgrid: DataFrame) -> DataFrame:
    """Pairs of the field ``label``: gold words with digits 0-9 deleted. Rows with a null label or utterance,
    silence marks and terms that become empty are left out."""
    clean = cleaned_label(F.col("label"))
    term = F.regexp_replace(clean, "[0-9]", "")
    return textgrid.where((F.col("tier") == "words") & F.col("label").isNotNull() & F.col("utt_id").isNotNull() & ~is_silence(clean) & (term != "")).select(F.lit("label").alias("field"), F.lit(None).cast("int").alias("scope"), term.alias("term"), F.col("utt_id").alias("record"), F.col("token_id").alias("row_id"))


def cluster_pairs(partition_file: DataFrame) -> DataFrame:
    """Pairs of the field ``cluster``: ``run:cluster``. The scope is the run, since clusters start anew in each."""
    term = F.concat(F.col("run_id").cast("string"), F.lit(":"), F.col("cluster").cast("string"))
    return partition_file.where("cluster >= 0 and utt_id is not null and run_id is not null").select(F.lit("cluster").alias("field"), F.col("run_id").cast("int").alias("scope"), term.alias("term"), F.col("utt_id").alias("record"), F.col("member_id").alias("row_id"))
