from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from murmuration.llm import terms

PAIRS = "field string, scope int, term string, record string, row_id bigint"


def brute(rows):
    occ, rec = defaultdict(set), defaultdict(set)
    for f, s, t, r, i in rows:
        if t is not None and r is not None:
            occ[f, s, t].add((r, i))
            rec[f, s, t].add(r)
    return {(k, len(v), len(rec[k])) for k, v in occ.items()}


def counted(df):
    return {((r["field"], r["scope"], r["term"]), r["n_rows"], r["n_records"]) for r in df.collect()}


def test_counts_equal_brute_force_with_a_hot_term_and_repeats(spark):
    rng = np.random.default_rng(0)
    rows = [("a", None, "hot", f"r{rng.integers(3)}", int(i)) for i in range(700)]  # a few records, many rows
    rows += [("a", None, "hot", f"q{i}", 1000 + i) for i in range(700)]
    rows += [("b", int(rng.integers(3)), f"t{rng.integers(40)}", f"r{rng.integers(20)}", 5000 + i) for i in range(1500)]
    rows += rows[::7]
    df = spark.createDataFrame(rows, PAIRS).repartition(7)
    assert counted(terms.term_counts(df)) == brute(rows)


def test_runs_go_on_over_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [("a", s, t, f"r{i // 4}", i) for s in (None, 1) for t in ("x", "y") for i in range(25)]
        assert counted(terms.term_counts(spark.createDataFrame(rows + rows, PAIRS))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_nulls_empty_extra_columns(spark):
    rows = [("a", None, None, "r", 1), ("a", None, "t", None, 2), (None, None, "t", "r", 3), ("a", 1, "", "r", None), ("a", 1, "t" * 100_000, "r", 4)]
    df = spark.createDataFrame(rows, PAIRS).withColumn("n_rows", F.lit(1)).withColumn("total", F.lit("x"))
    assert counted(terms.term_counts(df)) == brute(rows)
    assert terms.marked_terms(df.limit(0)).count() == 0


def test_marks(spark):
    rows = [("a", 1, "often", f"r{i}", i) for i in range(8)] + [("a", 1, "twice", f"r{i}", 10 + i) for i in range(2)] + [("a", 2, "both", "r0", 20)]
    found = {r["term"]: (r["rare"], r["common"], r["total"]) for r in terms.marked_terms(spark.createDataFrame(rows, PAIRS)).collect()}
    assert found == {"often": (False, True, 8), "twice": (True, False, 8), "both": (True, True, 1)}  # 2 of 8 is not more than 25 %


def test_label_and_cluster_pairs(spark):
    grid = spark.createDataFrame([(1, "u", "words", " Cat 12\t"), (2, "u", "words", " SIL "), (3, "u", "words", "123"), (4, "u", "phones", "a"), (5, None, "words", "b"), (6, "u", "words", None), (7, "u", None, "c")], "token_id bigint, utt_id string, tier string, label string")
    assert [(r["term"], r["row_id"]) for r in terms.label_pairs(grid).collect()] == [("cat ", 1)]
    part = spark.createDataFrame([(1, 2, 17, "u"), (2, 2, -1, "u"), (3, 2, None, "u"), (4, 2, 3, None), (5, None, 3, "u")], "member_id bigint, run_id int, cluster int, utt_id string")
    assert [(r["scope"], r["term"]) for r in terms.cluster_pairs(part).collect()] == [(2, "2:17")]
