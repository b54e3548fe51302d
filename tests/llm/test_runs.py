import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.llm import runs

ROWS = "seg_id bigint, quantised array<int>"


def brute(seqs, book, least):
    out = set()
    for s, q in seqs:
        if s is None or q is None:
            continue
        u = [None if v is None or v < 0 else book.get(v, v) for v in q]
        i = 0
        while i < len(u):
            j = i
            while j < len(u) and u[j] == u[i]:
                j += 1
            if u[i] is not None and j - i >= least:
                out.add((s, i, u[i], j - i))
            i = j
    return out


def rows(df):
    got = [(r["seg_id"], r["run_start"], r["base_unit"], r["run_length"]) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("least", [1, 3])
@pytest.mark.parametrize("join", [False, True])
def test_equals_brute_force(spark, least, join, monkeypatch):
    if join:
        monkeypatch.setattr(runs, "MAX_CODEBOOK", 2)
    rng = np.random.default_rng(least)
    seqs = [(i, [None if v == 7 else int(v) - 1 for v in rng.integers(0, 9, rng.integers(0, 30))]) for i in range(200)]
    seqs += [(500, None), (501, []), (None, [1, 1, 1]), (502, [4] * 50_000), (503, [None] * 5), (504, [2]), (505, [2])]
    book = {2: 1, 3: 1, 5: 4}
    seqs += seqs[::3]
    table = spark.createDataFrame(list(book.items()) + [(None, 3), (6, None), (2, 9)], "unit int, base_unit int")
    assert rows(runs.sequence_runs(spark.createDataFrame(seqs, ROWS).repartition(3), table, least)) == brute(seqs, book, least)


def test_durations_collapse_and_no_codebook(spark):
    df = spark.createDataFrame([(1, [3, 3, 7, 7, 7, 2, -1, 2]), (2, [])], ROWS)
    (r,) = runs.collapsed(df).collect()
    assert (r["units"], r["counts"]) == ([3, 7, 2, 2], [2, 3, 1, 1])
    assert np.allclose(r["durations"], [0.04, 0.06, 0.02, 0.02])


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([(1, [5, 5])], ROWS).withColumns({c: F.lit(9) for c in ("run_start", "base_unit", "unit", "pos")})
    empty = spark.createDataFrame([], "unit int, base_unit int")
    assert rows(runs.sequence_runs(df, empty)) == {(1, 0, 5, 2)}
    assert runs.sequence_runs(df.limit(0), empty).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_event_runs_equal_brute_force(spark, parts):
    rng = np.random.default_rng(parts)
    rows, i = [], 0
    for e, n in (("hot", 400), ("a", 30), ("b", 1), ("long", 200)):
        t = 0.0
        for _ in range(n):
            t += float(rng.integers(0, 3))
            event = "x" if e == "long" else [None, "x", "y"][int(rng.integers(3)) * int(rng.random() < 0.4)]
            rows.append((e, t, i, event))
            i += 1
    want, last = [], None
    for e, t, i, v in sorted(rows, key=lambda r: r[:3]):
        if last == (e, v):
            want[-1] = (*want[-1][:2], t, v, want[-1][4] + 1)
        else:
            want.append((e, t, t, v, 1))
        last = (e, v)
    bad = [(None, 1.0, 1, "x"), ("a", None, 2, "x"), ("a", 1.0, None, "x")]
    df = spark.createDataFrame(rows + rows[::3] + bad, "entity string, time double, id bigint, event string")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as many partitions as that, however small
    try:
        got = runs.event_runs(df.withColumns({c: F.lit("x") for c in ("pid", "at", "run", "n")})).collect()
        assert runs.event_runs(df.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
