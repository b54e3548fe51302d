import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.operators import segments


def bounds(spark, rows):
    return spark.createDataFrame(rows, "utt_id string, pos int, end_sec double")


def fold(ends, n):
    """Both flavours, by a plain loop."""
    pool, start = [], 0
    for e in ends:
        if e > start and start < n:
            pool.append((start, e))
            start = e
    quant, start = [], 0
    for e in ends:
        if e != start:
            quant.append((start, e))
        start = e
    return set(pool), set(quant)


@pytest.mark.parametrize("chunk", [10_000, 3])
def test_intervals_equal_a_fold(spark, monkeypatch, chunk):
    monkeypatch.setattr(segments, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    cases = {f"u{i}": rng.integers(0, 40, rng.integers(1, 25)).tolist() for i in range(60)}
    cases |= {"zero": [3, 3, 7, 10], "back": [5, 3, 8], "over": [5, 14, 16]}
    n = {u: int(rng.integers(5, 50)) for u in cases} | {"zero": 10, "back": 10, "over": 10, "none": 9, "empty": 0}
    rows = [(u, p, e * 0.02) for u, es in cases.items() for p, e in enumerate(es)]
    rows += rows[::5] + [("u1", 99, None), (None, 0, 1.0), ("u1", None, 1.0), ("u1", 98, float("nan"))]
    utts = spark.createDataFrame(list(n.items()), "utt_id string, n_frames int")
    got = {}
    for r in segments.pooling_intervals(bounds(spark, rows), utts).collect():
        got.setdefault(r["utt_id"], []).append((r["start_frame"], r["end_frame"]))
    want = {u: fold(es, n[u])[0] for u, es in cases.items()} | {"none": {(0, 9)}}
    assert {u: set(v) for u, v in got.items()} == {u: v for u, v in want.items() if v}
    assert all(len(v) == len(set(v)) for v in got.values())
    cut = {}
    for r in segments.quantising_intervals(bounds(spark, rows)).collect():
        cut.setdefault(r["utt_id"], set()).add((r["start_frame"], r["end_frame"]))
    assert cut == {u: fold(es, n[u])[1] for u, es in cases.items() if fold(es, n[u])[1]}


def test_mean_pool(spark):
    frames = spark.createDataFrame([("a", i, [float(i), 1.0]) for i in range(10)] + [("b", 0, None), ("b", 1, [2.0, 4.0]), ("b", 2, [None, 1.0])], "utt_id string, frame int, x array<float>")
    cuts = spark.createDataFrame([("a", 0, 3), ("a", 5, 14), ("a", 20, 25), ("b", 0, 3), ("c", 0, 2)], "utt_id string, start_frame int, end_frame int")
    got = {(r["utt_id"], r["start_frame"], r["end_frame"]): r["x"] for r in segments.mean_pool(frames, cuts).collect()}
    assert got == {("a", 0, 3): [1.0, 1.0], ("a", 5, 14): [7.0, 1.0], ("b", 0, 3): [2.0, 4.0]}


def test_unit_sequences(spark):
    units = spark.createDataFrame([("a", i, u) for i, u in enumerate([4, 4, 5, 5, 4])], "utt_id string, frame int, unit int")
    cuts = spark.createDataFrame([("a", 0, 4), ("a", 4, 2), ("a", 3, 9), ("z", 0, 4)], "utt_id string, start_frame int, end_frame int")
    whole = {(r["start_frame"], r["end_frame"]): r["units"] for r in segments.unit_sequences(units, cuts).collect()}
    assert whole == {(0, 4): [4, 4, 5, 5], (4, 2): [], (3, 9): [5, 4]}
    short = {(r["start_frame"], r["end_frame"]): r["units"] for r in segments.unit_sequences(units, cuts, True).collect()}
    assert short == {(0, 4): [4, 5], (4, 2): [], (3, 9): [5, 4]}


def test_numbering_and_prefix(spark):
    rng = np.random.default_rng(0)
    rows = sorted({(f"u{rng.integers(30):02d}", int(rng.integers(50)), int(rng.integers(50, 99))) for _ in range(300)})
    got = segments.numbered(spark.createDataFrame(rows, "utt_id string, start_frame int, end_frame int").repartition(5)).collect()
    assert sorted((r["seg_id"], r["utt_id"], r["start_frame"], r["end_frame"]) for r in got) == [(i, *r) for i, r in enumerate(rows)]
    utts = [(f"u{i:02d}", 40 + i) for i in range(50)]
    kept = {r["utt_id"] for r in segments.bounded_prefix(spark.createDataFrame(utts, "utt_id string, n_frames int"), 1000 / 180_000).collect()}
    total, want = 0, set()
    for u, n in utts:
        if total < 1000:
            want.add(u)
        total += n
    assert kept == want


def test_centred_vectors_moments_and_standardising(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 5))
    x[:, 2] = 3.0
    bad = [(100, [1.0] * 4), (101, None), (102, [float("nan")] * 5), (103, [None] * 5), (None, [1.0] * 5)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] * 2 + bad, "seg_id bigint, features array<double>")
    valid = segments.valid_vectors(df, 5)
    c = x - x.mean(0)
    want = c / (np.linalg.norm(c, axis=1, keepdims=True) + 1e-10)
    got = {r["seg_id"]: r["x"] for r in segments.centred_unit(valid).collect()}
    assert sorted(got) == list(range(40)) and np.allclose([got[i] for i in range(40)], want)
    m = segments.moments(valid).first()
    assert m["n"] == 40 and np.allclose(m["mean"], x.mean(0)) and np.allclose(m["var"], x.var(0))
    z = {r["seg_id"]: r["x"] for r in segments.standardised(valid, segments.moments(valid), ["seg_id"]).collect()}
    sd = np.where(x.var(0) > 1e-12, x.std(0), 1)
    zw = (x - x.mean(0)) / sd
    assert np.allclose(np.delete([z[i] for i in range(40)], 2, 1), np.delete(zw, 2, 1))


def test_sample_is_stable(spark):
    a = [r["id"] for r in segments.hash_sample(spark.range(1000), "id", 30, 4).collect()]
    b = [r["id"] for r in segments.hash_sample(spark.range(1000).repartition(7), "id", 30, 4).collect()]
    assert a == b and len(set(a)) == 30
    assert segments.batch_ranges(10, 3) == [(0, 3), (3, 6), (6, 9), (9, 10)]
    assert segments.hash_sample(spark.range(5).withColumn("x", F.lit(1)), "id", 30).count() == 5
