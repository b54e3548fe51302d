import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.functions import arrays, special, timebase


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_seconds_to_frames_equals_numpy(spark):
    seconds = np.round(np.arange(0, 20, 0.001), 3)
    rows = spark.createDataFrame([(float(s),) for s in seconds], "s double").select("s", timebase.seconds_to_frames(F.col("s")).alias("f"), timebase.frames_to_seconds(timebase.seconds_to_frames(F.col("s"))).alias("back")).collect()
    want = np.floor(np.round(seconds / 20 * 1000, 1) + 0.5).astype(int)
    assert [r["f"] for r in rows] == want.tolist()
    assert [r["back"] for r in rows] == [round(int(f) * 20 / 1000, 2) for f in want]
    assert one(spark, timebase.seconds_to_frames(F.lit(0.309))) == 15
    assert one(spark, timebase.seconds_to_frames(F.lit(None).cast("double"))) is None


@pytest.mark.parametrize("units,want", [([3, 3, 7, 7, 7, 2], [3, 7, 2]), ([3, 7, 3, 3], [3, 7, 3]), ([], []), ([None, None, 1], [None, 1]), (None, None)])
def test_collapse(spark, units, want):
    row = spark.createDataFrame([(units,)], "u array<int>").select(arrays.collapse(F.col("u")).alias("c")).first()
    assert row["c"] == want


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(1.0), F.lit(2.0))
    assert one(spark, arrays.dot(a, b)) == 11.0
    assert one(spark, arrays.squared_distance(a, b)) == 8.0
    assert one(spark, arrays.l2_normalise(a)) == pytest.approx([0.6, 0.8])
    assert one(spark, arrays.l2_normalise(F.array(F.lit(0.0)))) == [0.0]
    assert one(spark, arrays.slice_units(F.array(*map(F.lit, range(5))), F.lit(1), F.lit(3))) == [1, 2]
    assert one(spark, arrays.slice_units(F.array(*map(F.lit, range(5))), F.lit(4), F.lit(2))) == []


def test_edit_similarity_with_wide_units(spark):
    rows = spark.createDataFrame([([1, 2, 500], [1, 500]), ([], [1]), ([], []), ([19000, 93, 94], [19000, 93, 94])], "a array<int>, b array<int>")
    got = [r["s"] for r in rows.select(arrays.edit_similarity(arrays.as_text(F.col("a")), arrays.as_text(F.col("b"))).alias("s")).collect()]
    assert got == [pytest.approx(2 / 3), 0.0, None, 1.0]


def test_lgamma_and_densities(spark):
    xs = [1e-3, 0.05, 0.5, 1.0, 2.5, 10.0, 171.0, 5000.0]
    got = [r["g"] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(special.lgamma(F.col("x")).alias("g")).collect()]
    assert got == pytest.approx([math.lgamma(x) for x in xs], rel=1e-12, abs=1e-12)
    assert one(spark, special.log_normal(F.lit(1.0), F.lit(0.0), F.lit(4.0))) == pytest.approx(-0.5 * math.log(8 * math.pi) - 1 / 8)
    t = math.lgamma(2) - math.lgamma(1.5) - 0.5 * (math.log(3) + math.log(math.pi) + math.log(2)) - 2 * math.log(1 + 1 / 6)
    assert one(spark, special.log_student_t(F.lit(1.0), F.lit(0.0), F.lit(2.0), F.lit(3.0))) == pytest.approx(t)
