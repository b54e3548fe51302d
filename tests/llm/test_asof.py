import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.llm.asof import match_nearest

ROWS = "entity string, time double, id bigint"


def brute(left, right, tol):
    out = set()
    for e, t, i in set(left):
        if e is None or t is None or i is None or not np.isfinite(t):
            continue
        near = sorted((abs(t - u), u, j) for f, u, j in set(right) if f == e and u is not None and j is not None and np.isfinite(u))
        if near and near[0][0] <= tol:
            out.add((i, near[0][2]))
    return out


def pairs(df):
    rows = [(r["left_id"], r["right_id"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("tolerance,width", [(0.1, 20.0), (0.5, 1.0), (3.0, 0.5), (0.0, 1.0)])
def test_equals_brute_force(spark, tolerance, width):
    rng = np.random.default_rng(int(tolerance * 10))
    # Times on a grid of 1/64, so that ties and edges of slices are exact; one entity has most rows.
    def rows(n, base):
        return [("hot" if rng.random() < 0.6 else f"e{rng.integers(4)}", float(rng.integers(-640, 3000)) / 64, base + i) for i in range(n)]

    left, right = rows(400, 0), rows(300, 1000)
    left, right = left + left[::5], right + right[::4]
    got = pairs(match_nearest(spark.createDataFrame(left, ROWS), spark.createDataFrame(right, ROWS), tolerance, width))
    assert got == brute(left, right, tolerance)


def test_ties_go_to_the_earlier_then_the_smaller_id(spark):
    left = spark.createDataFrame([("a", 1.0, 1), ("a", 5.0, 2)], ROWS)
    right = spark.createDataFrame([("a", 1.25, 10), ("a", 0.75, 11), ("a", 5.0, 13), ("a", 5.0, 12)], ROWS)
    assert pairs(match_nearest(left, right, 0.5)) == {(1, 11), (2, 12)}


def test_nulls_and_extra_columns(spark):
    left = [("a", 1.0, 1), (None, 1.0, 2), ("a", None, 3), ("a", float("nan"), 4), ("a", float("inf"), 5), ("a", 1.0, None), ("z", 1.0, 6)]
    right = [("a", 1.0, 7), (None, 1.0, 8), ("a", None, 9), ("a", float("nan"), 10), ("a", 1.0, None)]
    extra = [spark.createDataFrame(r, ROWS).withColumns({c: F.lit("x") for c in ("slice", "side", "c", "before", "after", "gap", "t0")}) for r in (left, right)]
    assert pairs(match_nearest(*extra, 0.1)) == {(1, 7)}


def test_empty_tables(spark):
    some, none = spark.createDataFrame([("a", 1.0, 1)], ROWS), spark.createDataFrame([], ROWS)
    for a, b in ((some, none), (none, some), (none, none)):
        assert match_nearest(a, b, 1.0).count() == 0


def test_one_shuffle_without_python(spark):
    df = spark.createDataFrame([("a", 1.0, 1)], ROWS).cache()
    plan = match_nearest(df, df, 0.1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
