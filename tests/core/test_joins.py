import pytest

from murmuration.joins import join_sized


@pytest.mark.parametrize("most", [0, 2, 100])
def test_every_row_meets_its_key_once(spark, most):
    rows = [(i, k) for i, k in enumerate([1] * 5 + [2] * 2 + [3] + [None] * 4 + [9] * 3)]
    df = spark.createDataFrame(rows, "id bigint, k int")
    table = spark.createDataFrame([(1, 5, "a"), (2, 2, "b"), (3, 1, "c"), (None, 4, "d"), (7, 0, "e")], "k int, n bigint, v string")
    got = join_sized(df, table, ["k"], "n", most)
    assert got.columns == ["id", "k", "n", "v"]
    assert sorted((r["id"], r["v"]) for r in got.collect()) == [(i, {1: "a", 2: "b", 3: "c", None: "d"}[k]) for i, k in rows if k != 9]
    assert join_sized(df.limit(0), table, ["k"], "n", most).count() == 0 and join_sized(df, table.limit(0), ["k"], "n", most).count() == 0
