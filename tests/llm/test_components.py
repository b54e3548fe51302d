import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.llm import components
from murmuration.llm.components import connected_components, countable_links


def brute(edges):
    parent = {}

    def root(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {(a, root(a)) for a in parent}


def groups(df):
    rows = [(r["id"], r["group_id"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_random_graph_chain_star_and_clique(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))]
    order = rng.permutation(np.arange(1000, 1300)).tolist()
    edges += list(zip(order, order[1:]))  # a chain in random order
    edges += [(2500, i) for i in range(2000, 2400)]  # a hub that is not the smallest
    edges += [(a, b) for a in range(3000, 3020) for b in range(3000, a)]
    edges += [(None, 1), (2, None), (5000, 5000)] + [(b, a) for a, b in edges[:50]]
    df = spark.createDataFrame(edges, "src bigint, dst bigint").withColumns({c: F.lit(0) for c in ("a", "b", "v", "m", "id")})
    assert groups(connected_components(df)) == brute(edges)


def test_ordered_chain(spark):
    edges = [(i, i + 1) for i in range(200)]
    assert groups(connected_components(spark.createDataFrame(edges, "src bigint, dst bigint"))) == brute(edges)


def test_stars_leave_before_a_long_chain_is_done(spark, monkeypatch):
    taken = []
    part = components._parted
    monkeypatch.setattr(components, "_parted", lambda e: taken.append(part(e)) or taken[-1])
    edges = [(10 * i, 10 * i + k) for i in range(400) for k in range(1, 9)] + [(10_000 + i, 10_001 + i) for i in range(300)]
    edges += [(20_000, 20_001), (20_001, 20_002), (20_000, 20_003)]  # no star at first
    assert groups(connected_components(spark.createDataFrame(edges, "src bigint, dst bigint"))) == brute(edges)
    assert taken and taken[0][0].df.count() >= 3200


def test_stars_are_told_from_what_is_linked_further(spark):
    stars, others = [(1, 5), (1, 6), (2, 7)], [(3, 8), (4, 8), (10, 11), (11, 12), (20, 21), (20, 22), (21, 22)]
    settled, rest = components._parted(spark.createDataFrame(stars + others, "a bigint, b bigint"))
    assert sorted(map(tuple, settled.df.collect())) == stars and sorted(map(tuple, rest.df.collect())) == sorted(others)


def test_empty_and_too_few_rounds(spark):
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame([(i, i + 1) for i in range(64)], "src bigint, dst bigint"), max_rounds=1)


def test_countable_links(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 2, 0.5), (1, 3, 1.0), (1, 4, 0.4999), (1, 5, 1.01), (1, 6, nan), (1, 7, inf), (1, 8, None), (None, 9, 0.7), (1, None, 0.7), (1, 1, 0.7)]
    got = countable_links(spark.createDataFrame(rows, "src bigint, dst bigint, weight double")).collect()
    assert {tuple(r) for r in got} == {(1, 2), (1, 3)}
