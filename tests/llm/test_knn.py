import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.llm import knn

from .test_groups import DIM, ROWS, clustered, dirty, usable


def brute(rows, k, least=-1.0):
    v = usable(rows)
    ids = np.array(sorted(v))
    x = np.array([v[i] for i in ids])
    x = x - x.mean(0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for a, i in enumerate(ids):
        s = x @ x[a]
        order = [b for b in np.lexsort((ids, -np.round(s, 12))) if b != a and s[b] >= least][:k]
        out[int(i)] = [(int(ids[b]), s[b]) for b in order]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit("x") for c in ("id", "x", "list", "role", "h", "neighbour")})
    out = {}
    for r in sorted(knn.nearest_vectors(df, dim=DIM, **kw).collect(), key=lambda r: (r["id"], r["place"])):
        out.setdefault(r["id"], []).append((r["neighbour"], r["similarity"]))
        assert r["place"] == len(out[r["id"]])
    return out


ALL = {"store_ratio": 99.0, "query_ratio": 99.0, "most_stored": 10_000, "most_searched": 10_000}


@pytest.mark.parametrize("block", [8192, 40])
def test_all_lists_give_the_exact_result(spark, block):
    rng = np.random.default_rng(1)
    rows = clustered(rng, [1] * 60 + [4] * 20 + [60]) + dirty()
    got, want = run(spark, rows + rows[::3], k=5, block_rows=block, **ALL), brute(rows, 5)
    assert set(got) == set(want)
    for i in want:
        assert [n for n, _ in got[i]] == [n for n, _ in want[i]]
        assert np.allclose([s for _, s in got[i]], [s for _, s in want[i]], atol=1e-6)


def test_recall_with_few_lists(spark):
    rng = np.random.default_rng(2)
    rows = clustered(rng, [20] * 150, 0.15)
    got, want = run(spark, rows, k=5), brute(rows, 5)
    hit = sum(len({n for n, _ in got.get(i, [])} & {n for n, _ in w}) for i, w in want.items())
    assert hit >= 0.9 * 5 * len(want)


@pytest.mark.parametrize("n", [1500, 6000])
def test_recall_of_single_vectors_does_not_fall_with_the_rows(spark, n):
    rng = np.random.default_rng(12)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(n, DIM)).astype(np.float32).tolist())]
    x = np.array([v for _, v in rows])
    x = x - x.mean(0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = run(spark, rows, k=5, queries="id % 10 = 0", query_ratio=1.05, most_searched=2)
    hit = 0
    for i in range(0, n, 10):
        s = x @ x[i]
        s[i] = -9
        hit += len({m for m, _ in got[i]} & set(np.argsort(-s)[:5].tolist()))
    assert hit >= 0.92 * 5 * len(range(0, n, 10))


def test_copies_beyond_the_first(spark):
    rng = np.random.default_rng(3)
    rows = clustered(rng, [1] * 50)
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + [(2000, rows[8][1])]
    got = run(spark, rows, k=3, **ALL)
    first = [7, 1000, 1001, 1002]
    for i in [7, *range(1000, 1040)]:
        assert [n for n, _ in got[i]] == [f for f in first if f != i][:3]
        assert np.allclose([s for _, s in got[i]], 1.0)
    assert got[8][0][0] == 2000 and got[2000][0][0] == 8


def test_query_set_and_least_similarity(spark):
    rng = np.random.default_rng(4)
    rows = clustered(rng, [3] * 40)
    got = run(spark, rows, k=4, queries="id % 10 = 0", min_similarity=0.6, **ALL)
    want = {i: w for i, w in brute(rows, 4, 0.6).items() if i % 10 == 0 and w}
    assert {i: [n for n, _ in w] for i, w in got.items()} == {i: [n for n, _ in w] for i, w in want.items()}


def test_pairs(spark):
    rng = np.random.default_rng(5)
    rows = clustered(rng, [1] * 30 + [6] * 10, 0.1)
    df = spark.createDataFrame(rows + rows[::2], ROWS)
    got = {(r["id_a"], r["id_b"]) for r in knn.similar_pairs(df, 2, 0.8, dim=DIM, **ALL).collect()}
    assert got == {(min(i, n), max(i, n)) for i, w in brute(rows, 2, 0.8).items() for n, _ in w}


def low_dimensional(n, seed=6, dim=64, inner=6):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, inner)) @ np.random.default_rng(1).normal(size=(inner, dim))).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("m", [2_000, 16_384, 131_072])
def test_graph_finds_nearest_centroids_at_any_number(m):
    c = low_dimensional(m)
    graph = knn.CentroidGraph(c)
    assert sorted(graph.order.tolist()) == list(range(m)) and graph.begin[-1] == m  # all can be reached
    graph.entries = 10
    x = low_dimensional(300, 9)
    ids, sims = graph.search(x, 6)
    assert (np.diff(sims, axis=1) <= 0).all()
    want = np.argsort(-(x @ c.T), axis=1)[:, :6]
    hit = np.mean([len(set(a) & set(b)) / 6 for a, b in zip(ids.tolist(), want.tolist())])
    assert hit >= 0.9
    assert all(len(set(r)) == 6 for r in ids.tolist())


def test_graph_compares_all_until_it_is_fitted():
    rng = np.random.default_rng(6)
    c = rng.normal(size=(3000, 32)).astype(np.float32)
    x = c[::7] + 0.1 * rng.normal(size=c[::7].shape).astype(np.float32)
    graph = knn.CentroidGraph(c)
    assert (graph.search(x, 3)[0] == np.argsort(-(x @ c.T), axis=1)[:, :3]).all()
    small = knn.CentroidGraph(c[:5]).search(x, 8)[0]
    assert small.shape[1] == 5 and all(len(set(r)) == 5 for r in small.tolist())


def test_entries_are_fitted_to_the_recall():
    base = low_dimensional(4000, 3)
    graph = knn.CentroidGraph(knn.fit_centroids(base, 1500))
    x = base[:200]
    s = x @ base.T
    s[np.arange(200), np.arange(200)] = -9
    top = np.argsort(-s, axis=1)[:, :5]
    q, near = np.repeat(np.arange(200), 5), base[top.ravel()]
    known = (x, q, np.take_along_axis(s, top, 1).ravel(), near)
    options = (1.3, 6, *knn.fitted_search(graph, *known, 1.3, 6, 1.3, 6, 0.95), 0.95)
    entries = knn.fitted_entries(graph, *known, *options)
    assert entries == graph.entries and 2 * entries < len(graph.pivots)


def test_lists_are_balanced():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(4000, 8)) * 0.05 + 1, rng.normal(size=(400, 8))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = knn.fit_centroids(x.astype(np.float32), 50, rounds=6)
    size = np.bincount((x @ c.T).argmax(1), minlength=50)
    assert size.max() <= 6 * size.mean()


def test_empty(spark):
    assert run(spark, [], k=3) == {} and run(spark, dirty(), k=3) == {} and run(spark, [(1, [1.0] * DIM)], k=3) == {}
