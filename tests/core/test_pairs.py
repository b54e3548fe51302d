import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.operators import neighbours, pairs


def vectors(spark, n=150, d=8, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "seg_id bigint, x array<double>")


@pytest.mark.parametrize("block", [4096, 40])
def test_cosine_edges_and_degrees_equal_brute_force(spark, block):
    x, df = vectors(spark)
    s = x @ x.T
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if s[i, j] >= 0.4}
    bad = spark.createDataFrame([(900, None), (901, [float("nan")] * 8), (None, [1.0] * 8)], df.schema)
    rows = pairs.cosine_edges(df.unionByName(bad), 0.4, block).collect()
    assert {(r["src"], r["dst"]) for r in rows} == want and len(rows) == len(want)
    assert all(r["weight"] == pytest.approx(s[r["src"], r["dst"]]) for r in rows)
    assert pairs.cosine_edges(df.limit(0), 0.4).count() == 0
    alike = np.where((s >= 0.4) & ~np.eye(150, dtype=bool), s, 0)
    degrees = {r["seg_id"]: (r["degree"], r["strength"]) for r in pairs.cosine_degrees(df.unionByName(bad), 0.4, block).collect()}
    assert degrees == {i: (int((alike[i] != 0).sum()), pytest.approx(alike[i].sum())) for i in range(150)}
    assert pairs.cosine_degrees(df.limit(0), 0.4).count() == 0


def test_a_higher_threshold_gives_a_subset(spark):
    _, df = vectors(spark, seed=1)
    low, high = ({(r["src"], r["dst"]) for r in pairs.cosine_edges(df, t).collect()} for t in (0.3, 0.6))
    assert high < low


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("how", ["reference", "lossless"])
@pytest.mark.parametrize("least", [0.3, 0.4, 0.5, 0.7, 1.0])
def test_edit_edges_equal_brute_force(spark, how, least):
    rng = np.random.default_rng(int(least * 10))
    seqs = [(i, rng.integers(0, 4, rng.integers(0, 14)).tolist()) for i in range(60)]
    seqs += [(100 + i, seqs[i][1]) for i in range(10)]
    want = {}
    for i, a in seqs:
        for j, b in seqs:
            if i < j and a and b:
                n = max(len(a), len(b))
                if how == "reference" and abs(len(a) - len(b)) / n > least:
                    continue
                if (w := 1 - distance(a, b) / n) >= least:
                    want[i, j] = w
    df = spark.createDataFrame(seqs + [(500, None), (501, [None])], "seg_id bigint, units array<int>")
    rows = pairs.edit_edges(df, least, how).collect()
    assert len(rows) == len(want) and {(r["src"], r["dst"]): r["weight"] for r in rows} == pytest.approx(want)


def test_edit_edges_of_literal_cases(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, [1, 2, 3, 4]), (2, []), (3, [])], "seg_id bigint, units array<int>")
    assert pairs.edit_edges(df, 0.4).count() == 0
    assert [tuple(r) for r in pairs.edit_edges(df, 0.4, "lossless").collect()] == [(0, 1, 0.5)]


def test_edges_do_not_depend_on_ids(spark):
    _, df = vectors(spark, 60, seed=3)
    moved = df.withColumn("seg_id", (F.col("seg_id") * 37) % 61)
    back = {i * 37 % 61: i for i in range(61)}
    a = {frozenset((r["src"], r["dst"])) for r in pairs.cosine_edges(df, 0.3).collect()}
    b = {frozenset((back[r["src"]], back[r["dst"]])) for r in pairs.cosine_edges(moved, 0.3).collect()}
    assert a == b


def test_nearest_centroids_in_one_and_many_blocks(spark, monkeypatch):
    x, df = vectors(spark)
    c = x[:17]
    far = ((x[:, None] - c[None]) ** 2).sum(2)
    centroids = df.where("seg_id < 17").withColumnRenamed("seg_id", "k")
    for most in (8_000_000, 40):
        monkeypatch.setattr(neighbours, "MAX_VALUES", most)
        got = {r["seg_id"]: (r["k"], r["distance2"]) for r in neighbours.assign_nearest(df, centroids).collect()}
        assert {i: k for i, (k, _) in got.items()} == dict(enumerate(far.argmin(1).tolist()))
        assert np.allclose([got[i][1] for i in range(150)], far.min(1))
    assert neighbours.assign_nearest(df, centroids.limit(0)).count() == 0


def test_degrees(spark):
    vertices = spark.createDataFrame([(1,), (2,), (3,)], "seg_id bigint")
    edges = spark.createDataFrame([(1, 2, 0.5)], "src bigint, dst bigint, weight double")
    assert sorted(map(tuple, pairs.vertex_degrees(vertices, edges).collect())) == [(1, 1, 0.5), (2, 1, 0.5), (3, 0, 0.0)]


@pytest.mark.parametrize("how, most", [("edit_edges", 0.4), ("edit_edges_lossless", 0.6)])
def test_edit_queries_keep_units_apart(spark, tmp_path, how, most):
    from murmuration.plans import queries

    sequences = {1: [1, 2, 3], 2: [91, 92, 93], 3: [181, 2, 3], 4: [1, 92, None, 93, -1], 5: [299, 2, 3, 7], 6: [2, 3], 7: []}
    spark.createDataFrame(list(sequences.items()), "seg_id bigint, quantised array<int>").write.parquet(str(tmp_path / "unit_segments.parquet"))
    clean = {i: [u for u in s if u is not None and u >= 0] for i, s in sequences.items()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = set()
    for i, a in clean.items():
        for j, b in clean.items():
            if i < j and a and b:
                n = max(len(a), len(b))
                if abs(len(a) - len(b)) / n <= most and 1 - distance(a, b) / n >= 0.4:
                    want.add((i, j, round(1 - distance(a, b) / n, 5)))
    assert {tuple(r) for r in queries.QUERIES[how](spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("t", [-0.2, 0.3, 0.5, 0.74])
def test_tiles_find_what_all_products_find(t, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([c + 0.05 * rng.normal(size=(40, 48)) for c in rng.normal(size=(12, 48)) / 7])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] = x[3]  # a product that is exactly the threshold counts
    monkeypatch.setattr(pairs, "TILE", (64, 96))
    for left, right in ((np.arange(480), None), (np.arange(0, 200), np.arange(200, 480))):
        right = left if right is None else right
        found = list(pairs._tiled(x, left, right, t))
        got = {(min(a, b), max(a, b)) for i, j, _ in found for a, b in zip(i.tolist(), j.tolist())}
        s = x[left] @ x[right].T
        want = {(a, b) for a, b in zip(left[np.nonzero(s >= t)[0]].tolist(), right[np.nonzero(s >= t)[1]].tolist()) if a < b}
        assert got == want and sum(len(i) for i, _, _ in found) == len(want)


def test_leading_dimensions_are_used_where_they_decide():
    x = np.random.default_rng(1).normal(size=(400, 96))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert pairs.leading_dims(x, x, 0.74) < 70 and pairs.leading_dims(x, x, 0.1) == 96


def test_links_have_the_components_of_the_edges(spark):
    from murmuration.operators import community

    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(30, 16)), 5, axis=0) + 0.1 * rng.normal(size=(150, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "seg_id bigint, x array<double>")
    edges, links = pairs.cosine_edges(df, 0.8).collect(), pairs.cosine_links(df, 0.8, block_rows=64)
    parts = lambda e: sorted(map(tuple, community.components(df.select("seg_id"), e).collect()))
    assert parts(links) == parts(spark.createDataFrame(edges)) and links.count() < len(edges)


def test_forest_of_many_edges_in_pieces(spark):
    from murmuration.operators import community

    rng = np.random.default_rng(3)
    rows = [(int(a), int(b)) for a, b in rng.integers(0, 60, size=(3000, 2)) * 2 + rng.integers(0, 2, size=(3000, 1))] + [(5, 5), (None, 3)]
    edges = spark.createDataFrame(rows, "src bigint, dst bigint")
    few = pairs.spanning_forest(edges.coalesce(1), 500)
    assert 118 <= few.count() < 600
    vertices = spark.range(121).withColumnRenamed("id", "seg_id")
    assert {tuple(r) for r in community.components(vertices, edges).collect()} == {(i, i % 2) for i in range(120)} | {(120, 120)}
    # An end that is no vertex connects nothing.
    assert {tuple(r) for r in community.components(vertices.where("seg_id <> 1"), spark.createDataFrame([(0, 1), (1, 2)], "src bigint, dst bigint")).where("seg_id < 3").collect()} == {(0, 0), (2, 2)}


@pytest.mark.parametrize("how, t", [("reference", 0.4), ("lossless", 0.4), ("lossless", 0.7), ("lossless", 0.0)])
def test_edit_blocks_of_lengths_lose_no_pair(spark, how, t):
    rng = np.random.default_rng(8)
    base = [rng.integers(0, 12, size=n).tolist() for n in rng.integers(1, 30, size=25)]
    rows = [(i, [u if rng.random() > 0.3 else int(rng.integers(0, 150)) for u in base[i % 25]][: int(rng.integers(1, 40))]) for i in range(120)]
    df = spark.createDataFrame(rows, "seg_id bigint, units array<int>")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want, most = set(), t if how == "reference" else 1 - t
    for i, a in rows:
        for j, b in rows[i + 1 :]:
            n = max(len(a), len(b))
            if abs(len(a) - len(b)) / n <= most and 1 - distance(a, b) / n >= t:
                want.add((i, j))
    assert {(r["src"], r["dst"]) for r in pairs.edit_edges(df, t, how, block_rows=16).collect()} == want


def test_buckets_are_even_and_bound_what_texts_share():
    rng = np.random.default_rng(4)
    texts = ["".join(chr(33 + int(u)) for u in rng.zipf(1.6, size=20) % 90) for _ in range(300)]
    known = pairs.feature_buckets(texts[:200], 32)
    names = np.array(sorted(known))
    bag = pairs.bags(texts, (names, np.array([known[f] for f in names])), 32)
    assert (bag.sum(1) == 20).all() and bag[:200].sum(0).max() < 2 * bag[:200].sum(0).mean() + 200
    for i, j in rng.integers(0, 300, size=(200, 2)):
        share = sum(min(texts[i].count(c), texts[j].count(c)) for c in set(texts[i]))
        assert np.minimum(bag[i], bag[j]).sum() >= share
