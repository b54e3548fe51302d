import numpy as np
import pytest

from murmuration.operators import community, zipf
from murmuration.operators.catalog import Catalog, graph_edges
from murmuration.plans import pipelines


def quality(label, n, src, dst, w, kind, gamma):
    label = np.asarray(label)
    inner = sum(x for a, b, x in zip(src, dst, w) if label[a] == label[b])
    if kind == "cpm":
        return inner - gamma * sum(c * (c - 1) / 2 for c in np.bincount(label))
    k = np.bincount(src, w, n) + np.bincount(dst, w, n)
    g = gamma if kind == "rb" else 1.0
    return inner - g * sum(k[label == c].sum() ** 2 for c in set(label.tolist())) / (4 * w.sum())


def planted(k=6, n=12, p_in=0.8, p_out=0.03, seed=0):
    rng = np.random.default_rng(seed)
    truth = np.repeat(np.arange(k), n)
    a, b = np.triu_indices(k * n, 1)
    keep = rng.random(len(a)) < np.where(truth[a] == truth[b], p_in, p_out)
    return k * n, a[keep], b[keep], rng.uniform(0.5, 1.0, keep.sum()), truth


@pytest.mark.parametrize("kind,gamma", [("cpm", 0.2), ("cpm", 0.5), ("modularity", 1.0), ("rb", 1.0), ("rb", 2.0)])
def test_quality_is_no_worse_than_simple_partitions(kind, gamma):
    n, a, b, w, truth = planted()
    found = community.leiden(n, a, b, w, kind, gamma)
    best = max(quality(p, n, a, b, w, kind, gamma) for p in (np.arange(n), np.zeros(n, int), truth))
    assert quality(found, n, a, b, w, kind, gamma) >= best - 1e-9
    assert (found == community.leiden(n, a, b, w, kind, gamma)).all()


def test_planted_communities_are_found_and_connected():
    n, a, b, w, truth = planted()
    found = community.leiden(n, a, b, w, "cpm", 0.2)
    assert len(set(zip(found.tolist(), truth.tolist()))) == 6 == found.max() + 1
    for c in set(found.tolist()):
        seen, todo = set(), [int(np.flatnonzero(found == c)[0])]
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += [int(y) for x, y in [*zip(a, b), *zip(b, a)] if x == v and found[y] == c]
        assert len(seen) == (found == c).sum()


def test_community_size_is_bounded():
    n, a, b, w, _ = planted(2, 30, 1.0, 0.0)
    assert np.bincount(community.leiden(n, a, b, w, "cpm", 0.1, max_size=7)).max() <= 7


def graph(spark, seed=0):
    n, a, b, w, truth = planted(seed=seed, p_out=0.0)
    edges = spark.createDataFrame([(int(x), int(y), float(z)) for x, y, z in zip(a, b, w)], "src bigint, dst bigint, weight double")
    return n, a, b, w, truth, spark.range(n + 3).withColumnRenamed("id", "seg_id"), edges


def test_partition_by_component(spark):
    n, _, _, _, truth, vertices, edges = graph(spark)
    got = {r["seg_id"]: r["cluster"] for r in community.leiden_partition(vertices, edges, "cpm", 0.1).collect()}
    assert len(got) == n + 3 and len({(got[i], truth[i]) for i in range(n)}) == 6
    assert all(got[i] == i for i in range(n, n + 3))
    parts = {r["seg_id"]: r["component"] for r in community.components(vertices, edges).collect()}
    assert parts == {i: int(truth[i]) * 12 if i < n else i for i in range(n + 3)}
    assert community.leiden_partition(vertices, edges.limit(0)).count() == n + 3


@pytest.mark.parametrize(("kind", "gamma", "max_size"), [("cpm", 0.2, None), ("cpm", 0.2, 20), ("modularity", 1.0, None)])
def test_large_components_are_shrunk_first(spark, monkeypatch, kind, gamma, max_size):
    monkeypatch.setattr(community, "MAX_EDGES", 60)
    n, a, b, w, truth = planted(6, 14, 0.8, 0.03)
    extra = [(200, 201, 0.9), (201, 202, 0.8)]  # a small component beside it
    edges = spark.createDataFrame([*((int(x), int(y), float(z)) for x, y, z in zip(a, b, w)), *extra], "src bigint, dst bigint, weight double")
    vertices = spark.createDataFrame([(i,) for i in [*range(n), 200, 201, 202, 300]], "seg_id bigint")
    got = {r["seg_id"]: r["cluster"] for r in community.leiden_partition(vertices, edges, kind, gamma, max_size=max_size).collect()}
    assert set(got) == {*range(n), 200, 201, 202, 300} and got[300] == 300 and got[200] == got[201] == got[202] == 200
    found = np.array([got[i] for i in range(n)])
    assert all(c == min(np.flatnonzero(found == c)) for c in set(found.tolist()))
    plain = community.leiden(n, a, b, w, kind, gamma, max_size=max_size)
    assert quality(found, n, a, b, w, kind, gamma) >= 0.95 * quality(plain, n, a, b, w, kind, gamma)
    if max_size is not None:
        assert np.bincount(found).max() <= max_size
    near = {v: set() for v in range(n)}
    for x, y in zip(a.tolist(), b.tolist()):
        if found[x] == found[y]:
            near[x].add(y)
            near[y].add(x)
    for c in set(found.tolist()):
        seen, todo = set(), [c]
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += near[v]
        assert len(seen) == (found == c).sum()


@pytest.mark.parametrize("kind,gamma", [("cpm", 0.3), ("modularity", 1.0), ("rb", 1.7)])
def test_quality_query_equals_numpy(spark, kind, gamma):
    n, a, b, w, truth, vertices, edges = graph(spark, 1)
    label = np.append(np.arange(n) % 5, [5, 5, 6])
    assigned = spark.createDataFrame([(i, int(c)) for i, c in enumerate(label)], "seg_id bigint, cluster bigint")
    got = community.partition_quality(assigned, edges, kind, gamma).first()[0]
    assert got == pytest.approx(quality(label, n + 3, a, b, w, kind, gamma))


def test_tuning_follows_its_rule():
    calls = []

    def partition(step, gamma):
        calls.append((step, gamma))
        return f"p{step}", int(round(200 * gamma))

    best, gamma, history = community.tune(partition, 60, 0.5, 15, 2)
    assert abs(int(round(200 * gamma)) - 60) <= 2 and best == f"p{len(history) - 1}"
    assert history[1]["resolution"] == pytest.approx(0.5 - 0.1 * 40 / 60)
    calls.clear()
    best, gamma, history = community.tune(partition, 60, 0.5, 0)
    assert (best, gamma, history) == ("p0", 0.5, []) and len(calls) == 1
    calls.clear()
    community.tune(lambda s, g: (calls.append(g), 1000)[1:] * 2, 1, 0.5, 4, 1)
    assert len(calls) == 4 and calls[1] == pytest.approx(0.5 - 0.1 * 2)


def test_pipelines(spark, tmp_path):
    rng = np.random.default_rng(2)
    c = rng.normal(size=(4, 8))
    frames = [(f"u{u}", f, (c[(u + f // 5) % 4] + 0.05 * rng.normal(size=8)).tolist()) for u in range(6) for f in range(20)]
    frame_df = spark.createDataFrame(frames, "utt_id string, frame int, x array<double>")
    ends = spark.createDataFrame([(f"u{u}", p, 0.1 * (p + 1)) for u in range(5) for p in range(4)], "utt_id string, pos int, end_sec double")
    pooled = pipelines.pool(frame_df, ends, 6)
    assert pooled.count() == 21 and pooled.where("utt_id = 'u5'").count() == 1
    vectors = pipelines.embeddings(pooled, 6)
    found, gamma, _ = pipelines.cosine_graph(vectors, 5, 0.5, max_iter=4, tolerance=1)
    assert found.count() == 21 and 4 <= found.select("cluster").distinct().count() <= 6
    sequences, codebook = pipelines.quantise(frame_df, frame_df, ends, 4, collapsed=True)
    assert codebook.count() == 4 and sequences.count() == 20 and all(len(r["units"]) == 1 for r in sequences.collect())
    edit, _, _ = pipelines.edit_graph(sequences, 4, 0.6, max_iter=2, tolerance=1)
    assert edit.select("cluster").distinct().count() == 4
    for df in (pipelines.kmeans_clusters(vectors, 4), pipelines.birch_clusters(vectors, 4, 6), pipelines.gmm_clusters(vectors, 4), pipelines.agglomerative_clusters(vectors, 4)):
        assert df.count() == 21
    for family in ("fixed", "diag", "full"):
        a, trace = pipelines.fbgmm_clusters(vectors, 4, 2, family=family, checkpoint=str(tmp_path / family))
        assert a.count() == 21 and trace.count() == 2
        b, more = pipelines.fbgmm_clusters(vectors, 4, 1, family=family, checkpoint=str(tmp_path / family), resume=True)
        assert sorted(r["iter"] for r in more.collect()) == [1, 2, 3]
        # A run that is cut off and resumed is the run that is not.
        whole, _ = pipelines.fbgmm_clusters(vectors, 4, 3, family=family, checkpoint=str(tmp_path / f"{family}-whole"))
        assert sorted(map(tuple, b.collect())) == sorted(map(tuple, whole.collect()))
    assert pipelines.members(pipelines.kmeans_clusters(vectors, 4), pooled).count() == 21


def test_catalog(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "c"))
    made = []

    def make(vectors, least):
        made.append(least)
        return spark.createDataFrame([(1, 2, 0.9)], "src bigint, dst bigint, weight double")

    for _ in range(2):
        assert graph_edges(catalog, "one/a b", None, "cosine", 0.5, make).count() == 1
    graph_edges(catalog, "one/a b", None, "cosine", 0.6, make)
    graph_edges(catalog, "other", None, "cosine", 0.5, make)  # other vectors have edges of their own
    assert made == [0.5, 0.6, 0.5] and not catalog.exists("model", k=3)
    with pytest.raises(ValueError):
        graph_edges(catalog, "", None, "cosine", 0.5, make)


def test_pipelines_read_what_a_catalog_keeps(spark, tmp_path):
    rng = np.random.default_rng(4)
    frames = spark.createDataFrame([(f"u{u}", f, rng.normal(size=5).tolist()) for u in range(3) for f in range(20)], "utt_id string, frame int, x array<double>")
    ends = spark.createDataFrame([(f"u{u}", p, 0.1 * (p + 1)) for u in range(3) for p in range(4)], "utt_id string, pos int, end_sec double")
    catalog = Catalog(spark, str(tmp_path / "c"))
    first = pipelines.pool(frames, ends, 3, catalog, "train")
    # The models of the first frames serve for others under the same name, as they must for new recordings.
    again = pipelines.pool(frames, ends, 3, catalog, "train")
    plain = pipelines.pool(frames, ends, 3)
    rows = lambda df: [[*map(str, r[:-1]), *np.round(r["features"], 5).tolist()] for r in df.orderBy("seg_id").collect()]
    assert rows(first) == rows(again) == rows(plain)
    assert all(catalog.exists(k, source="train") for k in ("scaler",)) and catalog.exists("loadings", source="train", n_components=3)
    _, codebook = pipelines.quantise(frames, frames, ends, 4, catalog=catalog, source="train")
    assert catalog.exists("codebook", source="train", k=4, hours=2.0, seed=42) and codebook.count() == 4
    vectors = pipelines.embeddings(first, 3)
    assert pipelines.kmeans_clusters(vectors, 3, catalog=catalog, source="train").count() == pipelines.kmeans_clusters(vectors, 3, catalog=catalog, source="train").count() == 12
    assert catalog.exists("initial-centroids", source="train", k=3, seed=0)
    pipelines.cosine_graph(vectors, 3, 0.2, max_iter=1, catalog=catalog, source="train")
    assert catalog.exists("edges", source="train", graph="cosine", threshold=0.2)
    with pytest.raises(ValueError):
        pipelines.pool(frames, ends, 3, catalog)


def test_rank_frequency(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 9), ("c", 5), ("d", 1)], "token string, cnt bigint")
    rows = zipf.rank_frequency(counts, "token").orderBy("rank").collect()
    assert [(r["token"], r["rank"], r["prob"]) for r in rows] == [("b", 1, 0.45), ("a", 2, 0.25), ("c", 3, 0.25), ("d", 4, 0.05)]
    curve = zipf.reference_curve(zipf.extent(zipf.rank_frequency(counts, "token")), 3).orderBy("i").collect()
    assert [r["r"] for r in curve] == pytest.approx([1, 2, 4]) and [r["p"] for r in curve] == pytest.approx([0.54, 0.27, 0.135])


def test_tokens(spark):
    rows = [(1, "words", " Cat2 "), (2, "words", "SIL"), (3, "words", "123"), (4, "phones", "AH0"), (5, "words", None)]
    df = spark.createDataFrame(rows, "token_id bigint, tier string, label string")
    assert [(r["token_id"], r["token"]) for r in zipf.clean_tokens(df).collect()] == [(1, "cat"), (3, "")]
    assert [r["token"] for r in zipf.clean_tokens(df, "phones").collect()] == ["ah"]
    assert zipf.clean_tokens(df, drop_blank=True).count() == 1


def test_leiden_query_searches_the_components_of_the_graph_once(spark, monkeypatch):
    from murmuration.plans import queries

    calls, search = [], community.components
    monkeypatch.setattr(community, "components", lambda v, e, *a: calls.append(e) or search(v, e, *a))
    row = queries.leiden_communities(spark, "/root/testdata/sf0.001").first()
    assert row["n_repeated"] == row["n_in_pieces"] == 0 and row["preferred"]
    assert len(calls) == 2  # the graph, and what is within communities
