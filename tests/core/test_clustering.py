import numpy as np
import pytest

from murmuration.operators import agglomerative, birch, gmm, kmeans, partition, scaling
from murmuration.operators.neighbours import centroid_matrix
from murmuration.sources import files


def blobs(spark, k=5, n=40, d=6, spread=0.1, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(k, d)) * 3
    x = np.concatenate([v + spread * rng.normal(size=(n, d)) for v in c])
    return x, np.repeat(np.arange(k), n), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "seg_id bigint, x array<double>")


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def labels(df, column="k"):
    got = {r["seg_id"]: r[column] for r in df.collect()}
    return [got[i] for i in range(len(got))]


def test_kmeans_finds_blobs_and_is_repeatable(spark):
    _, truth, df = blobs(spark)
    a, ca = kmeans.kmeans(df, 5, seed=1)
    b, cb = kmeans.kmeans(df.repartition(3), 5, seed=1)
    assert labels(a) == labels(b)
    assert np.allclose(centroid_matrix(ca)[1], centroid_matrix(cb)[1])
    assert len(set(labels(a))) == 5 and same_partition(labels(a), truth.tolist())


def test_lloyd_loop_equals_single_steps(spark):
    x, _, df = blobs(spark, spread=2.0, seed=2)
    init = df.where("seg_id % 50 = 0").withColumnRenamed("seg_id", "k")
    c = x[::50]
    for _ in range(3):
        own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[own == k].mean(0) for k in range(len(c))])
    from murmuration.operators.neighbours import centroid_table

    start = centroid_table(spark, x[::50])
    _, got = kmeans.kmeans(df, 4, rounds=3, init=start)
    assert np.allclose(centroid_matrix(got)[1], c)
    step = kmeans.lloyd_step(df, start)
    again = kmeans.lloyd_step(df, kmeans.lloyd_step(df, step.select("k", "x")).select("k", "x"))
    assert np.allclose(centroid_matrix(again.select("k", "x"))[1], c)
    assert init.count() == 4


def test_kmeans_of_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0]), (3, [2.0]), (4, None)], "seg_id bigint, x array<double>")
    found, c = kmeans.kmeans(df, 9)
    assert c.count() == 2 and found.count() == 3
    assert kmeans.kmeans(df.limit(0), 3)[0].count() == 0


def test_codebook(spark):
    _, truth, df = blobs(spark, 3)
    frames = df.selectExpr("'u' as utt_id", "cast(seg_id as int) as frame", "x")
    got = {r["frame"]: r["unit"] for r in kmeans.quantise(frames, kmeans.fit_codebook(frames, 3)).collect()}
    assert same_partition([got[i] for i in range(120)], truth.tolist())


def test_gmm_step_equals_numpy_and_finds_blobs(spark):
    x, truth, df = blobs(spark, 3, spread=0.5, seed=4)
    model = gmm.Spherical(np.array([0.2, 0.3, 0.5]), x[[0, 50, 100]], np.array([1.0, 2.0, 3.0]))
    new, ll = gmm.em_step(df, model)
    dens = np.array([[np.log(w) - 3 * np.log(2 * np.pi * v) - ((p - m) ** 2).sum() / (2 * v) for w, m, v in zip(model.weight, model.mean, model.var)] for p in x])
    total = np.log(np.exp(dens - dens.max(1, keepdims=True)).sum(1)) + dens.max(1)
    r = np.exp(dens - total[:, None])
    assert ll == pytest.approx(total.mean())
    assert np.allclose(new.weight, r.mean(0)) and np.allclose(new.mean, r.T @ x / r.sum(0)[:, None])
    var = [(r[:, k] * ((x - new.mean[k]) ** 2).sum(1)).sum() / r[:, k].sum() / 6 + 1e-6 for k in range(3)]
    assert np.allclose(new.var, var)
    found, _ = gmm.fit_gmm(df, 3)
    assert same_partition(labels(found), truth.tolist())
    assert gmm.fit_gmm(df.limit(0), 3)[0].count() == 0


def naive(x, linkage, k=None, threshold=None, metric="euclidean"):
    """Joins the two nearest clusters, with distances from their definition."""
    d = agglomerative.distances(x, metric)
    parts = [[i] for i in range(len(x))]

    def far(a, b):
        if linkage == "ward":
            gap = x[a].mean(0) - x[b].mean(0)
            return np.sqrt(2 * len(a) * len(b) / (len(a) + len(b)) * (gap @ gap))
        block = d[np.ix_(a, b)]
        return {"average": block.mean, "complete": block.max, "single": block.min}[linkage]()

    while len(parts) > (k or 1):
        h, i, j = min((far(parts[i], parts[j]), i, j) for i in range(len(parts)) for j in range(i + 1, len(parts)))
        if threshold is not None and h >= threshold:
            break
        parts[i] = parts[i] + parts.pop(j)
    return sorted(map(sorted, parts))


def parts_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["cluster"], []).append(r["seg_id"])
    assert all(min(v) == c for c, v in out.items())
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("linkage", ["average", "complete", "single", "ward"])
@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_agglomerative_equals_the_naive_way(spark, linkage, metric):
    x = np.random.default_rng(5).normal(size=(45, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "seg_id bigint, x array<double>")
    if linkage == "ward" and metric == "cosine":
        with pytest.raises(ValueError):
            agglomerative.agglomerative(df, 6, linkage=linkage, metric=metric)
        return
    assert parts_of(agglomerative.agglomerative(df, 6, linkage=linkage, metric=metric)) == naive(x, linkage, 6, metric=metric)
    t = 0.9 if metric == "euclidean" else 0.2
    assert parts_of(agglomerative.agglomerative(df, threshold=t, linkage=linkage, metric=metric)) == naive(x, linkage, threshold=t, metric=metric)


def test_agglomerative_refuses_and_empty(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "seg_id bigint, x array<double>")
    assert agglomerative.agglomerative(df.limit(0), 2).count() == 0
    monkeypatch.setattr(agglomerative, "MAX_ROWS", 3)
    with pytest.raises(ValueError):
        agglomerative.agglomerative(df, 2)
    with pytest.raises(ValueError):
        agglomerative.agglomerative(df)


def test_birch(spark):
    x, truth, df = blobs(spark, 4, seed=6)
    assert same_partition(labels(birch.birch(df.repartition(3), 4, 6)), truth.tolist())
    assert birch.birch(df.limit(0), 4, 6).count() == 0
    tree = birch.Tree(6, 0.5, 5)
    for v in x:
        tree.insert(1.0, v, v @ v)
    leaves = list(tree.leaves())
    assert sum(n for n, _, _ in leaves) == len(x) and np.allclose(sum(s for _, s, _ in leaves), x.sum(0))
    assert all(q / n - (s / n) @ (s / n) <= 0.25 + 1e-9 for n, s, q in leaves)


def test_partition_tables(spark, tmp_path):
    rows = [(0, 5), (1, 2), (2, 5), (3, 0), (4, None)]
    df = spark.createDataFrame(rows, "seg_id bigint, cluster int")
    assert sorted((r["class"], r["members"]) for r in partition.member_lists(df).collect()) == [(0, [0, 2]), (1, [1]), (2, [3])]
    by_size = {r["cluster"]: r["class"] for r in partition.class_numbers(spark.createDataFrame([(0, 7), (1, 8), (2, 8)], df.schema), "size").collect()}
    assert by_size == {8: 0, 7: 1}
    s = partition.size_summary(partition.cluster_sizes(df), k_target=5).first()
    assert (s["active"], s["empty"], s["min_size"], s["max_size"], s["median_size"]) == (3, 2, 1, 2, 1.0)
    assert partition.cluster_count(df).first()[0] == 3
    assert not partition.labels_are_contiguous(df).first()[0]
    again = partition.relabelled(df)
    assert partition.labels_are_contiguous(again).first()[0]
    places = spark.createDataFrame([(i, f"u{i}", i, i + 5) for i in range(5)], "seg_id bigint, utt_id string, start_frame int, end_frame int")
    files.write_partition(partition.partition_members(df, places), str(tmp_path / "p"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "p").glob("part-*")))
    assert text.startswith("Class 0\nu0 0.0 0.1\nu2 0.04 0.14\n\nClass 1\n")


def test_scaler_and_principal_components(spark):
    x = np.random.default_rng(8).normal(size=(80, 5)) @ np.random.default_rng(9).normal(size=(5, 5))
    df = spark.createDataFrame([(f"u{i % 3}", i, v.tolist()) for i, v in enumerate(x)], "utt_id string, frame int, x array<double>")
    stats, loadings = scaling.fit_scaler_pca(df, 3)
    got = {r["frame"]: r["x"] for r in scaling.project(df, stats, loadings, ["utt_id", "frame"]).collect()}
    z = (x - x.mean(0)) / x.std(0)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    want = (u * s)[:, :3]
    y = np.array([got[i] for i in range(80)])
    assert np.allclose(y @ y.T, want @ want.T)  # signs are free
