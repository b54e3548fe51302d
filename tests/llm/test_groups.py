import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.llm import groups

DIM = 16
ROWS = "seg_id bigint, features array<float>"


def clustered(rng, sizes, noise=0.25):
    rows, i = [], 0
    for n in sizes:
        c = rng.normal(size=DIM)
        c *= 2.0 / np.linalg.norm(c)
        for _ in range(n):
            rows.append((i, (c + noise * rng.normal(size=DIM) / 2).astype(np.float32).tolist()))
            i += 1
    return rows


def usable(rows):
    out = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == DIM and all(e is not None and np.isfinite(e) for e in v) and any(v):
            out[i] = np.array(v, np.float32).astype(float)
    return out


def brute(rows, threshold):
    """Components, and which of them are cliques."""
    v = usable(rows)
    ids = sorted(v)
    x = np.array([v[i] for i in ids])
    x = x - x.mean(0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    label = {}
    for a in range(len(ids)):
        if ids[a] in label:
            continue
        todo = [a]
        label[ids[a]] = ids[a]
        while todo:
            for b in np.flatnonzero(near[todo.pop()]):
                if ids[b] not in label:
                    label[ids[b]] = ids[a]
                    todo.append(b)
    members = {}
    for i, g in label.items():
        members.setdefault(g, []).append(ids.index(i))
    tight = {g for g, m in members.items() if near[np.ix_(m, m)].all()}
    return label, tight, near, ids


def run(spark, rows, threshold=0.7, **kw):
    df = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit("x") for c in ("id", "x", "grp", "code", "n", "degree")})
    # Few vectors, some just at the threshold: the sets are those that these tests were written with, whatever the defaults.
    return {r["id"]: r for r in groups.similarity_groups(df, threshold, DIM, bands=16, set_size=14, **kw).collect()}


def dirty():
    nan, inf = float("nan"), float("inf")
    ok = [1.0] * DIM
    return [(9000, None), (9001, []), (9002, ok[:-1]), (9003, ok + [1.0]), (9004, [0.0] * DIM), (9005, ok[:-1] + [nan]), (9006, ok[:-1] + [inf]), (9007, ok[:-1] + [None]), (None, ok)]


@pytest.mark.parametrize("block", [8192, 24])
def test_groups_are_components_and_cliques_are_told_apart(spark, block):
    rng = np.random.default_rng(1)
    rows = clustered(rng, [1] * 40 + [2] * 10 + [5] * 6 + [60, 90])
    copies = [(5000 + i, rows[0][1]) for i in range(120)] + [(6000 + i, rows[150][1]) for i in range(4)]
    rows = rows + copies + dirty()
    label, tight, _, ids = brute(rows, 0.7)
    got = run(spark, rows + rows[::3], block_rows=block)
    assert set(got) == set(ids)
    assert {i: r["component"] for i, r in got.items()} == label
    assert {r["component"] for r in got.values() if r["tight"]} == tight
    sizes = {}
    for g in label.values():
        sizes[g] = sizes.get(g, 0) + 1
    assert all(r["n_component"] == sizes[r["component"]] for r in got.values())


@pytest.mark.parametrize("most", [1_000_000, 2])
def test_loose_components_are_split_around_medoids(spark, monkeypatch, most):
    monkeypatch.setattr(groups, "SPLIT_ROWS", most)
    rng = np.random.default_rng(2)
    base = np.linalg.qr(rng.normal(size=(DIM, DIM)))[0]
    angles = np.deg2rad([0, 20, 40, 60, 80])  # a chain: neighbours are alike, ends are not
    rows = [(i, (np.cos(a) * base[0] + np.sin(a) * base[1]).tolist()) for i, a in enumerate(angles)]
    rows += [(100 + i, (s * b).tolist()) for i, (b, s) in enumerate((b, s) for b in base[2:] for s in (1, -1))]
    rows += [(200 + i, (-np.array(v)).tolist()) for i, v in rows[:5]]
    label, tight, near, ids = brute(rows, 0.9)
    got = run(spark, rows, 0.9)
    assert {i: r["component"] for i, r in got.items()} == label
    assert not got[0]["tight"] and got[0]["n_component"] == 5
    for i, r in got.items():
        parts = [j for j, s in got.items() if s["group_id"] == r["group_id"]]
        assert min(parts) == r["group_id"] and len(parts) == r["n_members"]
        at = [ids.index(j) for j in parts]
        assert near[np.ix_(at, at)].all(1).any()  # a medoid is alike to all of its part


def test_anchors_through_the_graph(spark, monkeypatch):
    monkeypatch.setattr(groups, "EXACT_ANCHORS", 8)
    rng = np.random.default_rng(7)
    rows = clustered(rng, [1] * 100 + [4] * 60)
    label, tight, _, _ = brute(rows, 0.7)
    got = run(spark, rows)
    assert {i: r["component"] for i, r in got.items()} == label
    assert {r["component"] for r in got.values() if r["tight"]} == tight


def test_near_anchors_are_groups_and_a_vector_goes_to_each_once():
    rng = np.random.default_rng(14)
    centres = rng.normal(size=(20, 64))
    anchors = np.repeat(centres, 25, 0) + 0.5 * rng.normal(size=(500, 64))
    anchors = (anchors / np.linalg.norm(anchors, axis=1, keepdims=True)).astype(np.float32)
    for width in (1, 7, 64):
        group, place = groups.anchor_groups(anchors, width)
        assert place.max() < width and len(set(zip(group, place))) == 500 and group.max() == -(-500 // width) - 1
    x = (anchors[::2] + 0.05 * rng.normal(size=(250, 64))).astype(np.float32)
    keys = [*groups.minhash_keys(groups.nearest_anchors(x, anchors, 12), groups.hash_orders(500, 24)), np.zeros(0, np.int32)]
    sent = groups.marked(keys, group, place)
    assert len(sent) == len(keys) and len(sent.values) < 0.5 * sum(len(k) for k in keys)
    for k, row in zip(keys, sent.to_pylist()):
        at = {r["key"]: np.uint64(r["marks"] % (1 << 64)) for r in row}
        assert len(at) == len(row)
        assert sorted(a for a in range(500) if group[a] in at and at[group[a]] >> np.uint64(place[a]) & np.uint64(1)) == k.tolist()


@pytest.mark.parametrize("block", [8192, 1])
def test_groups_found_in_rounds(spark, monkeypatch, block):
    monkeypatch.setattr(groups, "ROUND_BYTES", 1)
    seen, rounds_of = [], groups.rounds_of
    monkeypatch.setattr(groups, "rounds_of", lambda *a: seen.append(rounds_of(*a)) or seen[-1])
    rng = np.random.default_rng(15)
    rows = clustered(rng, [1] * 30 + [5] * 6 + [40])
    label, tight, _, _ = brute(rows, 0.7)
    got = run(spark, rows, block_rows=block)
    assert seen[0] > 1
    assert {i: r["component"] for i, r in got.items()} == label
    assert {r["component"] for r in got.values() if r["tight"]} == tight


def test_what_was_shuffled_is_deleted(spark, monkeypatch):
    name, seen, write = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], groups.write_table
    monkeypatch.setattr(groups, "write_table", lambda df, label: seen.append(spark.conf.get(name, None)) or write(df, label))
    setting, df = spark.conf.get(name, None), spark.createDataFrame(clustered(np.random.default_rng(16), [1] * 20 + [4] * 10), ROWS)
    groups.similarity_groups(df, 0.7, DIM, bands=16, set_size=14)
    assert len(seen) > 5 and set(seen) == {"true"} and spark.conf.get(name, None) == setting

    def shuffled(query):
        """Files that are left of the shuffles from here on."""
        first = spark._jsc.sc().newShuffleId()
        query()
        for _ in range(50):  # they are deleted in the background
            files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
            names = [files.apply(i).getName().split("_") for i in range(files.size())]
            left = [n for n in names if n[0] == "shuffle" and int(n[1]) > first]
            if not left:
                break
            time.sleep(0.1)
        return left

    rows = spark.range(1000).repartition(3, "id")
    assert shuffled(lambda: write(rows, "test"))
    with groups.freed_shuffles(spark):
        assert not shuffled(lambda: write(rows, "test"))


def test_a_link_that_is_sure_in_one_task_is_sure(spark):
    rows = [(i, 0, (i + j) % 2 == 0) for j in range(2) for i in range(1, 40)] + [(50, 1, False), (50, 1, False)]
    got = {(r["a"], r["b"]): r["sure"] for r in groups.distinct_links(spark.createDataFrame(rows, "a bigint, b bigint, sure boolean")).collect()}
    assert got == {(i, 0): True for i in range(1, 40)} | {(50, 1): False}


def test_many_undecided_pairs_are_handed_on(monkeypatch):
    monkeypatch.setattr(groups, "MOST_UNSURE", 10)
    rng = np.random.default_rng(17)
    x = rng.normal(size=(60, DIM)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    err, ids = np.full(60, 0.1, np.float32), np.arange(100, 160)
    own = [np.arange(0, 40), np.arange(20, 60)]
    got = list(groups.spanning_links(ids, ([o, o] for o in own), (x, err), 0.3))
    s = x @ x.T
    met = {(i, j) for o in own for i in o for j in o if i < j}
    edges = {(b - 100, a - 100) for m, n, sure in got for a, b in zip(m.tolist(), n.tolist()) if sure}
    unsure = {(b - 100, a - 100) for m, n, sure in got for a, b in zip(m.tolist(), n.tolist()) if not sure}
    tree = {b: a for a, b in edges}
    root = [tree.get(i, i) for i in range(60)]
    assert len(got) > 2 and unsure <= met and all(abs(s[p] - 0.3) <= 0.2 + 1e-5 for p in unsure)
    assert all(root[i] == root[j] for i, j in met if s[i, j] >= 0.5 + 1e-5)
    assert all((i, j) in unsure or root[i] == root[j] for i, j in met if abs(s[i, j] - 0.3) < 0.2 - 1e-5)


@pytest.mark.parametrize("n", [500, 4000, 30000])
def test_pairs_at_the_threshold_meet_however_many_anchors(n):
    rng = np.random.default_rng(8)
    anchors = rng.normal(size=(n, 64)).astype(np.float32)
    anchors /= np.linalg.norm(anchors, axis=1, keepdims=True)
    size, bands = groups.fitted_sets(anchors, 0.74)
    x, away = rng.normal(size=(2, 500, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away -= (away * x).sum(1, keepdims=True) * x
    y = 0.74 * x + np.sqrt(1 - 0.74**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
    sets = [np.argsort(-(v @ anchors.T), axis=1)[:, :size] for v in (x, y.astype(np.float32))]
    assert groups.shared_bucket(*sets, groups.hash_orders(n, bands)) >= 0.92
    assert size < 64


def test_sets_are_exact_with_many_anchors():
    rng = np.random.default_rng(11)
    anchors, x = rng.normal(size=(20000, 64)).astype(np.float32), rng.normal(size=(200, 64)).astype(np.float32)
    want = np.sort(np.argsort(-(x @ anchors.T), axis=1)[:, :20], axis=1)
    for block in (7, 8192, 20000):
        assert (np.sort(groups.nearest_anchors(x, anchors, 20, block), axis=1) == want).all()


def test_borderline_pairs_are_decided_on_full_vectors(spark):
    rng = np.random.default_rng(3)
    rows = clustered(rng, [1] * 30 + [12] * 8, 0.6)
    v = usable(rows)
    x = np.array([v[i] for i in sorted(v)])
    x = x - x.mean(0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.sort((x @ x.T)[np.triu_indices(len(x), 1)])
    for k in (-40, -90, -150):
        threshold = float(s[k] + s[k + 1]) / 2  # as near to a similarity as can be
        label, tight, _, _ = brute(rows, threshold)
        got = run(spark, rows, threshold)
        assert {i: r["component"] for i, r in got.items()} == label
        assert {r["component"] for r in got.values() if r["tight"]} == tight


@pytest.mark.parametrize("most", [100_000, 1])
def test_few_undecided_pairs_do_not_shuffle_all_vectors(spark, monkeypatch, most):
    monkeypatch.setattr(groups, "MOST_SENT", most)
    rows = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(10)] + [(3, [1.0, 3.0])], "id bigint, x array<float>")
    pairs = spark.createDataFrame([(2, 1), (3, 2), (9, 0), (3, 2), (50, 1)], "a bigint, b bigint")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = groups.alike_pairs(pairs, rows, np.zeros(2), 2, 0.9)
        semi = [line for line in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "LeftSemi" in line]
        assert semi and all(("BroadcastHashJoin" in line) == (most > 1) for line in semi)
        assert sorted(map(tuple, out.collect())) == [(2, 1), (3, 2)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_codes_keep_their_bounds():
    rng = np.random.default_rng(4)
    for dim in (96, 50, 3):
        x = rng.normal(size=(200, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        codes, scale, err = groups.code(x)
        y = codes * scale[:, None]
        assert (np.abs(x @ x.T - y @ y.T) <= 1.01 * (err[:, None] + err[None, :]) + 1e-6).all()
        y, bound = groups.small_floats(groups.packed(groups.small_codes(x)), dim)
        assert y.shape == x.shape and (np.abs(x @ x.T - y @ y.T) <= bound[:, None] + bound[None, :]).all()
        assert bound.max() < 0.1 or dim == 3


def truth(rows, threshold, typical=3, least=2):
    """Groups, split one medoid after the other, with their most typical members: by brute force."""
    label, tight, near, ids = brute(rows, threshold)
    v = usable(rows)
    x = np.array([v[i] for i in ids])
    x = x - x.mean(0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    place = {i: k for k, i in enumerate(ids)}
    parts = []
    for g in set(label.values()):
        free = sorted(i for i in ids if label[i] == g)
        if g in tight:
            parts.append((free, True))
            continue
        degree = {i: near[place[i], [place[j] for j in free]].sum() for i in free}
        while free:
            m = min(free, key=lambda i: (-degree[i], i))
            own = [i for i in free if i == m or near[place[m], place[i]]]
            parts.append((own, False))
            free = [i for i in free if i not in own]
    out = {}
    for own, is_tight in parts:
        if len(own) >= least:
            at = [place[i] for i in own]
            t = (x[at] @ x[at].T).mean(1)
            out[min(own)] = (len(own), is_tight, [own[k] for k in np.lexsort((own, -np.round(t, 6)))[:typical]])
    return out


@pytest.mark.parametrize(("rows_a_task", "heads"), [(1_000_000, 1024), (2, 1), (2, 3), (2, 1024)])
def test_profiles_equal_brute_force_where_components_are_split(spark, monkeypatch, rows_a_task, heads):
    monkeypatch.setattr(groups, "SPLIT_ROWS", rows_a_task)
    monkeypatch.setattr(groups.split_large, "__defaults__", (heads,))
    monkeypatch.setattr(groups.typicalities, "__defaults__", (rows_a_task,))
    rng = np.random.default_rng(2)
    base = np.linalg.qr(rng.normal(size=(DIM, DIM)))[0]
    rows, n = [], 0
    for k, angles in enumerate(([0, 5, 10, 25, 45, 50, 55, 60, 62, 64, 66], [0, 12, 24, 36, 48, 60, 72, 84], [0, 1, 2, 3])):
        for a in np.deg2rad(angles):
            rows.append((n, (np.cos(a) * base[2 * k] + np.sin(a) * base[2 * k + 1] + 0.02 * rng.normal(size=DIM)).tolist()))
            n += 1
    rows += [(200 + i, (-np.array(v)).tolist()) for i, v in rows]
    want = truth(rows, 0.9)
    assert any(not t for _, t, _ in want.values()) and any(t for _, t, _ in want.values())
    df = spark.createDataFrame(rows + dirty(), ROWS)
    found = groups.similarity_groups(df, 0.9, DIM, bands=16, set_size=14)
    got = {r["group_id"]: (r["n_members"], r["tight"], r["typical_ids"]) for r in groups.group_profiles(found, df, dim=DIM).collect()}
    assert got == want


def test_equal_vectors_count_in_profiles(spark):
    rng = np.random.default_rng(5)
    rows = clustered(rng, [1, 1, 1, 1, 3, 8], 0.1)
    rows += [(900 + i, rows[-1][1]) for i in range(5)]
    df = spark.createDataFrame(rows, ROWS)
    got = {r["group_id"]: (r["n_members"], r["typical_ids"]) for r in groups.group_profiles(groups.similarity_groups(df, 0.7, DIM), df, 2, dim=DIM).collect()}
    assert got == {g: (n, t) for g, (n, _, t) in truth(rows, 0.7, 2).items()}
    assert groups.group_profiles(groups.similarity_groups(df.limit(0), 0.7, DIM), df.limit(0), dim=DIM).count() == 0


def test_every_cluster_of_a_run_has_a_profile(spark):
    rng = np.random.default_rng(13)
    vectors = rng.normal(size=(12, DIM)).astype(np.float32)
    segments = [(i, "u", 10 * i, 10 * i + 10, v.tolist()) for i, v in enumerate(vectors)] + [(50, "u", 500, 510, [0.0] * DIM)]
    members = [(i, 1, 0, "u", 0.2 * i + (0.02 if i % 2 else 0.0), 0.2 * i + 0.2 - (0.04 if i == 3 else 0.0)) for i in range(8)]
    members += [(20 + i, 2, 0, "u", 0.2 * i, 0.2 * i + 0.2) for i in (8, 9)] + [(30, 2, 7, "u", 70.0, 70.5), (31, 2, 9, "u", 10.0, 10.2)]
    members += [(32, 1, 0, "u", 0.05, 0.25), (33, 1, 0, None, 0.0, 0.2), (34, 1, -1, "u", 0.0, 0.2), (35, 1, None, "u", 0.0, 0.2), (36, 2, 5, "u", 2.2, 2.4)]
    s = spark.createDataFrame(segments + segments[:3], "seg_id bigint, utt_id string, start_frame int, end_frame int, features array<float>")
    m = spark.createDataFrame(members + members[:3], "member_id bigint, run_id int, cluster int, utt_id string, start_sec double, end_sec double")
    got = {(r["run_id"], r["cluster"]): (r["n_members"], r["n_segments"], r["typical_ids"]) for r in groups.cluster_profiles(m, s, 3, DIM).collect()}
    x = vectors.astype(float) - vectors.astype(float).mean(0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    typical = (x[:8] @ x[:8].T).mean(1)
    assert got == {(1, 0): (10, 8, np.argsort(-typical)[:3].tolist()), (2, 0): (2, 2, [8, 9]), (2, 5): (1, 1, [11]), (2, 7): (1, 0, []), (2, 9): (1, 0, [])}


def test_empty_and_nothing_usable(spark):
    assert run(spark, []) == {} and run(spark, dirty()) == {}
    got = run(spark, [(3, [1.0] * DIM)])
    assert got[3]["n_members"] == 1
