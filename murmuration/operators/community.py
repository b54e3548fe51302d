"""Partitions of a similarity graph: components, Leiden communities, quality, and the tuning of the resolution."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..arrowtools import by_key, scan_tasks
from ..session import write_table
from .pairs import FOREST_EDGES, spanning_forest

QUALITIES = ("cpm", "modularity", "rb")
#: Edges of a connected component that one task takes; a larger component is shrunk by moves in rounds first.
MAX_EDGES = 2_000_000
MOVE_ROUNDS = 12


def components(vertices: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``seg_id, component`` (the smallest id) of every vertex; infrastructure for the operators here.

    Each task first keeps a spanning forest of its edges, and forests are joined while that makes them much smaller. Then
    labels go along the links that are left, and from a label to its own label, which shortens the way to go by half each round.
    Every round is written to the shared folder.
    """
    own = vertices.select(F.col("seg_id").cast("bigint").alias("seg_id")).distinct()
    links = write_table(spanning_forest(edges), "forest")
    if not links.df.select(F.explode(F.array("src", "dst")).alias("seg_id")).join(own, "seg_id", "left_anti").isEmpty():
        # Nothing is connected by way of an end that is no vertex.
        a, b = own.withColumnRenamed("seg_id", "src"), own.withColumnRenamed("seg_id", "dst")
        links.drop()
        links = write_table(spanning_forest(edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")), "forest")
    n = links.df.count()
    while n > FOREST_EDGES // 4:
        fewer = write_table(spanning_forest(links.df.coalesce(-(-n // FOREST_EDGES))), "forest")
        before, n = n, fewer.df.count()
        links.drop()
        links = fewer
        if n > before // 2:
            break
    both = write_table(links.df.select(F.explode(F.array(F.struct(F.col("src").cast("bigint").alias("a"), F.col("dst").cast("bigint").alias("b")), F.struct(F.col("dst").cast("bigint").alias("a"), F.col("src").cast("bigint").alias("b")))).alias("e")).select("e.*").distinct(), "edges")
    links.drop()
    labels = write_table(own.select("seg_id", F.col("seg_id").alias("component")), "labels")
    if both.df.isEmpty():
        return labels.df
    for _ in range(max_rounds):
        along = both.df.join(labels.df.select(F.col("seg_id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("c"))
        near = labels.df.join(along, F.col("seg_id") == F.col("a"), "left").select("seg_id", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        jump = labels.df.select(F.col("seg_id").alias("component"), F.col("component").alias("further"))
        seen = Observation()
        moved = near.join(jump, "component", "left").select("seg_id", F.least("component", "further").alias("component"), "old").observe(seen, F.count(F.when(F.col("component") != F.col("old"), 1)).alias("moved"))
        following = write_table(moved.select("seg_id", "component", "old"), "labels")
        labels.drop()
        labels = following
        if not seen.get["moved"]:
            both.drop()
            return labels.df.select("seg_id", "component")
        labels.df = labels.df.select("seg_id", "component")
    raise RuntimeError(f"the components are not stable after {max_rounds} rounds")


class Graph:
    """Undirected weighted graph in compressed rows; a node stands for ``size`` vertices and has an inner weight."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, size: np.ndarray, inner: np.ndarray) -> None:
        a, b, v = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([w, w])
        order = np.lexsort((b, a))
        self.n, self.to, self.w = n, b[order], v[order]
        self.at = np.searchsorted(a[order], np.arange(n + 1))
        self.size, self.inner = size, inner
        self.strength = np.bincount(a, v, n) + 2 * inner

    def merged(self, part: np.ndarray) -> Graph:
        """The graph of the parts."""
        k = int(part.max()) + 1
        src = np.repeat(np.arange(self.n), np.diff(self.at))
        keep = src < self.to
        a, b, w = part[src[keep]], part[self.to[keep]], self.w[keep]
        inner = np.bincount(part, self.inner, k) + np.bincount(a[a == b], w[a == b], k)
        lo, hi = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        key, at = np.unique(lo * k + hi, return_inverse=True)
        return Graph(k, key // k, key % k, np.bincount(at, w[a != b], len(key)), np.bincount(part, self.size, k), inner)


class Quality:
    """Gain of joining a node to a community: weight between them less a penalty. ``total`` is the weight of the
    whole graph, of which the component at hand may be a part."""

    def __init__(self, kind: str, resolution: float, total: float) -> None:
        if kind not in QUALITIES:
            raise ValueError(f"quality is one of {QUALITIES}")
        self.by_size = kind == "cpm"
        self.factor = resolution if kind == "cpm" else (resolution if kind == "rb" else 1.0) / max(2 * total, 1e-300)

    def mass(self, g: Graph) -> np.ndarray:
        return g.size.astype(float) if self.by_size else g.strength


def move_nodes(g: Graph, q: Quality, part: np.ndarray, rng: np.random.Generator, max_size: int | None) -> np.ndarray:
    """Fast local moving: nodes wait in a queue; a node that moves puts its neighbours outside back into it."""
    mass = q.mass(g)
    total, size = np.bincount(part, mass, g.n), np.bincount(part, g.size, g.n)
    free = [c for c in range(g.n - 1, -1, -1) if not size[c]]
    queue = rng.permutation(g.n).tolist()
    waiting = np.ones(g.n, bool)
    head = 0
    while head < len(queue):
        v = queue[head]
        head += 1
        waiting[v] = False
        old = int(part[v])
        near = slice(g.at[v], g.at[v + 1])
        to, w = g.to[near], g.w[near]
        total[old] -= mass[v]
        size[old] -= g.size[v]
        links: dict[int, float] = {old: 0.0}
        for c, x in zip(part[to].tolist(), w.tolist()):
            links[c] = links.get(c, 0.0) + x
        best, gain = old, links[old] - q.factor * mass[v] * total[old]
        for c, x in links.items():
            new = x - q.factor * mass[v] * total[c]
            if new > gain + 1e-12 and (max_size is None or size[c] + g.size[v] <= max_size):
                best, gain = c, new
        if gain < -1e-12 and size[old] and free:  # alone is better
            best = free.pop()
        part[v] = best
        total[best] += mass[v]
        size[best] += g.size[v]
        if best != old:
            if not size[old]:
                free.append(old)
            again = to[(part[to] != best) & ~waiting[to]]
            waiting[again] = True
            queue += again.tolist()
    return part


def refine(g: Graph, q: Quality, part: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Within each community, nodes that are alone join a sub-community that they are well connected with; which,
    is drawn at random among those that do not lose."""
    mass = q.mass(g)
    sub = np.arange(g.n)
    total, whole = mass.copy(), np.bincount(part, mass, g.n)
    alone = np.ones(g.n, bool)
    src = np.repeat(np.arange(g.n), np.diff(g.at))
    same = part[src] == part[g.to]
    outer = np.bincount(src[same], g.w[same], g.n)  # weight from a node, later a sub-community, to the rest of its community
    for v in rng.permutation(g.n).tolist():
        if not alone[v] or outer[v] < q.factor * mass[v] * (whole[part[v]] - mass[v]) - 1e-12:
            continue
        near = slice(g.at[v], g.at[v + 1])
        links: dict[int, float] = {}
        for u, x in zip(g.to[near].tolist(), g.w[near].tolist()):
            if part[u] == part[v]:
                links[int(sub[u])] = links.get(int(sub[u]), 0.0) + x
        chances = []
        for c, x in links.items():
            well = outer[c] >= q.factor * total[c] * (whole[part[v]] - total[c]) - 1e-12
            if well and (gain := x - q.factor * mass[v] * total[c]) >= 0:
                chances.append((c, gain, x))
        if not chances:
            continue
        gains = np.array([c[1] for c in chances])
        p = np.exp(np.minimum((gains - gains.max()) / 0.01, 0))
        c, _, x = chances[int(np.searchsorted(np.cumsum(p / p.sum()), rng.random(), side="right").clip(0, len(p) - 1))]
        outer[c] += outer[v] - 2 * x
        total[c] += mass[v]
        sub[v] = c
        alone[v] = alone[c] = False
    return np.unique(sub, return_inverse=True)[1]


def leiden(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, kind: str = "cpm", resolution: float = 0.5, seed: int = 42, max_size: int | None = None, total: float | None = None, rounds: int = 2, size: np.ndarray | None = None, inner: np.ndarray | None = None) -> np.ndarray:
    """Community of each of n vertices by the Leiden algorithm: moving, refining, merging, until nothing changes;
    the whole ``rounds`` times, each from the last result. Every community is connected, unless the resolution is
    negative. A vertex may stand for ``size`` vertices with a weight of ``inner`` among them."""
    size = np.ones(n, np.int64) if size is None else size
    inner = np.zeros(n) if inner is None else inner
    q = Quality(kind, resolution, float(w.sum() + inner.sum()) if total is None else total)
    rng = np.random.default_rng(seed)
    labels = np.arange(n)
    for _ in range(rounds):
        g = Graph(n, src, dst, w, size, inner)
        part, where = labels.copy(), np.arange(n)
        while True:
            part = np.unique(move_nodes(g, q, part, rng, max_size), return_inverse=True)[1]
            labels = part[where]
            if part.max() + 1 == g.n:
                break
            fine = refine(g, q, part, rng)
            if fine.max() + 1 == g.n:  # no refinement: merge the communities themselves
                fine = part
            first = np.zeros(fine.max() + 1, np.int64)
            first[fine] = part
            g, where, part = g.merged(fine), fine[where], first
    return np.unique(labels, return_inverse=True)[1] if n else labels


def best_moves(nodes: DataFrame, edges: DataFrame, factor: float) -> DataFrame:
    """``id, to, gain``: of the nodes ``id, comm, mass`` those that gain by leaving for the community of a neighbour, and the
    best one (ties: the smallest). ``edges`` has both directions, ``a, b, w``. Gains are those of a move alone."""
    total = nodes.groupBy("comm").agg(F.sum("mass").alias("total"), F.count("*").alias("n"))
    near = edges.join(nodes.select(F.col("id").alias("b"), F.col("comm").alias("to")), "b").groupBy("a", "to").agg(F.sum("w").alias("w"))
    own = nodes.join(total, "comm").select("id", "comm", "mass", (F.col("total") - F.col("mass")).alias("rest"), F.col("n").alias("own_n"))
    asked = near.join(own, F.col("a") == F.col("id")).join(total.select(F.col("comm").alias("to"), "total", F.col("n").alias("to_n")), "to")
    value = F.col("w") - F.lit(factor) * F.col("mass") * F.when(F.col("to") == F.col("comm"), F.col("rest")).otherwise(F.col("total"))
    stay = F.coalesce(F.max(F.when(F.col("to") == F.col("comm"), F.col("value"))), F.lit(-factor) * F.first("mass") * F.first("rest"))
    # Of two nodes that are alone only the one with the larger id moves, so that they do not change places.
    free = (F.col("to") != F.col("comm")) & ~((F.col("own_n") == 1) & (F.col("to_n") == 1) & (F.col("to") > F.col("comm")))
    best = F.max(F.when(free, F.struct("value", (-F.col("to")).alias("minus"))))
    found = asked.withColumn("value", value).groupBy("id").agg(stay.alias("stay"), best.alias("best")).where("best is not null and best.value > stay + 1e-12")
    return found.select("id", (-F.col("best.minus")).alias("to"), (F.col("best.value") - F.col("stay")).alias("gain"))


def shrunk(nodes: DataFrame, edges: DataFrame, q: Quality, seed: int, max_size: int | None, rounds: int = MOVE_ROUNDS) -> DataFrame:
    """``id, part``: connected parts of communities that nodes ``id, size, mass`` move to in rounds.

    In a round, a half of the nodes that gain by a move makes it, another half each time, since neighbours that move at once
    do not know of each other. Communities that grow beyond ``max_size`` are dissolved. A part is a connected piece of a
    community, so whatever is made of parts is as connected as they are."""
    state = write_table(nodes.select("id", "size", "mass", F.col("id").alias("comm")), "moving")
    for turn in range(rounds):
        half = F.pmod(F.xxhash64("id", F.lit(seed + turn)), F.lit(2)) == 0
        moves = write_table(best_moves(state.df, edges, q.factor).where(half).select("id", "to"), "moves")
        if moves.df.isEmpty() and turn:
            break
        following = write_table(state.df.join(moves.df, "id", "left").select("id", "size", "mass", F.coalesce("to", "comm").alias("comm")), "moving")
        state.drop()
        moves.drop()
        state = following
    if max_size is not None:
        grown = state.df.groupBy("comm").agg(F.sum("size").alias("grown"))
        state = write_table(state.df.join(grown, "comm").withColumn("comm", F.when(F.col("grown") > max_size, F.col("id")).otherwise(F.col("comm"))), "moving")
    at = state.df.select("id", "comm")
    inside = edges.where("a < b").join(at.select(F.col("id").alias("a"), F.col("comm").alias("ca")), "a").join(at.select(F.col("id").alias("b"), F.col("comm").alias("cb")), "b").where("ca = cb")
    return components(state.df.select(F.col("id").alias("seg_id")), inside.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("seg_id").alias("id"), F.col("component").alias("part"))


def _shrunk_graph(edges: DataFrame, q: Quality, seed: int, max_size: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Large components as graphs of their parts: ``seg_id, node`` of every vertex, the nodes ``id, component, size, inner``
    and edges ``component, src, dst, weight`` between them. They are shrunk until no component has more than ``MAX_EDGES`` edges or
    a level makes the nodes fewer by less than a tenth."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), "component").distinct()
    nodes = write_table(ends.select("id", "component", F.lit(1).cast("bigint").alias("size"), F.lit(0.0).alias("inner")), "nodes").df
    links = write_table(edges.select("component", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight"), "links").df
    where = nodes.select(F.col("id").alias("seg_id"), F.col("id").alias("node"))
    n = nodes.count()
    while not links.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > MAX_EDGES).isEmpty():
        both = write_table(links.select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("w")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("weight").alias("w")))).alias("e")).select("e.*"), "both").df
        strength = both.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("s"))
        mass = F.col("size").cast("double") if q.by_size else F.coalesce("s", F.lit(0.0)) + 2 * F.col("inner")
        weighed = nodes.join(strength, "id", "left").select("id", "size", mass.alias("mass"))
        part = write_table(shrunk(weighed, both, q, seed, max_size), "parts").df
        a, b = part.select(F.col("id").alias("src"), F.col("part").alias("pa")), part.select(F.col("id").alias("dst"), F.col("part").alias("pb"))
        merged = write_table(links.join(a, "src").join(b, "dst").groupBy("component", F.least("pa", "pb").alias("src"), F.greatest("pa", "pb").alias("dst")).agg(F.sum("weight").alias("weight")), "links").df
        within = merged.where("src = dst").select(F.col("src").alias("id"), F.col("weight").alias("more"))
        of_parts = nodes.join(part, "id").groupBy("part").agg(F.first("component").alias("component"), F.sum("size").alias("size"), F.sum("inner").alias("inner"))
        nodes = write_table(of_parts.withColumnRenamed("part", "id").join(within, "id", "left").select("id", "component", "size", (F.col("inner") + F.coalesce("more", F.lit(0.0))).alias("inner")), "nodes").df
        links = merged.where("src <> dst")
        where = write_table(where.join(part.select(F.col("id").alias("node"), "part"), "node").select("seg_id", F.col("part").alias("node")), "where").df
        before, n = n, nodes.count()
        if n > 0.9 * before:
            break
    return where, nodes, links


def leiden_partition(vertices: DataFrame, edges: DataFrame, kind: str = "cpm", resolution: float = 0.5, seed: int = 42, max_size: int | None = None, parts: DataFrame | None = None) -> DataFrame:
    """``seg_id, cluster`` (the smallest id of the community) of every vertex.

    No community spans two connected components, so each component is a task of its own; what a quality needs of
    the whole graph, its total weight, is passed in. A component of more than ``MAX_EDGES`` edges is first shrunk on all
    executors: vertices move in rounds, and connected parts of the communities become the nodes of a smaller graph, which
    the task gets. At a negative resolution CPM also favours joining what is not linked; that is not looked for across
    components. ``parts`` passes known components.
    """
    parts = components(vertices, edges) if parts is None else parts
    total = edges.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w")).first()["w"] if kind != "cpm" else 0.0
    inside = edges.join(parts, F.col("src") == F.col("seg_id")).select("component", "src", "dst", F.col("weight").cast("double").alias("weight"))
    large = write_table(inside.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > MAX_EDGES).select("component"), "large").df
    schema = pa.schema([("seg_id", pa.int64()), ("cluster", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges of a component, and, with the same node at both ends, its size and inner weight where it has any."""
        for batch in by_key(batches):
            a, b, w, n = (batch.column(i).to_numpy() for i in (1, 2, 3, 4))
            ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            at_a, at_b, alone = at[: len(a)], at[len(a) :], a == b
            size, inner = np.ones(len(ids), np.int64), np.zeros(len(ids))
            size[at_a[alone]], inner[at_a[alone]] = n[alone], w[alone]
            label = leiden(len(ids), at_a[~alone], at_b[~alone], w[~alone], kind, resolution, seed, max_size, total if kind != "cpm" else None, size=size, inner=inner)
            first = np.full(label.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(first, label, ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(first[label])], schema=schema)

    few, where = inside.where("src <> dst").withColumn("size", F.lit(1).cast("bigint")), None
    if not large.isEmpty():
        where, nodes, links = _shrunk_graph(write_table(few.join(F.broadcast(large), "component"), "large-edges").df, Quality(kind, resolution, total), seed, max_size)
        stands = nodes.select("component", F.col("id").alias("src"), F.col("id").alias("dst"), F.col("inner").alias("weight"), "size")
        few = few.join(F.broadcast(large), "component", "left_anti").unionByName(links.withColumn("size", F.lit(1).cast("bigint"))).unionByName(stands)
    found = scan_tasks(few, ["component"], ["src", "dst"], find, "seg_id bigint, cluster bigint")
    if where is not None:
        # A part is named by its smallest vertex, and so is a community of parts.
        moved = where.join(found.select(F.col("seg_id").alias("node"), "cluster"), "node").select("seg_id", "cluster")
        found = moved.unionByName(found.join(where.select("seg_id"), "seg_id", "left_anti"))
    alone = vertices.select(F.col("seg_id").cast("bigint").alias("seg_id")).join(edges.where("src <> dst").select(F.explode(F.array("src", "dst")).alias("seg_id")), "seg_id", "left_anti")
    return found.unionByName(alone.select("seg_id", F.col("seg_id").alias("cluster")))


def partition_quality(assignments: DataFrame, edges: DataFrame, kind: str = "cpm", resolution: float = 0.5) -> DataFrame:
    """``quality``, one row. CPM: inner weight less ``resolution * n (n - 1) / 2``, summed over clusters. Modularity
    and rb: inner weight less ``resolution * strength**2 / (4 * total weight)`` (resolution 1 for modularity)."""
    a, b = assignments.select(F.col("seg_id").alias("src"), F.col("cluster").alias("ca")), assignments.select(F.col("seg_id").alias("dst"), F.col("cluster").alias("cb"))
    both = edges.join(a, "src").join(b, "dst")
    inner = both.where("ca = cb").groupBy(F.col("ca").alias("cluster")).agg(F.sum("weight").alias("e"))
    if kind == "cpm":
        sized = assignments.groupBy("cluster").agg(F.count("*").alias("n")).join(inner, "cluster", "left")
        return sized.agg(F.sum(F.coalesce("e", F.lit(0.0)) - F.lit(resolution) * F.col("n") * (F.col("n") - 1) / 2).alias("quality"))
    strength = both.select(F.explode(F.array(F.col("ca"), F.col("cb"))).alias("cluster"), "weight").groupBy("cluster").agg(F.sum("weight").alias("k"))
    total = edges.agg(F.sum("weight").alias("m"))
    factor = resolution if kind == "rb" else 1.0
    joined = strength.join(inner, "cluster", "left").crossJoin(F.broadcast(total))
    return joined.agg(F.sum(F.coalesce("e", F.lit(0.0)) - F.lit(factor) * F.col("k") * F.col("k") / (4 * F.col("m"))).alias("quality"))


def tune(partition: object, target: int, resolution: float = 0.5, max_iter: int = 15, tolerance: int = 5) -> tuple[object, float, list[dict]]:
    """Search the resolution at which ``partition(step, resolution)`` has ``target`` clusters.

    ``partition`` returns (result, number of clusters); ``step`` is 0 for the first call. The step size is 0.1
    times the relative difference, which is clipped to twice the target; it shrinks by a tenth each time, and by
    half after ``tolerance`` results in a row that are no better. The resolution stays within -10 and 10. Returns
    the best result, its resolution and the history. With ``max_iter`` 0 the first result is returned.
    """
    rate, best_diff, patience = 0.1, float("inf"), 0
    result, k = partition(0, resolution)
    best, best_resolution = result, resolution
    history: list[dict] = []
    for i in range(max_iter):
        diff = k - target
        history.append({"iter": i + 1, "resolution": resolution, "clusters": k, "diff": diff})
        if abs(diff) <= tolerance:
            return result, resolution, history
        if abs(diff) < best_diff:
            best, best_resolution, best_diff, patience = result, resolution, abs(diff), 0
        else:
            patience += 1
        if patience >= tolerance:
            rate, patience = rate * 0.5, 0
        step = rate * min(max(diff, -2 * target), 2 * target) / target
        resolution = min(max(resolution - step, -10.0), 10.0)
        rate *= 0.9
        if i + 1 < max_iter:  # the last one would not be looked at
            result, k = partition(i + 1, resolution)
    return best, best_resolution, history


def tuned_partition(vertices: DataFrame, edges: DataFrame, n_clusters: int, kind: str = "cpm", resolution: float = 0.5, max_iter: int = 15, tolerance: int = 5, consistent_quality: bool = False, seed: int = 42) -> tuple[DataFrame, float, list[dict]]:
    """``seg_id, cluster``, the resolution, and the history. The first partition uses ``kind`` and communities of
    at most 1,000; later ones use CPM without a bound, unless ``consistent_quality`` keeps the kind."""
    edge_table = write_table(edges.select("src", "dst", "weight"), "edges")
    parts = write_table(components(vertices, edge_table.df), "components")

    def partition(step: int, gamma: float) -> tuple[DataFrame, int]:
        first = step == 0
        found = write_table(leiden_partition(vertices, edge_table.df, kind if first or consistent_quality else "cpm", gamma, seed, 1000 if first else None, parts.df), "partition").df
        return found, found.select("cluster").distinct().count()

    return tune(partition, n_clusters, resolution, max_iter, tolerance)
