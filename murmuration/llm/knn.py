"""The k most similar vectors of each vector: balanced posting lists, searched by nearest centroids.

* **Lists.** Centroids are fitted by k-means in two steps on a bounded sample; one whose list is too long is split. Every vector
  is posted to the list of its nearest centroid and, near a boundary, to those whose centroid is not much
  farther: whose distance is at most ``store_ratio`` times the smallest.
* **Centroid search** goes through a graph in memory: from pivots to the centroids around them, and along the edges of
  the best of these to further ones. How many pivots it starts with is fitted as well, so that what the graph misses
  does not lower the recall; where directions are too many for a graph to lead anywhere, all centroids are compared.
* **Pruning.** A query searches the lists whose centroid is at most ``query_ratio`` times as far as the nearest. How
  far and how many are widened until a sample of the queries finds the neighbours that all rows hold for it.
  Where all vectors are queries, the posting of a vector to a list serves as its query there as well.
* A list is a task; one with too many rows is cut into blocks, each pair of which is a task, so nothing is left
  out. A task gives the k best for each query, and an aggregation the k best of these.
* Of equal vectors, the ``k + 1`` with the smallest ids are posted; they are the neighbours of all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..arrowtools import by_key, packed, scan_tasks, unpacked
from ..session import write_table
from .vectors import BLOCK_ROWS, centre, hashed, in_blocks, is_usable, unit, usable, vector_rows

#: MAX_LISTS is 50 MB of centroids.
MIN_LISTS, MAX_LISTS = 8, 131_072
#: Vectors a list, on average, until there are MAX_LISTS.
ROWS_PER_LIST = 100
#: Queries whose true neighbours are looked up in all rows, to see how many lists must be searched.
TRIAL_QUERIES = 1024
#: Vectors of the sample for each list, up to MAX_SAMPLE.
SAMPLE_PER_LIST = 8
#: Most vectors of the sample: 400 MB on the driver.
MAX_SAMPLE = 1 << 20


class CentroidGraph:
    """Centroids in cells around pivots, with edges from each centroid to the cells of its nearest centroids.

    A search enters the cells of the nearest pivots and then, from the best centroids found so far, those that their
    edges lead to most often. Every centroid is in one cell, so it can be reached, and none is compared twice.
    ``entries`` is the number of pivots to start with. Where it is half of them or more, as it is until it has been
    fitted, all centroids are compared.
    """

    def __init__(self, centroids: np.ndarray, degree: int = 12, seed: int = 5) -> None:
        self.centroids = centroids
        m = len(centroids)
        self.pivots = balanced_kmeans(centroids, int(np.ceil(np.sqrt(m))), seed=seed) if m else centroids
        self.cell = nearest_rows(centroids, self.pivots)
        self.order = np.argsort(self.cell, kind="stable")
        self.begin = np.searchsorted(self.cell[self.order], np.arange(len(self.pivots) + 1))
        self.members = np.ascontiguousarray(centroids[self.order])
        self.entries = len(self.pivots)
        near = np.concatenate([self._enter(centroids[i : i + 1024], 8, min(degree + 1, m))[0][:, 1:] for i in range(0, m, 1024)]) if m else np.zeros((0, 0), np.int64)
        self.ways = self.cell[np.maximum(near, 0)]

    def search(self, x: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the ``want`` nearest centroids reached, nearest first, and their similarities; -1 where fewer."""
        want = min(want, len(self.centroids))
        if 2 * self.entries >= len(self.pivots):
            return best_rows(np.broadcast_to(np.arange(len(self.centroids)), (len(x), len(self.centroids))), x @ self.centroids.T, want)
        parts = [self._enter(x[i : i + 1024], self.entries, want, max(1, self.entries // 4)) for i in range(0, len(x), 1024)]
        return tuple(np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros((0, want), np.int64), np.zeros((0, want), np.float32))

    def _enter(self, x: np.ndarray, entries: int, want: int, further: int = 0, beam: int = 8) -> tuple[np.ndarray, np.ndarray]:
        n, p = len(x), len(self.pivots)
        first = best_rows(np.broadcast_to(np.arange(p), (n, p)), x @ self.pivots.T, min(entries, p))[0]
        ids, sims = self._visit(x, first, np.ones(first.shape, bool), want)
        if further:
            rows = np.arange(n)[:, None]
            cells = self.ways[np.maximum(ids[:, :beam], 0)].reshape(n, -1)
            votes = np.bincount((rows * p + cells).ravel(), minlength=n * p).reshape(n, p)
            votes[rows, first] = 0
            more = np.argpartition(-votes, min(further, p) - 1, axis=1)[:, :further]
            ids2, sims2 = self._visit(x, more, votes[rows, more] > 0, want)
            ids, sims = best_rows(np.concatenate([ids, ids2], 1), np.concatenate([sims, sims2], 1), want)
        return ids, sims

    def _visit(self, x: np.ndarray, cells: np.ndarray, ok: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """The best centroids of each row's cells: one product a cell, with the rows that enter it."""
        rows, slots = np.nonzero(ok)
        entered = cells[rows, slots]
        order = np.argsort(entered, kind="stable")
        sizes = np.diff(self.begin)
        take = max(1, min(want, int(sizes.max())))
        ids = np.full((len(x), cells.shape[1], take), -1, np.int64)
        sims = np.full(ids.shape, -np.inf, np.float32)
        for group in np.split(order, np.flatnonzero(np.diff(entered[order])) + 1) if len(order) else ():
            c = entered[group[0]]
            own = self.order[self.begin[c] : self.begin[c + 1]]
            s = x[rows[group]] @ self.members[self.begin[c] : self.begin[c + 1]].T
            t = min(take, len(own))
            if not t:
                continue
            top = np.argpartition(-s, t - 1, axis=1)[:, :t] if t < len(own) else np.broadcast_to(np.arange(t), s.shape)
            ids[rows[group], slots[group], :t], sims[rows[group], slots[group], :t] = own[top], np.take_along_axis(s, top, 1)
        return best_rows(ids.reshape(len(x), -1), sims.reshape(len(x), -1), want)


def best_rows(ids: np.ndarray, sims: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` most similar of each row, the best first; -1 where there are fewer."""
    if want < sims.shape[1]:
        top = np.argpartition(-sims, want - 1, axis=1)[:, :want]
        ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    return np.where(np.isfinite(sims), ids, -1), sims


def nearest_rows(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The most similar row of ``c`` for each row of ``x``."""
    return np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def fit_centroids(x: np.ndarray, lists: int, rounds: int = 3, seed: int = 2) -> np.ndarray:
    """Centroids of ``lists`` lists of about the same length, in two steps: parts first, as many as the square root,
    and then within each part as many centroids as it has rows for. So the work grows with the root of the lists."""
    lists = min(lists, len(x))
    parts = int(np.ceil(np.sqrt(lists)))
    if parts < 2:
        return balanced_kmeans(x, lists, rounds, seed)
    coarse = balanced_kmeans(x, parts, rounds, seed)
    own = nearest_rows(x, coarse)
    order = np.argsort(own, kind="stable")
    begin = np.searchsorted(own[order], np.arange(parts + 1))
    ends = np.round(begin * lists / len(x)).astype(int)
    fine = [balanced_kmeans(x[order[begin[i] : begin[i + 1]]], int(ends[i + 1] - ends[i]), rounds, seed + i) for i in range(parts) if ends[i + 1] > ends[i]]
    return np.concatenate(fine)


def balanced_kmeans(x: np.ndarray, lists: int, rounds: int = 3, seed: int = 2) -> np.ndarray:
    """k-means on unit vectors. After each round lists of more than twice the mean length get further centroids
    from among their members, in place of the shortest lists."""
    rng = np.random.default_rng(seed)
    lists = min(lists, len(x))
    c = x[rng.choice(len(x), lists, replace=False)].copy()
    for turn in range(rounds):
        own = nearest_rows(x, c)
        size = np.bincount(own, minlength=lists)
        order = np.argsort(own, kind="stable")
        filled = np.flatnonzero(size)
        sums = np.add.reduceat(x[order], (np.cumsum(size) - size)[filled], axis=0)
        c[filled] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        if turn + 1 < rounds:
            mean = len(x) / lists
            extra = np.repeat(np.arange(lists), np.maximum(np.ceil(size / (2 * mean)).astype(int) - 1, 0))
            short = np.argsort(size, kind="stable")[: len(extra)]
            begin = np.cumsum(size) - size
            for to, of in zip(short.tolist(), extra.tolist()):
                c[to] = x[order[begin[of] + rng.integers(size[of])]]
    return c.astype(np.float32)


def chosen_lists(ids: np.ndarray, sims: np.ndarray, ratio: float) -> np.ndarray:
    """Which of the centroids found lie at most ``ratio`` times as far as the nearest."""
    far = np.sqrt(np.maximum(2.0 - 2.0 * sims, 0.0))
    return (ids >= 0) & ((far <= min(ratio, 1e9) * far[:, :1] + 1e-6) | np.isinf(ratio))


def true_neighbours(rows: DataFrame, ids: np.ndarray, x: np.ndarray, mean: np.ndarray, dim: int, k: int, least: float) -> DataFrame:
    """``q, top``: for the queries, by their place in ``ids``, the k most similar of all rows with their vectors."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, x, mean))
    spare = k + 4  # ids that repeat take up places

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, mean = shared.value
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros((0, dim), np.float32))
        floor = np.full(len(ids), least, np.float32)
        for batch in batches:
            for begin in range(0, batch.num_rows, 2048):
                part = batch.slice(begin, 2048)
                at, y = usable(part.column(1), dim)
                if not len(at):
                    continue
                own, y = part.column(0).to_numpy()[at], unit(y, mean).astype(np.float32)
                s = y @ x.T
                s[own[:, None] == ids[None, :]] = -9
                if len(y) > spare and np.isin(floor, np.float32(least)).any():  # else all rows would pass
                    floor = np.maximum(floor, np.partition(s, len(y) - spare, axis=0)[len(y) - spare])
                r, c = np.nonzero(s >= floor)
                q, n, sims = (np.concatenate(pair) for pair in zip(found, (c, own[r], s[r, c])))
                v, source = np.concatenate([found[3], y]), np.append(np.arange(len(found[0])), len(found[0]) + r)
                order = np.lexsort((n, -sims, q))
                start = np.searchsorted(q[order], np.arange(len(ids)))
                keep = order[np.arange(len(order)) - start[q[order]] < spare]
                found = (q[keep], n[keep], sims[keep], v[source[keep]])
                count = np.bincount(found[0], minlength=len(ids))
                lowest = np.full(len(ids), np.inf, np.float32)
                np.minimum.at(lowest, found[0], found[2])
                floor = np.where(count >= spare, np.maximum(floor, lowest), floor)
        yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), pa.array(found[2].astype(np.float64)), packed(found[3])], names=["q", "neighbour", "s", "x"])

    near = rows.select("id", "x").mapInArrow(best, "q bigint, neighbour bigint, s double, x binary")
    return near.groupBy("q").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("s")).alias("s"), "neighbour", "x"))), 1, k).alias("top"))


def hard_queries(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Which of the neighbours (query ``q``, similarity ``s``) are those of the fifth of queries with the farthest ones."""
    asked, at = np.unique(q, return_inverse=True)
    far = np.full(len(asked), np.inf)
    np.minimum.at(far, at, s)
    return np.isin(at, np.argsort(far, kind="stable")[: -(-len(asked) // 5)])


def fitted_search(graph: CentroidGraph, x: np.ndarray, q: np.ndarray, s: np.ndarray, y: np.ndarray, store_ratio: float, most_stored: int, query_ratio: float, most_searched: int, recall: float) -> tuple[float, int]:
    """The ratio and number of lists, at least those given, with which the queries ``x[q]`` find their true neighbours
    ``y`` of similarities ``s`` at ``recall``, both in all and for the fifth with the farthest neighbours, if all
    centroids are compared."""
    lists = len(graph.centroids)
    hard = hard_queries(q, s)
    place = np.full((len(q), most_stored), lists)
    times = np.full((len(q), most_stored), np.inf)
    for begin in range(0, len(q), 256):
        cut = slice(begin, begin + 256)
        kept, sims = graph.search(y[cut], most_stored)
        stored = chosen_lists(kept, sims, store_ratio)
        to = np.sqrt(np.maximum(2.0 - 2.0 * (x[q[cut]] @ graph.centroids.T), 0.0))
        rank = np.empty(to.shape, np.int64)
        np.put_along_axis(rank, np.argsort(to, axis=1, kind="stable"), np.arange(lists)[None, :], 1)
        for out, value, missing in ((place, rank, lists), (times, to / np.maximum(to.min(1, keepdims=True), 1e-6), np.inf)):
            out[cut, : kept.shape[1]] = np.where(stored, np.take_along_axis(value, np.maximum(kept, 0), 1), missing)
    while most_searched < lists:
        found = ((place < most_searched) & (times <= query_ratio)).any(1)
        if not len(q) or min(found.mean(), found[hard].mean()) >= recall:
            return query_ratio, most_searched
        query_ratio, most_searched = query_ratio * 1.02, most_searched + max(1, most_searched // 5)
    return np.inf, lists


def fitted_entries(graph: CentroidGraph, x: np.ndarray, q: np.ndarray, s: np.ndarray, y: np.ndarray, store_ratio: float, most_stored: int, query_ratio: float, most_searched: int, recall: float) -> int:
    """For how many pivots a search through the graph must start, so that the queries find their true neighbours at
    ``recall`` as in ``fitted_search``, although some lists are missed; all of them where half would not do."""
    hard, every = hard_queries(q, s), graph.entries
    entries = 1
    while 2 * entries < len(graph.pivots) and len(q):
        graph.entries = entries
        found = np.zeros(len(q), bool)
        asked, a = graph.search(x, most_searched)
        asked = np.where(chosen_lists(asked, a, query_ratio), asked, -1)
        for begin in range(0, len(q), 256):
            cut = slice(begin, begin + 256)
            kept, k = graph.search(y[cut], most_stored)
            kept = np.where(chosen_lists(kept, k, store_ratio), kept, -2)
            found[cut] = (kept[:, :, None] == asked[q[cut]][:, None, :]).any((1, 2))
        # Three more misses than there were are not unlikely: few known neighbours do not prove that a narrow search is enough.
        if min((f.sum() - 3) / len(f) for f in (found, found[hard])) >= recall:
            return entries
        entries += max(1, entries // 3)
    graph.entries = every
    return every


def search_block(ids: np.ndarray, x: np.ndarray, query: np.ndarray, stored: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, neighbour row, similarity) of the k best stored rows of each query row; ties: smallest id."""
    out: list[tuple[np.ndarray, ...]] = []
    stored = stored[np.argsort(ids[stored], kind="stable")]
    take = min(k + 1, len(stored))
    if not take:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for begin in range(0, len(query), 1024):
        q = query[begin : begin + 1024]
        s = x[q] @ x[stored].T
        # The (k+1)-th largest, less rounding: all at least as similar are ranked by their exact similarity.
        floor = np.maximum(np.partition(s, len(stored) - take, axis=1)[:, len(stored) - take] - 2e-6, np.float32(least - 2e-6))
        r, c = np.nonzero(s >= floor[:, None])
        keep = ids[q[r]] != ids[stored[c]]
        r, c = r[keep], c[keep]
        exact = np.concatenate([np.einsum("ij,ij->i", x[q[r[i : i + 65536]]].astype(np.float64), x[stored[c[i : i + 65536]]].astype(np.float64)) for i in range(0, len(r), 65536)]) if len(r) else np.zeros(0)
        order = np.lexsort((ids[stored[c]], -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        start = np.searchsorted(r, np.arange(len(q)))
        keep = (np.arange(len(r)) - start[r] < k) & (exact >= least)
        out.append((q[r[keep]], stored[c[keep]], exact[keep]))
    return tuple(np.concatenate(parts) for parts in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def nearest_vectors(segments: DataFrame, k: int = 5, min_similarity: float = -1.0, queries: str | None = None, dim: int = 96, id_col: str = "seg_id", vector_col: str = "features", store_ratio: float = 1.25, query_ratio: float = 1.25, most_stored: int = 6, most_searched: int = 6, block_rows: int = BLOCK_ROWS, recall: float = 0.95) -> DataFrame:
    """``id, neighbour, similarity, place`` (1 to k) of the k most similar vectors of each query.

    A vector is usable if it has ``dim`` elements, all non-null and finite and not all zero; other rows, and rows
    with a null id, take no part, and an id that repeats counts once. The mean of all usable vectors is
    subtracted; similarity is the cosine of the results. Queries are all usable vectors, or those for which the
    SQL condition ``queries`` on ``id`` holds; all usable vectors are searched. Neighbours with less than
    ``min_similarity`` are left out, before they are shuffled. Of equally similar vectors the smaller ids come
    first. Empty tables give an empty result, and a query without neighbours no row; other columns are not read.

    The search is approximate: a neighbour is found if its lists (at most ``most_stored``) and the query's (at most
    ``most_searched``) have one in common. ``query_ratio`` and ``most_searched`` are the least that is searched: both
    are widened, up to all lists, until a sample of the queries finds the share ``recall`` of its true neighbours,
    also where these are farthest; then the search of centroids is narrowed as far as that share allows. What is found
    has its exact similarity.
    """
    rows = vector_rows(segments, id_col, vector_col)
    mean, n = centre(rows, dim)
    lists = int(np.clip(n // ROWS_PER_LIST, MIN_LISTS, MAX_LISTS))
    wanted = min(SAMPLE_PER_LIST * lists, MAX_SAMPLE)
    share = min(1.0, wanted / max(n, 1))
    sample = rows.where(F.pmod(hashed("id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * wanted).select("x").toArrow()
    fitted = unit(np.unique(usable(sample["x"].combine_chunks(), dim)[1], axis=0), mean).astype(np.float32) if sample.num_rows else np.zeros((0, dim), np.float32)
    if not len(fitted):
        fitted = np.eye(1, dim, dtype=np.float32)
    centroids = fit_centroids(fitted, lists)
    graph = CentroidGraph(centroids)

    # Equal vectors beyond the first k + 1.
    keyed = rows.where(F.size("x") == dim).withColumn("h", F.xxhash64("x"))
    counts = keyed.select("id", "h").distinct().groupBy("h").agg(F.count("*").alias("n"))
    hot = write_table(counts.where(F.col("n") > k + 1).select("h"), "hot-vectors")
    surplus = None
    if not hot.df.isEmpty():
        among = keyed.join(hot.df, "h").where(is_usable("x")).select("id", "h").distinct()
        first = write_table(among.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("id"))).where(F.col("r") <= k + 1), "first-copies")
        surplus = write_table(among.join(first.df.select("id"), "id", "left_anti"), "surplus-copies")
        rows = rows.join(surplus.df.select("id"), "id", "left_anti")
    asked = F.expr(f"coalesce({queries}, false)") if queries else F.lit(True)
    if most_searched < len(centroids):
        picked = rows.where(asked & (F.size("x") == dim)).where(is_usable("x")).orderBy(hashed("id"), "id").limit(TRIAL_QUERIES).toArrow()
        at, trial = usable(picked["x"].combine_chunks(), dim) if picked.num_rows else (np.zeros(0, np.int64), np.zeros((0, dim)))
        trial = unit(trial, mean).astype(np.float32)
        ids = picked["id"].to_numpy()[at] if len(at) else np.zeros(0, np.int64)
        near = true_neighbours(rows, ids, trial, mean, dim, k, min_similarity).select("q", F.explode("top").alias("t")).select("q", (-F.col("t.s")).alias("s"), "t.x").toArrow() if len(at) else None
        if near is not None and near.num_rows:
            known = (trial, near["q"].to_numpy(), near["s"].to_numpy(), unpacked(near["x"].combine_chunks(), np.float32, dim))
            query_ratio, most_searched = fitted_search(graph, *known, store_ratio, most_stored, query_ratio, most_searched, recall)
            graph.entries = fitted_entries(graph, *known, store_ratio, most_stored, query_ratio, most_searched, recall)
    shared = rows.sparkSession.sparkContext.broadcast((mean, graph))
    schema = pa.schema([("list", pa.int32()), ("id", pa.int64()), ("role", pa.int32()), ("x", pa.binary())])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, graph = shared.value
        step = int(np.clip((1 << 23) // (len(graph.centroids) if 2 * graph.entries >= len(graph.pivots) else 1), 64, 4096))
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                at, x = usable(part.column(1), dim)
                if not len(at):
                    continue
                x = unit(x, mean).astype(np.float32)
                asks = part.column(2).to_numpy(zero_copy_only=False)[at].astype(bool)
                # Only queries are compared with more lists than they are stored in.
                for some, want in ((np.flatnonzero(asks), max(most_stored, most_searched)), (np.flatnonzero(~asks), most_stored)):
                    if not len(some):
                        continue
                    found, sims = graph.search(x[some], want)
                    place = np.arange(found.shape[1])
                    store = chosen_lists(found, sims, store_ratio) & (place < most_stored)
                    ask = chosen_lists(found, sims, query_ratio) & (place < most_searched) & asks[some][:, None]
                    r, c = np.nonzero(store | ask)
                    role = store[r, c] + 2 * ask[r, c]
                    yield pa.RecordBatch.from_arrays([pa.array(found[r, c].astype(np.int32)), part.column(0).take(pa.array(at[some[r]])), pa.array(role.astype(np.int32)), packed(x[some[r]])], schema=schema)

    postings = rows.select("id", "x", asked.alias("asks")).mapInArrow(post, "list int, id bigint, role int, x binary")
    tasks = in_blocks(postings, "list", "id", block_rows=block_rows).select("list", "lo", "hi", "block", "id", "role", "x")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_key(batches, 3):
            ids, at = np.unique(batch.column(4).to_numpy(), return_index=True)
            role = batch.column(5).to_numpy()[at]
            x = unpacked(batch.column(6), np.float32, dim)[at]
            ask, kept = np.flatnonzero(role & 2), np.flatnonzero(role & 1)
            lo, hi = batch.column(1)[0].as_py(), batch.column(2)[0].as_py()
            if lo == hi:
                halves = [(ask, kept)]
            else:
                block = batch.column(3).to_numpy()[at]
                halves = [(ask[block[ask] == a], kept[block[kept] == b]) for a, b in ((lo, hi), (hi, lo))]
            for some, others in halves:
                if len(some) and len(others):
                    q, m, s = search_block(ids, x, some, others, k, min_similarity)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(ids[m]), pa.array(s)], names=["id", "neighbour", "similarity"])

    best = scan_tasks(tasks, ["list", "lo", "hi"], ["id"], search, "id bigint, neighbour bigint, similarity double")
    # At most k rows a list and query: the group is bounded by the lists that a query searches.
    top = best.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("similarity")).alias("s"), F.col("neighbour").alias("neighbour")))), 1, k).alias("top"))
    out = top.select("id", F.posexplode("top").alias("place", "t")).select("id", "t.neighbour", (-F.col("t.s")).alias("similarity"), (F.col("place") + 1).alias("place"))
    if surplus is not None:
        extra = surplus.df.where(asked).join(first.df.where(F.col("r") <= k).select("h", F.col("id").alias("neighbour"), F.col("r").alias("place")), "h")
        out = out.unionByName(extra.select("id", "neighbour", F.lit(1.0).alias("similarity"), "place"))
    return out


def similar_pairs(segments: DataFrame, k: int = 5, min_similarity: float = 0.97, **options: object) -> DataFrame:
    """``id_a, id_b, similarity`` with ``id_a < id_b``: pairs of at least ``min_similarity`` of which one is among
    the other's k most similar vectors, as ``nearest_vectors`` finds them. Of more than ``k + 1`` equal vectors the
    pairs are those with the first of them, so copies are not expanded into all pairs."""
    near = nearest_vectors(segments, k, min_similarity, **({"recall": 0.99} | options))
    return near.groupBy(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).agg(F.max("similarity").alias("similarity"))
