"""Similarity graphs: all pairs of vectors or of unit sequences that are similar enough.

Both joins are exact. Rows are cut into blocks by a hash of the id, and each pair of blocks is a task of bounded
size: cosines of two blocks are one matrix product, and what leaves a task are the pairs that pass.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrowtools import by_key, matrix, scan_tasks
from ..functions import arrays
from ..session import write_table

#: Most vectors of a block: two of them are a task, at 96 dimensions 100 MB. Each vector is copied once a block.
BLOCK_ROWS = 65_536
#: Rows and columns of one matrix product, whose result stays in a core's cache.
TILE = (256, 512)
#: Cost of a candidate pair that is looked at in double precision, in dimensions of the matrix product.
PAIR_COST = 2000.0
#: Edges of which a task keeps a spanning forest at once.
FOREST_EDGES = 4_000_000
#: Most partitions for the pairs of blocks.
MAX_PARTS = 4096
#: Most sequences of a block of the edit join, whose bags take 1 KB each.
BLOCK_SEQUENCES = 16_384
#: Buckets for the units of a sequence, for a bound of what two sequences share; sequences after which they are filled, and
#: most features (a unit and the number of its occurrence) that get a bucket by that.
BAG_DIMS, SAMPLED_TEXTS, MAX_FEATURES = 128, 20_000, 65_536


def block_pairs(rows: DataFrame, id_col: str, n_blocks: int) -> DataFrame:
    """``rows`` with ``lo, hi, block``: each row goes to the ``n_blocks`` tasks in which it meets the others."""
    own = F.pmod(F.xxhash64(F.lit(17), F.col(id_col)), F.lit(n_blocks)).cast("int")
    spread = rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    return spread.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other")


def block_count(n: int, spark: SparkSession, block_rows: int) -> int:
    """Blocks of at most ``block_rows`` rows: no more than that takes, since every row is copied once a block, but
    enough that the pairs of blocks keep all cores busy."""
    busy = int(np.ceil(np.sqrt(4 * spark.sparkContext.defaultParallelism)))
    return max(1, -(-n // block_rows), min(busy, -(-n // 1024)))


def _cosine_tasks(vectors: DataFrame, block_rows: int) -> tuple[DataFrame, int]:
    """``lo, hi, block, seg_id, x``: the vectors with packed doubles, each in the tasks in which it meets the others; and the
    number of partitions."""
    rows = vectors.where("seg_id is not null and x is not null").select(F.col("seg_id").cast("bigint").alias("seg_id"), F.col("x").cast("array<double>").alias("x"))
    n_blocks = block_count(rows.count(), vectors.sparkSession, block_rows)
    return block_pairs(rows, "seg_id", n_blocks).select("lo", "hi", "block", "seg_id", "x"), task_parts(n_blocks)


def task_parts(n_blocks: int) -> int:
    """Partitions for the pairs of blocks: twice as many, so that few get two of them."""
    return min(n_blocks * (n_blocks + 1), MAX_PARTS)


def leading_dims(x: np.ndarray, y: np.ndarray, min_similarity: float) -> int:
    """How many leading dimensions decide most pairs at the least cost, by a sample of two sets of vectors."""
    dim = x.shape[1]
    a, b = (v[np.linspace(0, len(v) - 1, min(len(v), 256)).astype(np.int64)] for v in (x, y))
    if dim < 16 or len(a) < 64 or len(b) < 64:
        return dim
    costs = {dim: dim + PAIR_COST * float((a @ b.T >= min_similarity).mean())}
    for k in range(dim // 4, dim, max(1, dim // 12)):
        rest = np.linalg.norm(a[:, k:], axis=1)[:, None] * np.linalg.norm(b[:, k:], axis=1)[None, :]
        costs[k] = k + 1 + PAIR_COST * float((a[:, :k] @ b[:, :k].T + rest >= min_similarity).mean())
    return min(costs, key=costs.get)


def _single(x: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` dimensions in single precision, and the length of the rest as one more."""
    if k == x.shape[1]:
        return x.astype(np.float32)
    return np.concatenate([x[:, :k], np.linalg.norm(x[:, k:], axis=1, keepdims=True)], axis=1, dtype=np.float32, casting="same_kind")


def _tiled(x: np.ndarray, left: np.ndarray, right: np.ndarray, min_similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of ``left`` and of ``right`` whose product is at least ``min_similarity``, and the products; of one block with
    itself each pair once. Products in single precision, of the leading dimensions and the lengths of the rest, are upper
    bounds but for their rounding; what they let pass is decided in double precision."""
    same = left is right
    dim = x.shape[1]
    k = leading_dims(x[left], x[right], min_similarity)
    a = _single(x[left], k)
    b = a if same else _single(x[right], k)
    longest = [float(np.sqrt(np.einsum("ij,ij->i", v, v).max(initial=0.0))) for v in (a, b)]
    least = np.float32(min_similarity - (dim + 16) * 2.0**-23 * longest[0] * longest[1] - abs(min_similarity) * 2.0**-22)
    high, wide = TILE
    columns = [np.ascontiguousarray(b[at : at + wide].T) for at in range(0, len(b), wide)]
    for begin in range(0, len(a), high):
        rows = a[begin : begin + high]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n, column in enumerate(columns):
            at = n * wide
            if same and at + column.shape[1] <= begin:
                continue
            hit = np.flatnonzero(rows @ column >= least)
            if not len(hit):
                continue
            r, c = np.divmod(hit, column.shape[1])
            i, j = left[begin + r], right[at + c]
            if len(hit) > rows.shape[0] * column.shape[1] // 16:
                s = (x[left[begin : begin + high]] @ x[right[at : at + wide]].T)[r, c]
            else:
                s = np.einsum("ij,ij->i", x[i], x[j])
            keep = s >= min_similarity
            if same:
                keep &= begin + r < at + c
            found.append((i[keep], j[keep], s[keep]))
        if found:
            yield tuple(np.concatenate(v) for v in zip(*found))


def _products(x: np.ndarray, left: np.ndarray, right: np.ndarray, min_similarity: float, swap_last_two: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``_tiled`` for vectors of any length, all in double precision."""
    other = np.concatenate([x[right, :-2], x[right, -1:], x[right, -2:-1]], axis=1) if swap_last_two else x[right]
    rows = int(np.clip((1 << 22) // max(len(right), 1), 16, 1024))
    for begin in range(0, len(left), rows):
        s = x[left[begin : begin + rows]] @ other.T
        keep = s >= min_similarity
        if left is right:
            keep &= np.arange(begin, begin + len(s))[:, None] < np.arange(len(right))[None, :]
        r, c = np.nonzero(keep)
        yield left[begin + r], right[c], s[r, c]


def _similar(batches: Iterator[pa.RecordBatch], min_similarity: float, swap_last_two: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each strip of a task its ids, and the pairs that pass: places in the ids, and products."""
    for batch in by_key(batches, 2):
        lo, hi = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
        sizes = np.diff(batch.column(4).offsets.to_numpy())
        at, x = matrix(batch.column(4), int(sizes.max()))
        ids, block = batch.column(3).to_numpy()[at], batch.column(2).to_numpy()[at]
        left = np.flatnonzero(block == lo)
        right = left if lo == hi else np.flatnonzero(block == hi)
        if not len(left) or not len(right):
            continue
        plain = not swap_last_two and float(np.abs(x).max()) < 2
        for i, j, s in _tiled(x, left, right, min_similarity) if plain else _products(x, left, right, min_similarity, swap_last_two):
            if lo == hi:
                keep = ids[i] != ids[j]
                i, j, s = i[keep], j[keep], s[keep]
            yield ids, i, j, s


def cosine_edges(vectors: DataFrame, min_similarity: float = 0.5, block_rows: int = BLOCK_ROWS, swap_last_two: bool = False) -> DataFrame:
    """``src, dst, weight`` with ``src < dst``: pairs whose inner product is at least ``min_similarity``.

    ``vectors``: ``seg_id, x``, expected to be of length 1, all of one dimension; rows with a null id, or a vector
    that is null or has elements that are null or not finite, take no part. Ids are unique. The comparison is
    made in double precision. With ``swap_last_two`` the last two elements of one side change places, which makes
    the product a squared distance for vectors that are prepared for it.
    """
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("weight", pa.float64())])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, i, j, s in _similar(batches, min_similarity, swap_last_two):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j])), pa.array(s)], schema=schema)

    tasks, parts = _cosine_tasks(vectors, block_rows)
    return scan_tasks(tasks, ["lo", "hi"], ["seg_id"], edges, "src bigint, dst bigint, weight double", parts)


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest place of each tree) after the links ``a, b`` between places."""
    while len(a):
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
    return label


def _links(ids: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    tree = np.flatnonzero(label != np.arange(len(ids)))
    a, b = ids[tree], ids[label[tree]]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["src", "dst"])


def cosine_links(vectors: DataFrame, min_similarity: float = 0.5, block_rows: int = BLOCK_ROWS, swap_last_two: bool = False) -> DataFrame:
    """``src, dst`` with ``src < dst``: links with the connected components of ``cosine_edges``, without its edges. All pairs
    are compared, and each task keeps a spanning forest of those that pass, at most a link a row."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray] | None = None
        for ids, i, j, _ in _similar(batches, min_similarity, swap_last_two):
            if held is None or held[0] is not ids:
                if held is not None:
                    yield _links(*held)
                held = (ids, np.arange(len(ids)))
            held = (ids, join_labels(held[1], i, j))
        if held is not None:
            yield _links(*held)

    tasks, parts = _cosine_tasks(vectors, block_rows)
    return scan_tasks(tasks, ["lo", "hi"], ["seg_id"], link, "src bigint, dst bigint", parts)


def spanning_forest(edges: DataFrame, most: int = FOREST_EDGES) -> DataFrame:
    """``src, dst``: links with the same ends and connected components as the edges. A task holds at most some ``most`` edges
    and keeps a forest of them whenever it has so many. Ends that are null, and edges from a vertex to itself, do not count."""

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def kept() -> pa.RecordBatch:
            a, b = (np.concatenate([h.column(n).to_numpy() for h in held]) for n in (0, 1))
            ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            return _links(ids, join_labels(np.arange(len(ids)), at[: len(a)], at[len(a) :]))

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= most:
                held = [kept()]
                rows = held[0].num_rows
                if rows > most // 2:  # as many links as edges: they go on, and the next pass is left to the rounds
                    yield held[0]
                    held, rows = [], 0
        if rows:
            yield kept()

    return edges.where("src <> dst").select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")).mapInArrow(forest, "src bigint, dst bigint")


def cosine_degrees(vectors: DataFrame, min_similarity: float = 0.5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``seg_id, degree, strength`` of every vector in the graph of ``cosine_edges``, without its edges: each task counts
    those of its own rows, so what is shuffled is a row for each vector and task."""
    schema = pa.schema([("seg_id", pa.int64()), ("degree", pa.int64()), ("strength", pa.float64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for ids, i, j, s in _similar(batches, min_similarity):
            if held is None or held[0] is not ids:
                if held is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in held], schema=schema)
                held = (ids, np.zeros(len(ids), np.int64), np.zeros(len(ids)))
            for end in (i, j):
                held[1][:] += np.bincount(end, minlength=len(ids))
                held[2][:] += np.bincount(end, s, len(ids))
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in held], schema=schema)

    tasks, parts = _cosine_tasks(vectors, block_rows)
    counted = scan_tasks(tasks, ["lo", "hi"], ["seg_id"], count, "seg_id bigint, degree bigint, strength double", parts)
    return counted.groupBy("seg_id").agg(F.sum("degree").alias("degree"), F.sum("strength").alias("strength"))


def feature_buckets(texts: list[str], dims: int = BAG_DIMS) -> dict[int, int]:
    """A bucket for each frequent feature (character and number of its occurrence, as one number) of the texts, so that all
    buckets are about as full: frequent features share theirs with rare ones at most."""
    _, key = _features(texts)
    names, counts = np.unique(key, return_counts=True)
    order = np.argsort(-counts, kind="stable")[:MAX_FEATURES]
    load = [(0, b) for b in range(dims)]
    out: dict[int, int] = {}
    for f, n in zip(names[order].tolist(), counts[order].tolist()):
        full, b = heapq.heappop(load)
        out[f] = b
        heapq.heappush(load, (full + n, b))
    return out


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each character of the texts its text, and the character and how often it came before in it, as one number."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), length)
    char = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64) if len(owner) else owner
    order = np.lexsort((char, owner))
    owner, char = owner[order], char[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (char[1:] != char[:-1]))[: len(char)]
    at = np.arange(len(char))
    return owner, char << 32 | (at - np.maximum.accumulate(np.where(new, at, 0)))


def bags(texts: list[str], buckets: tuple[np.ndarray, np.ndarray], dims: int = BAG_DIMS) -> np.ndarray:
    """How many features of each text are in each bucket; ``buckets`` are the known features, sorted, and theirs, others are
    hashed. What two texts share is at most the sum of the lesser number of each bucket."""
    owner, key = _features(texts)
    bucket = (key * 2654435761 + (key >> 32) * 40503 >> 7) % dims
    known, to = buckets
    if len(known):
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        bucket = np.where(known[at] == key, to[at], bucket)
    return np.bincount(owner * dims + bucket, minlength=len(texts) * dims).reshape(len(texts), dims)


def _length_tasks(texts: DataFrame, block_rows: int, min_ratio: float) -> tuple[DataFrame, int]:
    """``task, block, id, t``: texts in blocks of similar lengths, each in the tasks in which it meets the others of lengths
    that may be a pair's (``min_ratio`` of the longer one at least); and the number of tasks. ``block`` is 0 for the block
    of the shorter ones."""
    by_length = {r["n"]: r["rows"] for r in texts.groupBy(F.length("t").alias("n")).agg(F.count("*").alias("rows")).collect()}
    total = sum(by_length.values())
    size = -(-max(total, 1) // block_count(total, texts.sparkSession, block_rows))
    # A block has whole lengths, or a length is cut into several blocks by a hash of the id.
    blocks: list[tuple[int, int]] = []
    placed: dict[int, tuple[int, int]] = {}  # length: its first block and how many it has
    filled = 0
    for n in sorted(by_length):
        rows = by_length[n]
        if blocks and filled + rows <= size:
            blocks[-1] = (blocks[-1][0], n)
            placed[n] = (len(blocks) - 1, 1)
            filled += rows
            continue
        parts = -(-rows // size)
        placed[n] = (len(blocks), parts)
        blocks += [(n, n)] * parts
        filled = rows if parts == 1 else size
    meet: list[list[tuple[int, int]]] = [[] for _ in blocks]
    n_tasks = 0
    for lo in range(len(blocks)):
        for hi in range(lo, len(blocks)):
            if blocks[lo][1] >= min_ratio * blocks[hi][0] - 1e-9:
                meet[lo].append((n_tasks, 0))
                if lo != hi:
                    meet[hi].append((n_tasks, 1))
                n_tasks += 1
    spark = texts.sparkSession
    lengths = spark.createDataFrame([(n, *p) for n, p in placed.items()], "n int, first int, parts int")
    tasks = spark.createDataFrame([(b, t, side) for b, m in enumerate(meet) for t, side in m], "own int, task int, block int")
    at = texts.withColumn("n", F.length("t")).join(F.broadcast(lengths), "n").withColumn("own", F.col("first") + F.pmod(F.xxhash64(F.lit(17), "id"), F.col("parts")).cast("int"))
    return at.join(F.broadcast(tasks), "own").select("task", "block", "id", "t"), n_tasks


def _sharing(short: list[np.ndarray], long: list[np.ndarray], length: np.ndarray, same: bool, min_similarity: float, min_ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of a shorter (or as long) and a longer text that may share ``min_similarity`` of the longer one's characters.
    ``short`` and ``long``: numbers of features in each bucket and lengths. The product of the roots of two numbers is at least
    the lesser, so a matrix product bounds what is shared; what it lets pass is looked at bucket by bucket."""
    root = [np.sqrt(b[0], dtype=np.float32) for b in (short, long)]
    need = (min_similarity * long[1] - 1e-3).astype(np.float32)
    least = np.float32(0.9999 if min_similarity > 0.01 else -1)  # where nothing need be shared, all pairs pass
    scaled = root[1] / np.maximum(need, np.float32(1e-3))[:, None]
    high, wide = TILE
    columns = [np.ascontiguousarray(scaled[at : at + wide].T) for at in range(0, len(scaled), wide)]
    for begin in range(0, len(root[0]), high):
        rows = root[0][begin : begin + high]
        for n, column in enumerate(columns):
            at = n * wide
            if same and at + column.shape[1] <= begin:
                continue
            hit = np.flatnonzero(rows @ column >= least)
            if not len(hit):
                continue
            i, j = np.divmod(hit, column.shape[1])
            i, j = i + begin, j + at
            keep = short[1][i] >= min_ratio * long[1][j] - 1e-9
            if same:
                keep &= i < j
            i, j = i[keep], j[keep]
            shared = np.minimum(short[0][i], long[0][j]).sum(1, dtype=np.int32)
            keep = shared >= need[j]
            if keep.any():
                yield i[keep], j[keep]


def edit_edges(sequences: DataFrame, min_similarity: float = 0.5, length_filter: str = "reference", block_rows: int = BLOCK_SEQUENCES) -> DataFrame:
    """``src, dst, weight`` with ``src < dst``: pairs with ``1 - distance / longer length >= min_similarity``.

    ``sequences``: ``seg_id, units``; null sequences take no part, null elements are left out. Two empty sequences
    are no pair, nor is an empty one with another. ``length_filter``: ``"reference"`` also drops pairs whose
    lengths differ by more than ``min_similarity`` of the longer one, ``"lossless"`` only those that cannot pass.
    The two agree at 0.5. Equal sequences are compared once and expanded at the end.

    A distance is at least the longer length less the number of units that both share. That number has an upper
    bound by a matrix product of bags of units, taken for two blocks of sequences at a time, of lengths that may be a
    pair's; only pairs that it lets pass get their distance, which is computed in the JVM. No pair is lost.
    """
    if length_filter not in ("reference", "lossless"):
        raise ValueError("length_filter is 'reference' or 'lossless'")
    rows = sequences.where("seg_id is not null and units is not null").select(F.col("seg_id").cast("bigint").alias("seg_id"), arrays.as_text(F.col("units")).alias("t")).where("t <> ''")
    rows = write_table(rows, "texts").df
    texts = write_table(rows.groupBy("t").agg(F.min("seg_id").alias("id")), "texts").df
    most = min_similarity if length_filter == "reference" else 1.0 - min_similarity
    min_ratio = max(1.0 - most, min(min_similarity, 1.0), 0.0) - 1e-9
    some = [r["t"] for r in texts.orderBy(F.xxhash64(F.lit(3), "id")).limit(SAMPLED_TEXTS).select("t").collect()]
    known = feature_buckets(some)
    names = np.array(sorted(known), np.int64)
    shared = sequences.sparkSession.sparkContext.broadcast((names, np.array([known[f] for f in names.tolist()], np.int64)))
    tasks, n_tasks = _length_tasks(texts, block_rows, min_ratio)
    schema = pa.schema([("ia", pa.int64()), ("ib", pa.int64()), ("ta", pa.string()), ("tb", pa.string())])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_key(batches):
            words = batch.column(3).to_pylist()
            length = np.fromiter(map(len, words), np.int64, len(words))
            order = np.lexsort((length, batch.column(1).to_numpy()))  # the shorter block first, by length
            length, t = length[order], batch.column(3).take(pa.array(order))
            ids, block = batch.column(2).take(pa.array(order)), batch.column(1).to_numpy()[order]
            count = bags(t.to_pylist(), shared.value)
            count = count.astype(np.uint16 if count.max() < 65536 else np.int32)
            cut = int((block == 0).sum())
            same = cut == len(block)
            short = [count, length] if same else [count[:cut], length[:cut]]
            long = short if same else [count[cut:], length[cut:]]
            for i, j in _sharing(short, long, length, same, min_similarity, min_ratio):
                j = j if same else j + cut
                for part in range(0, len(i), 65536):
                    a, b = pa.array(i[part : part + 65536]), pa.array(j[part : part + 65536])
                    yield pa.RecordBatch.from_arrays([ids.take(a), ids.take(b), t.take(a), t.take(b)], schema=schema)

    near = scan_tasks(tasks, ["task"], ["id"], candidates, "ia bigint, ib bigint, ta string, tb string", min(2 * max(n_tasks, 1), MAX_PARTS))
    na, nb = F.length("ta"), F.length("tb")
    longest = F.greatest(na, nb).cast("double")
    weight = F.lit(1.0) - F.levenshtein("ta", "tb") / longest
    between = near.where(F.abs(na - nb) / longest <= F.lit(most)).select("ia", "ib", weight.alias("weight")).where(F.col("weight") >= min_similarity)
    copies = rows.join(texts, "t").select("id", "seg_id")
    a, b = copies.select(F.col("id").alias("ia"), F.col("seg_id").alias("sa")), copies.select(F.col("id").alias("ib"), F.col("seg_id").alias("sb"))
    across = between.join(a, "ia").join(b, "ib").select(F.least("sa", "sb").alias("src"), F.greatest("sa", "sb").alias("dst"), "weight")
    equal = a.join(b, F.col("ia") == F.col("ib")).where("sa < sb").select(F.col("sa").alias("src"), F.col("sb").alias("dst"), F.lit(1.0).alias("weight"))
    return across.unionByName(equal) if min_similarity <= 1 else across


def graph_vertices(vectors: DataFrame, id_col: str = "seg_id") -> DataFrame:
    """``seg_id``: all vertices, those without an edge included."""
    return vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("seg_id")).distinct()


def vertex_degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``seg_id, degree, strength``: number and summed weight of the edges of each vertex."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("seg_id"), "weight").groupBy("seg_id").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))
    return vertices.join(ends, "seg_id", "left").select("seg_id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"))
