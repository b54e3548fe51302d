"""Groups of mutually similar vectors: MinHash banding, exact verification, connected components, medoids.

* **Sets.** MinHash needs sets. A vector's set is the ``set_size`` anchors most similar to it, out of a bounded
  random sample of the vectors themselves. Vectors at a high cosine have much of their sets in common (a Jaccard
  similarity of 0.35 to 0.45 at a cosine of 0.87), others next to nothing. The denser the anchors, the less of
  its set a pair shares, so ``set_size`` and ``bands`` are found for the anchors at hand: the least with which
  pairs at just the threshold, made up from the anchors, meet in a bucket with the ``recall`` that is asked for.
* **Banding.** Each of ``bands`` hash functions picks one anchor of the set: the vector's bucket. All bands share
  one space of buckets, so two picks that agree need not be of the same band. Near anchors form groups; a vector is
  sent once to each group in which it has buckets, with a mark for each of them, and a group is a task. A group with
  many rows is cut into blocks, each pair of which is a task. So many groups are sent at once, in rounds, that
  their rows take no more disk than the vectors.
* **Verification.** What is asked for is the cosine, so it is verified in place of the Jaccard similarity: within
  a bucket, all pairs by matrix products over 6-bit codes. The error of a code is known, so a pair is decided by
  its codes unless it is nearer to the threshold than both errors; such pairs, if the decided ones do not connect
  them already, are decided on the full vectors. Of a task's links only a spanning forest leaves it, never all pairs.
* **Components** of the links form the groups, by hash-to-min.
* **Splitting.** Links within a component are counted, by matrix products over 8-bit codes and, near the threshold, on
  the full vectors. Where not all members are alike, the member with the most links takes these as its group, then
  the next of the rest, and so on, always by the full vectors.
* **Profiles.** A member is the more typical of its group the higher its mean similarity to the group's members, which
  follows from the sum of their vectors.

Equal vectors are reduced to the smallest id before any of this, by an aggregation of their hashes that combines
before its shuffle, and come back at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..arrowtools import by_key, packed, scan_tasks, unpacked
from ..session import freed_shuffles, write_table
from .components import connected_components
from .vectors import BLOCK_ROWS, MOST_SENT, centre, from_fixed_point, hashed, in_blocks, is_usable, unit, unit_vectors, usable, vector_rows

MIN_ANCHORS, MAX_ANCHORS = 64, 131_072
#: Anchors of one matrix product. A vector is always compared with all anchors, so many at a time.
EXACT_ANCHORS = 8192
#: Members of a loose component, or of a group to be described, whose vectors one task holds: 100 MB. Larger
#: components are split in rounds, each of which takes so many medoids; larger groups are summed up in parts.
SPLIT_ROWS = 262_144
SPLIT_HEADS = 1024
#: Vectors an anchor, on average, until there are MAX_ANCHORS.
ROWS_PER_ANCHOR = 100
#: The least set size and number of bands; as many bands an anchor of the set are kept for larger sets.
SET_SIZE, BANDS = 8, 16
#: Share of the pairs at just the threshold that are to meet in a bucket, where no anchor is of their group.
RECALL = 0.95
#: Most anchors of a group, which are marks of 64 bits; least groups, if there are as many anchors; and rows that a
#: group has on average, at most. A group with more than twice as many is cut.
MARKS, LEAST_GROUPS, GROUP_ROWS = 64, 16, 131_072
#: Bytes of disk that the rows of a round may take, even if the vectors take less.
ROUND_BYTES = 64 << 20
#: Undecided pairs that a task holds before it hands them on.
MOST_UNSURE = 1 << 21
_EDGES = "a bigint, b bigint, sure boolean"


def anchor_vectors(rows: DataFrame, mean: np.ndarray, n: int, dim: int) -> np.ndarray:
    """A sample of the unit vectors, chosen by a hash of the id: ``n / ROWS_PER_ANCHOR`` of them, within bounds."""
    wanted = int(np.clip(n // ROWS_PER_ANCHOR, MIN_ANCHORS, MAX_ANCHORS))
    share = min(1.0, 3.0 * wanted / max(n, 1))
    picked = rows.where(F.pmod(hashed("id"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(hashed("id"), "id").limit(2 * wanted).toArrow()
    x = usable(picked["x"].combine_chunks(), dim)[1] if picked.num_rows else np.zeros((0, dim))
    first = np.sort(np.unique(x, axis=0, return_index=True)[1])  # different vectors, in the order of the hash
    return unit(x[first[:wanted]], mean).astype(np.float32)


def code(x: np.ndarray, bits: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of unit vectors, the scale of each, and the length of the error that each code makes."""
    scale = np.maximum(np.abs(x).max(1), 1e-30) / (2 ** (bits - 1) - 1)
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(x - codes * scale[:, None], axis=1) + 1e-6


def small_codes(x: np.ndarray) -> np.ndarray:
    """6-bit codes, four in three bytes, with their scale and error: what a bucket gets of a vector."""
    codes, scale, err = code(x, 6)
    c = np.zeros((len(x), -(-x.shape[1] // 4) * 4), np.uint8)
    c[:, : x.shape[1]] = codes + 32
    c = c.reshape(len(x), -1, 4)
    three = np.stack([c[..., 0] << 2 | c[..., 1] >> 4, c[..., 1] << 4 | c[..., 2] >> 2, c[..., 2] << 6 | c[..., 3]], 2)
    tail = np.stack([scale, err], 1).astype(np.float32)
    return np.concatenate([three.reshape(len(x), -1), tail.view(np.uint8)], 1)


def small_floats(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of ``small_codes``, and their shares of the bound as in ``floats``."""
    width = -(-dim // 4) * 3
    raw = unpacked(col, np.uint8, width + 8)
    tail = np.ascontiguousarray(raw[:, width:]).view(np.float32)
    b = raw[:, :width].reshape(len(raw), -1, 3)
    c = np.stack([b[..., 0] >> 2, (b[..., 0] & 3) << 4 | b[..., 1] >> 4, (b[..., 1] & 15) << 2 | b[..., 2] >> 6, b[..., 2] & 63], 2).reshape(len(raw), -1)
    x = c[:, :dim].astype(np.float32)
    x -= 32
    x *= tail[:, :1]
    return x, 1.03 * tail[:, 1] + np.float32(1e-6)


def nearest_anchors(x: np.ndarray, anchors: np.ndarray, size: int, block: int = EXACT_ANCHORS) -> np.ndarray:
    """The set of each vector, out of all anchors, ``block`` of which are compared at once."""
    size = min(size, len(anchors))
    block = max(block, size)
    s = x @ anchors[:block].T
    near = np.argpartition(s, s.shape[1] - size, axis=1)[:, -size:]
    if len(anchors) <= block:
        return near
    best = np.take_along_axis(s, near, 1)
    for begin in range(block, len(anchors), block):
        s = x @ anchors[begin : begin + block].T
        r, c = np.nonzero(s > best.min(1, keepdims=True))
        if not len(r):
            continue
        # Nearer ones are few; with the sets so far, the best of each row.
        row = np.append(np.repeat(np.arange(len(x)), size), r)
        ids, sims = np.append(near, c + begin), np.append(best, s[r, c])
        order = np.lexsort((-sims, row))
        first = np.searchsorted(row[order], np.arange(len(x)))
        keep = order[first[:, None] + np.arange(size)]
        near, best = ids[keep], sims[keep]
    return near


def minhash_keys(near: np.ndarray, permutations: np.ndarray) -> list[np.ndarray]:
    """The different buckets of each vector, of its set."""
    keys = np.stack([np.take_along_axis(near, p[near].argmin(1)[:, None], 1)[:, 0] for p in permutations], 1)
    keys.sort(1)
    new = np.ones_like(keys, bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return [k[m].astype(np.int32) for k, m in zip(keys, new)]


def hash_orders(n_anchors: int, bands: int) -> np.ndarray:
    """An order of the anchors for each band."""
    rng = np.random.default_rng(3)
    return np.stack([rng.permutation(max(n_anchors, 1)) for _ in range(bands)]).astype(np.int32)


def threshold_pairs(anchors: np.ndarray, threshold: float, pairs: int, most: int, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` nearest anchors, nearest first, of both vectors of pairs with just the cosine ``threshold``.

    A pair is an anchor and a vector that leaves it in a direction with the covariance of the anchors. Anchors that
    are alike with the first are left out, as if none were of the pair's group: so it is for small groups."""
    rng = np.random.default_rng(seed)
    some = anchors[rng.permutation(len(anchors))[:4096]]
    left, right = [], []
    for begin in range(0, pairs, 32):
        x = anchors[rng.integers(len(anchors), size=min(32, pairs - begin))]
        away = rng.normal(size=(len(x), len(some))).astype(np.float32) @ some
        away -= np.einsum("ij,ij->i", away, x)[:, None] * x
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
        s = x @ anchors.T
        own = s >= threshold
        for side, near in ((left, s), (right, threshold * s + np.sqrt(1 - threshold**2) * (away @ anchors.T))):
            near = np.where(own, np.float32(-9), near)
            top = np.argpartition(-near, most - 1, axis=1)[:, :most]
            side.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1), 1))
    return np.concatenate(left), np.concatenate(right)


def shared_bucket(left: np.ndarray, right: np.ndarray, permutations: np.ndarray) -> float:
    """Share of the pairs of sets that meet in a bucket."""
    return float(np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(minhash_keys(left, permutations), minhash_keys(right, permutations))]))


def fitted_sets(anchors: np.ndarray, threshold: float, recall: float = RECALL, pairs: int = 1024) -> tuple[int, int]:
    """Set size and bands: the least with which ``threshold_pairs`` meet at ``recall``. All anchors are the last
    resort: with them, all vectors meet."""
    m = len(anchors)
    if m <= SET_SIZE or threshold >= 1:
        return SET_SIZE, BANDS
    most, size = min(m, 256), SET_SIZE
    left, right = threshold_pairs(anchors, max(threshold, 0.0), pairs, most)
    while size < most:
        bands = size * BANDS // SET_SIZE
        if shared_bucket(left[:, :size], right[:, :size], hash_orders(m, bands)) >= recall:
            return size, bands
        size += max(1, size // 8)
    return m, BANDS


def anchor_groups(anchors: np.ndarray, width: int, steps: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Group of each anchor, and its place in it: groups of at most ``width`` near anchors and of about the same size.
    All anchors are halved by two means, then each half, and so on."""
    group, place = np.zeros(len(anchors), np.int32), np.zeros(len(anchors), np.int32)
    parts, n_groups = [(np.arange(len(anchors)), -(-len(anchors) // width))], 0
    while parts:
        own, n = parts.pop()
        if n <= 1:
            group[own], place[own], n_groups = n_groups, np.arange(len(own)), n_groups + 1
            continue
        x, cut = anchors[own], len(own) * (n // 2) // n
        away = x[(x @ x[0]).argmin()] - x[0]
        for _ in range(steps):
            order = np.argsort(x @ away, kind="stable")
            away = x[order[cut:]].mean(0) - x[order[:cut]].mean(0)
        parts += [(own[order[:cut]], n // 2), (own[order[cut:]], n - n // 2)]
    return group, place


def group_width(n: int, n_anchors: int, keys: int) -> int:
    """Anchors of a group, where ``n`` vectors have at most so many ``keys``."""
    return int(np.clip(min(n_anchors // LEAST_GROUPS, GROUP_ROWS * n_anchors // max(n * keys, 1)), 1, MARKS))


def marked(keys: list[np.ndarray], group: np.ndarray, place: np.ndarray) -> pa.Array:
    """The buckets of each vector as its groups, each with the bits of the places of its anchors."""
    flat = np.concatenate([*keys, np.zeros(0, np.int32)]).astype(np.int64)
    row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    order = np.lexsort((group[flat], row))
    row, g, bit = row[order], group[flat][order], np.uint64(1) << place[flat][order].astype(np.uint64)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (g[1:] != g[:-1])
    marks = np.bitwise_or.reduceat(bit, np.flatnonzero(new)) if len(bit) else bit
    offsets = np.searchsorted(row[new], np.arange(len(keys) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(g[new], pa.int32()), pa.array(marks.view(np.int64))], ["key", "marks"]))


def coded(rows: DataFrame, mean: np.ndarray, anchors: np.ndarray, dim: int, bands: int, set_size: int, width: int = MARKS) -> DataFrame:
    """``vhash, id, code, scale, err, small, keys`` of each row with a usable vector; ``vhash`` is the same for equal ones.
    ``keys`` has the groups of anchors in which the vector has buckets, and the marks of these."""
    permutations = hash_orders(len(anchors), bands)
    at_once = EXACT_ANCHORS
    shared = rows.sparkSession.sparkContext.broadcast((mean, anchors, permutations, *anchor_groups(anchors, width)))
    buckets_type = pa.list_(pa.struct([("key", pa.int32()), ("marks", pa.int64())]))
    schema = pa.schema([("vhash", pa.binary()), ("id", pa.int64()), ("code", pa.binary()), ("scale", pa.float32()), ("err", pa.float32()), ("small", pa.binary()), ("keys", buckets_type)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        mean, anchors, permutations, group, place = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                at, raw = usable(part.column(1), dim)
                if not len(at):
                    continue
                key = [xxhash.xxh3_128_digest(v.tobytes()) for v in (raw + 0.0).astype(np.float32)]
                x = unit(raw, mean)
                codes, scale, err = code(x)
                buckets = minhash_keys(nearest_anchors(x.astype(np.float32), anchors, set_size, at_once), permutations)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), part.column(0).take(pa.array(at)), packed(codes), pa.array(scale.astype(np.float32)), pa.array(err.astype(np.float32)), packed(small_codes(x)), marked(buckets, group, place)], schema=schema)

    return rows.mapInArrow(encode, "vhash binary, id bigint, code binary, scale float, err float, small binary, keys array<struct<key: int, marks: bigint>>")


def similarities(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, sure) for the pairs of two sets of coded vectors that are or may be alike. The whole
    matrix is only compared with one number; what depends on a pair's own errors is done for those that pass."""
    s = a[0] @ b[0].T
    r, c = np.nonzero(s > np.float32(threshold) - a[1].max(initial=0) - b[1].max(initial=0))
    margin, over = a[1][r] + b[1][c], s[r, c] - np.float32(threshold)
    keep = over > -margin
    return r[keep], c[keep], (over >= margin)[keep]


def strip_rows(others: int) -> int:
    """Rows that are compared with so many others at once: where all are alike, each pair takes some 60 bytes."""
    return max(16, (1 << 20) // max(others, 1))


def floats(batch: pa.RecordBatch, code_at: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The decoded vectors of a batch with ``code, scale, err`` from a column on, and twice the errors' share of
    the bound: ``|x.y - x'.y'| <= |x'| err_y + err_x |y| <= 1.01 (err_x + err_y)``."""
    codes = unpacked(batch.column(code_at), np.int8, dim).astype(np.float32)
    return codes * batch.column(code_at + 1).to_numpy()[:, None], (1.01 * batch.column(code_at + 2).to_numpy() + 1e-6).astype(np.float32)


def spanning_links(ids: np.ndarray, buckets: Iterator[list[np.ndarray]], x: tuple, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """``(a, b, sure)``: a spanning forest of the sure links among ``ids`` within the buckets (between the blocks of a
    bucket if there are two), as links to the smallest id; and the unsure pairs that it does not connect, which are
    handed on before its end if they are many. All pairs are compared, a strip at a time."""
    label = np.arange(len(ids))
    unsure, held = [np.zeros((0, 2), np.int64)], 0
    for left, right in buckets:
        rows = strip_rows(len(right))
        for begin in range(0, len(left), rows):
            i = left[begin : begin + rows]
            j = right if left is not right else right[begin:]
            if not len(j):
                continue
            r, c, sure = similarities((x[0][i], x[1][i]), (x[0][j], x[1][j]), threshold)
            a, b = i[r], j[c]
            open_ = ~sure & (a < b if left is right else a != b) & (label[a] != label[b])
            unsure.append(np.stack([np.minimum(a[open_], b[open_]), np.maximum(a[open_], b[open_])], 1))
            held += len(unsure[-1])
            a, b = a[sure], b[sure]
            while len(a):  # links that join different trees, until there are none
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
                low = np.minimum(label[a], label[b])
                np.minimum.at(label, label[a], low)
                np.minimum.at(label, label[b], low)
                while (label[label] != label).any():
                    label = label[label]
            if held > MOST_UNSURE:
                unsure = [_open_pairs(unsure, label)]
                held = len(unsure[0])
                if held > MOST_UNSURE // 2:
                    yield ids[unsure[0][:, 1]], ids[unsure[0][:, 0]], False
                    unsure, held = [np.zeros((0, 2), np.int64)], 0
    tree = np.flatnonzero(label != np.arange(len(ids)))
    pairs = _open_pairs(unsure, label)
    yield ids[tree], ids[label[tree]], True
    yield ids[pairs[:, 1]], ids[pairs[:, 0]], False


def _open_pairs(unsure: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """The different pairs that are not in one tree."""
    pairs = np.concatenate(unsure)
    pairs = pairs[label[pairs[:, 0]] != label[pairs[:, 1]]]
    one = np.unique(pairs[:, 0] * len(label) + pairs[:, 1])
    return np.stack([one // max(len(label), 1), one % max(len(label), 1)], 1)


def _task_blocks(batch: pa.RecordBatch, lo_at: int) -> list[np.ndarray]:
    lo, hi = batch.column(lo_at)[0].as_py(), batch.column(lo_at + 1)[0].as_py()
    every = np.arange(batch.num_rows)
    if lo == hi:
        return [every, every]
    block = batch.column(lo_at + 2).to_numpy()
    return [every[block == lo], every[block == hi]]


def bucket_links(codes: DataFrame, dim: int, threshold: float, block_rows: int = 2 * GROUP_ROWS, rounds: int = 1, turn: int = 0) -> DataFrame:
    """``a, b, sure``: links of a spanning forest of each group of buckets, and the pairs left to the full vectors. Of
    so many ``rounds``, it is about the groups whose ``turn`` it is."""
    keys = codes.select(F.explode("keys").alias("k"), "id", "small").select("k.key", "k.marks", "id", "small")
    rows, counted = (df.where(F.pmod("key", F.lit(rounds)) == turn) for df in (keys, keys.select("key")))
    tasks = in_blocks(rows, "key", "id", counted, block_rows).select("key", "lo", "hi", "block", "id", "small", "marks")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())])

    def buckets(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        left, right = _task_blocks(batch, 1)
        marks = batch.column(6).to_numpy().view(np.uint64)
        for place in range(MARKS):
            own = (marks >> np.uint64(place) & np.uint64(1)).astype(bool)
            if own.any():
                first = left[own[left]]
                yield [first, first if left is right else right[own[right]]]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_key(batches, 3):
            if batch.num_rows < 2:
                continue
            for a, b, sure in spanning_links(batch.column(4).to_numpy(), buckets(batch), small_floats(batch.column(5), dim), threshold):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.array(np.full(len(a), sure))], schema=schema)

    return scan_tasks(tasks, ["key", "lo", "hi"], ["id"], link, _EDGES)


def distinct_links(links: DataFrame) -> DataFrame:
    """Each ``a, b`` once, ``sure`` if it is so anywhere: the ends of a sure link are of one component, alike or not."""
    return links.groupBy("a", "b").agg(F.max("sure").alias("sure"))


def rounds_of(codes: DataFrame, n: int, dim: int) -> int:
    """In how many rounds the rows of ``bucket_links`` take no more bytes than ``n`` vectors, or ``ROUND_BYTES``."""
    sent = codes.agg(F.sum(F.size("keys"))).first()[0] or 0
    return max(1, -(-sent * (-(-dim // 4) * 3 + 24) // max(ROUND_BYTES, 4 * n * dim)))


def alike_pairs(pairs: DataFrame, rows: DataFrame, mean: np.ndarray, dim: int, threshold: float) -> DataFrame:
    """Those of the pairs ``a, b`` whose full vectors have at least the similarity ``threshold``."""
    ids = write_table(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "undecided").df
    # Where they are few they are sent, so that not all vectors are shuffled for them.
    vectors = rows.join(F.broadcast(ids) if ids.count() <= MOST_SENT else ids, "id", "left_semi").dropDuplicates(["id"])
    both = pairs.distinct().join(vectors.select(F.col("id").alias("a"), F.col("x").alias("xa")), "a").join(vectors.select(F.col("id").alias("b"), F.col("x").alias("xb")), "b")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (_, x), (_, y) = (usable(batch.column(i), dim) for i in (2, 3))
            keep = np.einsum("ij,ij->i", unit(x, mean), unit(y, mean)) >= threshold
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "xa", "xb").mapInArrow(decide, "a bigint, b bigint")


def member_degrees(members: DataFrame, counted: DataFrame, dim: int, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``grp, id, degree``: for each member the number of other members of the same group that are alike. ``unsure``
    pairs are rows with ``other`` set. ``counted`` has ``grp`` as often as ``members``."""
    tasks = in_blocks(members, "grp", "id", counted, block_rows).select("grp", "lo", "hi", "block", "id", "code", "scale", "err")
    schema = pa.schema([("grp", pa.int64()), ("id", pa.int64()), ("degree", pa.int64()), ("other", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_key(batches, 3):
            ids = batch.column(4).to_numpy()
            left, right = _task_blocks(batch, 1)
            x = floats(batch, 5, dim)
            degree, unsure = np.zeros(len(ids), np.int64), []
            rows = strip_rows(len(right))
            for begin in range(0, len(left), rows):
                i = left[begin : begin + rows]
                r, c, sure = similarities((x[0][i], x[1][i]), (x[0][right], x[1][right]), threshold)
                a, b = i[r], right[c]
                other = a != b
                degree += np.bincount(a[sure & other], minlength=len(ids))
                if left is not right:
                    degree += np.bincount(b[sure], minlength=len(ids))
                open_ = ~sure & ((a < b) if left is right else other)
                unsure.append(np.stack([a[open_], b[open_]], 1))
            pairs = np.concatenate(unsure) if unsure else np.zeros((0, 2), np.int64)
            n = len(ids) + len(pairs)
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column(0)[0].as_py(), np.int64)), pa.array(np.append(ids, ids[pairs[:, 0]])), pa.array(np.append(degree, np.zeros(len(pairs), np.int64))), pa.chunked_array([none, pa.array(ids[pairs[:, 1]], pa.int64())]).combine_chunks()], schema=schema)

    return scan_tasks(tasks, ["grp", "lo", "hi"], ["id"], count, "grp bigint, id bigint, degree bigint, other bigint")


def split_loose(members: DataFrame, mean: np.ndarray, dim: int, threshold: float) -> DataFrame:
    """``id, part``: the members ``grp, id, degree, x`` of loose groups around medoids of highest degree (ties: smallest
    id). A task holds a group's vectors, not its pairs: one product with a vector a medoid."""
    schema = pa.schema([("id", pa.int64()), ("part", pa.int64())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_key(batches):
            ids, degree = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            x = unit(usable(batch.column(3), dim)[1], mean)
            order = np.lexsort((ids, -degree))
            part = np.full(len(ids), -1, np.int64)
            for m in order.tolist():
                if part[m] < 0:
                    free = np.flatnonzero(part < 0)
                    near = free[(x[free] @ x[m] >= threshold) | (free == m)]
                    part[near] = ids[near].min()
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(part)], schema=schema)

    return scan_tasks(members.select("grp", "id", "degree", "x"), ["grp"], ["id"], split, "id bigint, part bigint")


def split_large(members: DataFrame, mean: np.ndarray, dim: int, threshold: float, heads: int = SPLIT_HEADS) -> DataFrame:
    """``split_loose`` for components of any size, in rounds. Of the free members of each component the ``heads`` with the
    most links come to the driver. In their order, one that is alike with none chosen before it is a medoid, as it
    would be one by one; each free member then goes to the first of them that it is alike with."""
    spark = members.sparkSession
    state = write_table(members.select("grp", "id", "degree", "x", F.lit(None).cast("bigint").alias("medoid")), "split")
    order = Window.partitionBy("grp").orderBy(F.desc("degree"), "id")
    while True:
        top = state.df.where("medoid is null").withColumn("r", F.row_number().over(order)).where(F.col("r") <= heads)
        rows = top.select("grp", "r", "id", "x").orderBy("grp", "r").toArrow().combine_chunks()
        if not rows.num_rows:
            break
        x, grp, ids = unit(usable(rows["x"].combine_chunks(), dim)[1], mean), rows["grp"].to_numpy(), rows["id"].to_numpy()
        chosen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for g in np.unique(grp).tolist():
            own = np.flatnonzero(grp == g)
            s, taken = x[own] @ x[own].T >= threshold, np.zeros(len(own), bool)
            keep = []
            for i in range(len(own)):
                if not taken[i]:
                    keep.append(own[i])
                    taken |= s[i]
            chosen[g] = (ids[keep], x[keep])
        shared = spark.sparkContext.broadcast(chosen)

        def near(batches: Iterator[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y, g, own = unit(usable(batch.column("x"), dim)[1], mean), batch.column("grp").to_numpy(), batch.column("id").to_numpy()
                medoid = np.full(len(own), -1, np.int64)
                for k in np.unique(g).tolist():
                    at = np.flatnonzero(g == k)
                    names, heads = shared.value[k]
                    alike = (y[at] @ heads.T >= threshold) | (own[at][:, None] == names[None, :])
                    medoid[at] = np.where(alike.any(1), names[alike.argmax(1)], -1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("grp", "id", "degree", "x")), pa.array(medoid, mask=medoid < 0)], names=["grp", "id", "degree", "x", "medoid"])

        moved = state.df.where("medoid is null").mapInArrow(near, state.df.schema)
        following = write_table(state.df.where("medoid is not null").unionByName(moved), "split")
        state.drop()
        state = following
    parts = state.df.groupBy("medoid").agg(F.min("id").alias("part"))
    return state.df.join(parts, "medoid").select("id", "part")


def similarity_groups(segments: DataFrame, threshold: float = 0.74, dim: int = 96, id_col: str = "seg_id", vector_col: str = "features", bands: int | None = None, set_size: int | None = None, block_rows: int = BLOCK_ROWS, recall: float = RECALL, centred: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """Groups of similar vectors.

    A vector is usable if it has ``dim`` elements, all non-null and finite and not all zero; other rows, and rows
    with a null id, take no part. Rows that repeat an id count once. The mean of all usable vectors is subtracted;
    similarity is the cosine of the results, and two vectors are alike at ``threshold`` or more. The result has one
    row for each usable id: ``id, group_id, n_members, tight, degree, component, n_component``. ``group_id`` is the
    smallest id of the group, ``tight`` says that all members are alike with one another and with none outside, and
    ``degree`` is the number of members of the component that are alike (equal vectors count once). A vector without
    any link is a group of one. Empty tables give an empty result; other columns are not read.

    Links are found by banding; a link that is found is exact. ``bands`` and ``set_size`` are fitted to the anchors,
    whatever their number, so that pairs at just the threshold are found with about ``recall`` and others with more.
    ``centred`` passes the mean and number of the vectors, as ``vectors.centre`` gives them, if they are known.
    What each step has shuffled is deleted at its end.
    """
    with freed_shuffles(segments.sparkSession):
        return _similarity_groups(vector_rows(segments, id_col, vector_col), threshold, dim, bands, set_size, block_rows, recall, centred)


def _similarity_groups(rows: DataFrame, threshold: float, dim: int, bands: int | None, set_size: int | None, block_rows: int, recall: float, centred: tuple[np.ndarray, int] | None) -> DataFrame:
    mean, n = centred or centre(rows, dim)
    anchors = anchor_vectors(rows, mean, n, dim)
    if bands is None or set_size is None:
        fitted = fitted_sets(anchors, threshold, recall)
        set_size, bands = set_size or fitted[0], bands or fitted[1]
    width = group_width(n, len(anchors), min(bands, set_size))
    every = write_table(coded(rows, mean, anchors, dim, bands, set_size, width).withColumn("row", F.monotonically_increasing_id()), "codes")
    # Equal vectors are found by their hashes alone, so that the codes are not shuffled for it.
    hashes = every.df.select("vhash", "id", "row")
    several = hashes.groupBy("vhash").agg(F.min(F.struct("id", "row")).alias("first"), F.count("*").alias("n")).where("n > 1").select("vhash", F.col("first.id").alias("rep"), F.col("first.row").alias("kept"))
    surplus = write_table(hashes.join(several, "vhash").where("row <> kept").select("id", "row", "rep"), "copies")
    copies = surplus.df.where("id <> rep").select("id", "rep").distinct()
    vectors = every.df.join(surplus.df.select("row"), "row", "left_anti")

    rounds = rounds_of(every.df, n, dim)
    most = 2 * GROUP_ROWS // BLOCK_ROWS * block_rows
    found = [write_table(distinct_links(bucket_links(vectors, dim, threshold, most, rounds, turn)), "bucket-links") for turn in range(rounds)]
    every_link = reduce(DataFrame.union, [t.df for t in found])
    unsure = every_link.where("not sure").select("a", "b")
    links = every_link.where("sure").select("a", "b")
    if not unsure.isEmpty():
        links = links.union(alike_pairs(unsure, rows, mean, dim, threshold))
    linked = write_table(connected_components(links, "a", "b", "id", "grp"), "groups")
    for table in found:
        table.drop()

    members = vectors.select("id", "code", "scale", "err").join(linked.df, "id")
    counted = write_table(member_degrees(members, linked.df, dim, threshold, block_rows), "degrees")
    unsure = counted.df.where("other is not null").select("grp", F.col("id").alias("a"), F.col("other").alias("b"))
    by_member = counted.df.where("other is null").groupBy("grp", "id").agg(F.sum("degree").alias("degree"))
    if not unsure.isEmpty():
        more = alike_pairs(unsure.select("a", "b"), rows, mean, dim, threshold).select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("more"))
        by_member = by_member.join(more, "id", "left").select("grp", "id", (F.col("degree") + F.coalesce("more", F.lit(0))).alias("degree"))
    by_group = by_member.groupBy("grp").agg(F.count("*").alias("n"), F.min("degree").alias("least"))
    known = write_table(by_member.join(by_group, "grp").select("grp", "id", "degree", (F.col("least") == F.col("n") - 1).alias("tight"), "n"), "known")
    counted.drop()
    loose = known.df.where("not tight")
    settled = known.df.select("id", F.col("grp").alias("group_id"), F.col("grp").alias("component"), "degree", "tight")
    if not loose.isEmpty():
        loose = loose.join(rows.dropDuplicates(["id"]), "id")
        parts = split_loose(loose.where(F.col("n") <= SPLIT_ROWS), mean, dim, threshold)
        if not (large := loose.where(F.col("n") > SPLIT_ROWS)).isEmpty():
            parts = parts.unionByName(split_large(large, mean, dim, threshold))
        parts = write_table(parts, "parts").df
        settled = settled.join(parts, "id", "left").select("id", F.coalesce("part", "group_id").alias("group_id"), "component", "degree", "tight")
    # Vectors without a link, then the copies, which share their representative's group.
    alone = vectors.select("id").join(linked.df, "id", "left_anti").select("id", F.col("id").alias("group_id"), F.col("id").alias("component"), F.lit(0).cast("bigint").alias("degree"), F.lit(True).alias("tight"))
    placed = settled.unionByName(alone)
    of_copies = copies.join(placed.withColumnRenamed("id", "rep"), "rep").select("id", "group_id", "component", "degree", "tight")
    full = placed.unionByName(of_copies)
    sizes = full.groupBy("group_id").agg(F.count("*").alias("n_members"))
    in_component = full.groupBy("component").agg(F.count("*").alias("n_component"))
    return full.join(sizes, "group_id").join(in_component, "component").select("id", "group_id", "n_members", "tight", "degree", "component", "n_component")


def typicalities(members: DataFrame, vectors: DataFrame, dim: int, most_rows: int = SPLIT_ROWS) -> DataFrame:
    """``key, id, n, typicality`` of the different members ``key bigint, id`` that have a vector ``id, x`` of
    ``unit_vectors``: how many the key has, and the mean similarity to them, by their sum. Rows of ``vectors`` that repeat
    count once. A key is one task up to ``most_rows`` members; a larger one is summed up in parts, and its sum, one row
    a key, is sent to all tasks."""
    members = write_table(members.select("key", "id").distinct(), "profiled").df
    counts = members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most_rows)
    hot = write_table(counts.select("key"), "hot-groups").df
    schema = "key bigint, id bigint, n bigint, typicality double"

    def mean_of(key: pa.Array, ids: pa.Array, x: np.ndarray, total: np.ndarray, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([key, ids, pa.array(np.full(len(x), n, np.int64)), pa.array(x @ total / n)], names=["key", "id", "n", "typicality"])

    def decoded(col: pa.Array) -> np.ndarray:
        x = from_fixed_point(unpacked(col, np.uint8, 3 * dim))
        norm = np.linalg.norm(x, axis=1, keepdims=True)  # of two members both are as typical, whatever was rounded
        return x / np.where(norm > 0, norm, 1)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_key(batches):
            batch = batch.take(pa.array(np.unique(batch.column(1).to_numpy(), return_index=True)[1]))
            x = decoded(batch.column(2))
            yield mean_of(batch.column(0), batch.column(1), x, x.sum(0), len(x))

    some = not hot.isEmpty()
    few = members.join(hot, "key", "left_anti") if some else members
    out = scan_tasks(few.join(vectors, "id").select("key", "id", "x"), ["key"], [], whole, schema)
    if not some:
        return out
    many = write_table(members.join(F.broadcast(hot), "key").join(vectors, "id").select("key", "id", "x").dropDuplicates(["key", "id"]), "hot-members").df

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            key, x = batch.column(0).to_numpy(), decoded(batch.column(2))
            for k in np.unique(key).tolist():
                sums[k] = sums.get(k, 0.0) + np.append(x[key == k].sum(0), (key == k).sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), packed(np.array(list(sums.values())).reshape(-1, dim + 1))], names=["key", "s"])

    total: dict[int, np.ndarray] = {}
    for row in many.mapInArrow(add, "key bigint, s binary").toLocalIterator():
        total[row["key"]] = total.get(row["key"], 0.0) + np.frombuffer(row["s"])
    shared = members.sparkSession.sparkContext.broadcast(total)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            for k in np.unique(key).tolist():
                part = batch.filter(pa.array(key == k))
                yield mean_of(part.column(0), part.column(1), decoded(part.column(2)), shared.value[k][:-1], int(shared.value[k][-1]))

    return out.unionByName(many.mapInArrow(compare, schema))


def most_typical(ranked: DataFrame, typical: int = 3) -> DataFrame:
    """``key, n, typical_ids``: for each key of ``typicalities`` the ids of its most typical vectors, compared to six
    decimals (ties: smallest id). Each task keeps so many rows a key before they are shuffled."""
    order = Window.partitionBy("key").orderBy(F.desc(F.round("typicality", 6)), "id")
    first = ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= typical)
    picked = F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda p: p["id"])
    return first.groupBy("key").agg(F.first("n").alias("n"), picked.alias("typical_ids"))


def group_profiles(groups: DataFrame, segments: DataFrame, typical: int = 3, least: int = 2, dim: int = 96, id_col: str = "seg_id", vector_col: str = "features", centred: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """``group_id, n_members, tight, typical_ids``: each group of ``similarity_groups`` with at least ``least`` members,
    with the ids of its ``typical`` members that are most similar to the group's members in the mean (ties: smallest
    id). Equal vectors count as often as there are ids. ``centred`` passes the mean of the vectors, if it is known."""
    kept = write_table(groups.where(F.col("n_members") >= least).select("group_id", "id", "tight"), "grouped").df
    rows = vector_rows(segments, id_col, vector_col)
    vectors = unit_vectors(rows, (centred or centre(rows, dim))[0], dim)
    picked = most_typical(typicalities(kept.select(F.col("group_id").alias("key"), "id"), vectors, dim), typical)
    tight = kept.groupBy("group_id").agg(F.first("tight").alias("tight"))
    return picked.join(tight, F.col("key") == F.col("group_id")).select("group_id", F.col("n").alias("n_members"), "tight", "typical_ids")


def cluster_profiles(partition: DataFrame, segments: DataFrame, typical: int = 3, dim: int = 96, id_col: str = "seg_id", vector_col: str = "features", centred: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """``run_id, cluster, n_members, n_segments, typical_ids``: every cluster of every run with its most typical segments.

    Members are the different ``member_id`` with a non-null run and a cluster of 0 or more; all count in ``n_members``,
    whatever their times. A member's segment is the one of its ``utt_id`` whose ends lie nearest to its own, both at
    most two frames away (ties: smallest id). Segments are usable as in ``similarity_groups``, and so is the
    similarity; a segment counts once in a cluster. The most typical ones have the highest mean similarity to the
    cluster's segments (ties: smallest id); a cluster without any has an empty list.
    """
    members = partition.where("run_id is not null and cluster >= 0 and member_id is not null").select("member_id", F.col("run_id").cast("bigint").alias("run_id"), F.col("cluster").cast("bigint").alias("cluster"), "utt_id", "start_sec", "end_sec").dropDuplicates(["member_id"])
    rows = vector_rows(segments, id_col, vector_col)
    vectors = unit_vectors(rows, (centred or centre(rows, dim))[0], dim)
    # Only usable segments can be a member's; the test here needs no vector to be shuffled.
    places = segments.where(F.col("utt_id").isNotNull() & F.col(id_col).isNotNull() & (F.size(vector_col) == dim) & is_usable(vector_col)).select(F.col(id_col).cast("bigint").alias("id"), "utt_id", "start_frame", "end_frame").dropDuplicates(["id"])
    first = F.floor(F.col("start_sec") * 50).cast("int")
    # Both sides meet in slots of 64 frames; a member near the edge of one also looks into the next.
    slots = F.array_distinct(F.array(F.floor((first - 2) / 64), F.floor((first + 3) / 64)))
    near = members.where("utt_id is not null and end_sec > start_sec").withColumn("slot", F.explode(slots)).join(places.withColumn("slot", F.floor(F.col("start_frame") / 64)), ["utt_id", "slot"])
    apart = F.greatest(F.abs(F.col("start_sec") * 50 - F.col("start_frame")), F.abs(F.col("end_sec") * 50 - F.col("end_frame")))
    matched = near.withColumn("apart", F.round(apart, 3)).where("apart <= 2").groupBy("member_id", "run_id", "cluster").agg(F.min(F.struct("apart", "id")).alias("m"))
    # A cluster is one number: its run above its own number, of at most 31 bits.
    chosen = matched.select(F.expr("shiftleft(run_id, 32) + cluster").alias("key"), F.col("m.id").alias("id"))
    picked = most_typical(typicalities(chosen, vectors, dim), typical)
    profiles = picked.select(F.expr("shiftright(key, 32)").alias("run_id"), F.expr("key & 4294967295L").alias("cluster"), F.col("n").alias("n_segments"), "typical_ids")
    out = members.groupBy("run_id", "cluster").agg(F.count("*").alias("n_members")).join(profiles, ["run_id", "cluster"], "left")
    return out.select(F.col("run_id").cast("int").alias("run_id"), F.col("cluster").cast("int").alias("cluster"), "n_members", F.coalesce("n_segments", F.lit(0).cast("bigint")).alias("n_segments"), F.coalesce("typical_ids", F.array().cast("array<bigint>")).alias("typical_ids"))
