"""Passages of evaluation items inside documents: CGK embedding, bit-sampling LSH, exact verification.

Every window of ``window`` consecutive words of an item is embedded by a random walk: at step j the word at the
cursor is written down, and a random bit of (j, word) says whether the cursor moves on. Windows at edit distance
e have embeddings at a Hamming distance of about e**2 at most, and equal windows have equal ones. A hash table
keeps, for each window, the embedding at some sampled steps. Windows of documents are walked in the same way, all
windows of a batch at a time, and dropped as soon as what they have written at the sampled steps so far is no
prefix of an entry. A window with edits must also hold an unchanged piece of an item's window; those without one are
dropped first. Several tables with other random bits and samples reach the target recall for windows with
edits; equal windows are found by one table, always. Each candidate is then verified: by the numbers of its words,
many at a time, and those that pass word by word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_table
from .codepoints import LETTER, NUMBER, classes, in_portions, span_hashes, spans, to_codepoints

#: Bytes of the index of one pass over the documents, in each Python worker; more items take more passes.
INDEX_BYTES = 128 << 20
#: Words of an item that are indexed together; a longer item is taken in parts, which overlap.
PART_WORDS = 4096
_MIX = np.uint64(0xD6E8FEB86659FD93)


def words_of(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased texts joined, start, end and hash of each word in them, and the text of each word."""
    joined, cps, ends = to_codepoints([t.lower() for t in texts])
    starts, stops = spans((classes()[cps] & (LETTER | NUMBER)) != 0)
    return joined, starts, stops, span_hashes(cps, starts, stops), np.searchsorted(ends, starts)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    x ^= x >> np.uint64(32)
    return x * _MIX


def passage_distance(item: list[str], text: list[str]) -> int:
    """The least Levenshtein distance of the item's words to any number of the text's first words."""
    row = list(range(len(text) + 1))
    for i, x in enumerate(item, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return min(row)


def passage_distances(items: np.ndarray, texts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``passage_distance`` of each row of words as numbers; of a row of ``texts`` only the first ``length`` words count."""
    n, m = texts.shape
    row = np.broadcast_to(np.arange(m + 1, dtype=np.int16), (n, m + 1)).copy()
    for i in range(items.shape[1]):
        change = row[:, :-1] + (texts != items[:, i : i + 1])
        up = row + 1
        up[:, 1:] = np.minimum(up[:, 1:], change)
        # Words left out of the text cost one each: the least of all places before, each plus the way to it.
        row = np.minimum.accumulate(up - np.arange(m + 1, dtype=np.int16), axis=1) + np.arange(m + 1, dtype=np.int16)
    return np.where(np.arange(m + 1) <= length[:, None], row, np.int16(1 << 14)).min(1)


def table_count(window: int, max_edits: int, recall: float) -> tuple[int, int]:
    """Sampled steps of a hash table, and tables. A pair at distance e differs in about 2 e of the 3 * window steps that
    matter; a sample of s steps misses all of these with probability about exp(-2 e s / window)."""
    steps = min(window, 6) if max_edits else window
    hit = math.exp(-2.0 * max_edits * steps / window)
    return steps, 1 if not max_edits else math.ceil(math.log(1 - recall) / math.log(1 - hit))


class PassageIndex:
    """The hash tables of the items' windows."""

    def __init__(self, ids: list[int], texts: list[str], window: int = 12, max_edits: int = 0, recall: float = 0.999, seed: int = 7) -> None:
        if window < 1 or not 0 <= max_edits < window:
            raise ValueError("window must be at least 1, and max_edits less than it")
        self.window, self.max_edits = window, max_edits
        joined, starts, stops, hashes, text = words_of(texts)
        self.vocabulary = np.unique(hashes)
        word = np.searchsorted(self.vocabulary, hashes) + 1  # 0 is a word that no item has
        first = self._inside(text, window)
        grams = word[first[:, None] + np.arange(window)] if len(first) else np.zeros((0, window), np.int64)
        self.item, self.grams = np.array([ids[t] for t in text[first]], np.int64), grams
        self.text, self.starts, self.stops, self.first = joined, starts, stops, first
        # Of window // (edits + 1) words in a row, at least one such piece of an item's window is left as it is.
        self.piece = window // (max_edits + 1)
        self.pieces = np.unique(self._hash(word, self._inside(text, self.piece))) if max_edits else None
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        rng = np.random.default_rng(seed)
        steps, tables = table_count(window, max_edits, recall)
        self.tables = []
        for _ in range(tables):
            bits = rng.random((3 * window, len(self.vocabulary) + 1)) < 0.5
            bits[:, 0] = True
            chosen = rng.choice(np.arange(1, 2 * window), size=min(steps, 2 * window) - 1, replace=False) if window > 1 else np.zeros(0, np.int64)
            sample = sorted({0, *chosen.tolist()}) if not max_edits else sorted(rng.choice(2 * window, size=steps, replace=False).tolist())
            prefixes, owners = self._walk(np.arange(len(first)), lambda at, i, g=grams: g[at, i], bits, sample, None)
            order = np.argsort(owners[1], kind="stable")
            self.tables.append((bits, sample, prefixes, owners[1][order], owners[0][order]))

    @staticmethod
    def _inside(text: np.ndarray, n: int) -> np.ndarray:
        """Where n words of one text begin."""
        return np.flatnonzero(text[n - 1 :] == text[: len(text) - n + 1]) if len(text) >= n else np.zeros(0, np.int64)

    def _hash(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hashes of the pieces that begin there."""
        h = np.zeros(len(at), np.uint64)
        for k in range(self.piece):
            h = _mixed(h + word[at + k].astype(np.uint64) + np.uint64(k))
        return h

    def _walk(self, at: np.ndarray, word: object, bits: np.ndarray, sample: list[int], known: list[np.ndarray] | None) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Walk all windows; ``known`` are the prefix hashes that may go on. Returns the prefix hashes seen, and
        the windows left with their full hashes."""
        cursor = np.zeros(len(at), np.int64)
        hashes = np.zeros(len(at), np.uint64)
        seen: list[np.ndarray] = []
        for step in range(sample[-1] + 1):
            here = np.where(cursor < self.window, word(at, np.minimum(cursor, self.window - 1)), 0)
            if step in sample:
                hashes = _mixed(hashes + here.astype(np.uint64) + np.uint64(step))
                if known is None:
                    seen.append(np.unique(hashes))
                elif len(table := known[len(seen)]):
                    keep = table[np.minimum(np.searchsorted(table, hashes), len(table) - 1)] == hashes
                    at, cursor, hashes, here = at[keep], cursor[keep], hashes[keep], here[keep]
                    seen.append(table)
                else:
                    return seen, (at[:0], hashes[:0])
            cursor += bits[step][here]
        return seen, (at, hashes)

    def find(self, texts: list[str]) -> list[tuple[int, int]]:
        """(text, item) for each text with a window within ``max_edits`` edits of one of the item's windows."""
        if not len(self.item):
            return []
        joined, starts, stops, hashes, text = words_of(texts)
        if not len(hashes):
            return []
        word = np.zeros(len(hashes) + self.window, np.int64)
        maybe = np.flatnonzero(self.filter[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        word[maybe] = np.where(self.vocabulary[at] == hashes[maybe], at + 1, 0)
        least = self.window - self.max_edits
        last = np.append(text, -1)[np.minimum(np.arange(len(hashes)) + least - 1, len(hashes))]
        whole = last == text  # passages that can end within their text
        if self.pieces is not None:
            whole &= self._with_piece(word, text)
        pairs: list[np.ndarray] = []
        for bits, sample, prefixes, table, owner in self.tables:
            begin = np.flatnonzero(whole & (word[: len(hashes)] > 0)) if sample[0] == 0 else np.flatnonzero(whole)
            _, (found, full) = self._walk(begin, lambda p, i: word[p + i], bits, sample, prefixes)
            lo, hi = np.searchsorted(table, full), np.searchsorted(table, full, "right")
            n = hi - lo
            which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pairs.append(np.stack([np.repeat(found, n), owner[which]], 1))
        candidates = np.unique(np.concatenate(pairs), axis=0)
        ends = np.searchsorted(text, np.arange(len(texts)), side="right")  # where each text's words end
        if self.max_edits:
            candidates = candidates[self._near(word, ends[text[candidates[:, 0]]], candidates)]
        order = np.lexsort((candidates[:, 0], self.item[candidates[:, 1]], text[candidates[:, 0]]))
        ends = np.searchsorted(text, np.arange(len(texts)), side="right")  # where each text's words end
        out: list[tuple[int, int]] = []
        for p, g in candidates[order].tolist():
            pair = (int(text[p]), int(self.item[g]))
            if (not out or out[-1] != pair) and self._verified(joined, starts, stops, p, int(ends[text[p]]), g):
                out.append(pair)
        return out

    def _with_piece(self, word: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Whether the longest passage that begins at each word holds a piece of an item's window."""
        at = self._inside(text, self.piece)
        unknown = np.append(0, np.cumsum(word[: len(text)] == 0))
        at = at[unknown[at + self.piece] == unknown[at]]
        h = self._hash(word, at)
        known = self.pieces[np.minimum(np.searchsorted(self.pieces, h), len(self.pieces) - 1)] == h
        longest = self.window + self.max_edits
        begins = np.zeros(len(text) + 1 + longest, np.int64)
        begins[at[known] + 1] = 1
        so_far = np.cumsum(begins)
        here = np.arange(len(text))
        return so_far[here + longest - self.piece + 1] > so_far[here]

    def _near(self, word: np.ndarray, ends: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Which candidates are within the edits by the numbers of their words. A number stands for a hash, so those left
        out are farther apart for certain; the others are verified by the words themselves."""
        longest = self.window + self.max_edits
        keep = np.zeros(len(candidates), bool)
        for begin in range(0, len(candidates), 8192):
            p, g = candidates[begin : begin + 8192].T
            own = word[np.minimum(p[:, None] + np.arange(longest), len(word) - 1)]
            length = np.minimum(ends[begin : begin + 8192] - p, longest)
            keep[begin : begin + 8192] = passage_distances(self.grams[g], own, length) <= self.max_edits
        return keep

    def _verified(self, joined: str, starts: np.ndarray, stops: np.ndarray, p: int, end: int, g: int) -> bool:
        own = [joined[starts[k] : stops[k]] for k in range(p, min(p + self.window + self.max_edits, end))]
        at = int(self.first[g])
        of_item = [self.text[self.starts[k] : self.stops[k]] for k in range(at, at + self.window)]
        return own == of_item if not self.max_edits else passage_distance(of_item, own) <= self.max_edits


def item_parts(items: DataFrame, window: int, part_words: int = PART_WORDS) -> DataFrame:
    """``item_id, part, item_text, n``: items of more than ``part_words`` words in parts that share ``window - 1`` words
    with the next, so that every window is whole in one of them; ``n`` is a part's number of words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                joined, starts, stops, _, _ = words_of([text])
                firsts = range(0, max(len(starts) - window + 1, 0), part_words)
                lasts = [min(k + part_words + window - 1, len(starts)) for k in firsts]
                parts = [joined[starts[a] : stops[b - 1]] for a, b in zip(firsts, lasts)]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string()), pa.array([b - a for a, b in zip(firsts, lasts)], pa.int64())], names=["item_id", "part", "item_text", "n"])

    return items.mapInArrow(cut, "item_id bigint, part int, item_text string, n bigint")


def leaked_items(documents: DataFrame, items: DataFrame, window: int = 12, max_edits: int = 0, recall: float = 0.999, index_bytes: int = INDEX_BYTES, part_words: int = PART_WORDS) -> DataFrame:
    """``doc_id, item_id`` (different pairs) of documents that hold a passage of an item.

    ``documents`` has ``doc_id bigint, text string`` and ``items`` has ``item_id bigint, item_text string``; other
    columns are not read. Words are the longest runs of letters and digits of the lower-cased text. A passage is a
    number of consecutive words that ``max_edits`` inserted, deleted or changed words at most turn into ``window``
    consecutive words of the item; with 0, all of them are found, else a share of about ``recall`` of the passages.
    Items with fewer words than ``window`` have no passage. Null and empty texts and rows with a null id give no row.
    The driver and each Python worker hold the index of one block of items, of about ``index_bytes``; each block is
    one pass over the documents. Long items are cut into parts, so a block is no larger for them.
    """
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    usable = items.where("item_id is not null and item_text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "item_text").distinct()
    parts = write_table(item_parts(usable, window, part_words), "items").df
    # Of each word the index keeps its place, and a hash and an owner in each table.
    words = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    passes = max(1, math.ceil(words * (40 + 16 * table_count(window, max_edits, recall)[1]) / index_bytes))
    out = None
    for k in range(passes):
        block = parts.where(F.pmod(F.xxhash64("item_id", "part"), F.lit(passes)) == k).orderBy("item_id", "part").toArrow()
        index = PassageIndex(block["item_id"].to_pylist(), block["item_text"].to_pylist(), window, max_edits, recall)
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch, texts in in_portions(batches):
                pairs = index.find(texts)
                ids = batch.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[[t for t, _ in pairs]].astype(np.int64)), pa.array([i for _, i in pairs], pa.int64())], names=["doc_id", "item_id"])

        found = docs.mapInArrow(search, "doc_id bigint, item_id bigint")
        out = found if out is None else out.union(found)
    return out.distinct()
