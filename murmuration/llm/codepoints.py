"""Texts of an Arrow batch as one array of code points, so that words are found and hashed without a loop.

Texts stand one after another, each followed by a line feed, which is no part of any word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

LETTER, NUMBER, BLANK, FEED, STOP = 1, 2, 4, 8, 16
#: About as many characters are held at once: 16 MB of text, some 300 MB of arrays in the widest operator.
BATCH_CHARS = 1 << 22
_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """For each code point the bits LETTER, NUMBER, BLANK, FEED and STOP (full stop, exclamation, question mark)."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))[0]
        if c == "L":
            table[cp] = LETTER
        elif c == "N":
            table[cp] = NUMBER
    for c in " \t\r\n":
        table[ord(c)] |= BLANK
    table[10] |= FEED
    for c in ".!?":
        table[ord(c)] |= STOP
    return table


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    """A mixed 64-bit value for each code point."""
    x = np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i up to n; kept and grown."""
    if name not in _powers or len(_powers[name]) < n:
        p = np.full(max(n, BATCH_CHARS // 4), base, np.uint64)
        p[0] = 1
        _powers[name] = np.multiply.accumulate(p)
    return _powers[name][:n]


def span_hashes(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the code points of each span; equal spans have equal hashes anywhere in any text."""
    n = len(cps)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_values()[cps] * _power("up", int(_BASE), n), out=total[1:])
    h = (total[ends] - total[starts]) * _power("down", pow(int(_BASE), -1, 1 << 64), n + 1)[starts]
    return h ^ (h >> np.uint64(32))


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each longest run of True."""
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def to_codepoints(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The joined text, its code points, and where each text ends (at its line feed)."""
    joined = "\n".join(texts) + "\n"
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    return joined, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), ends


def in_portions(batches: Iterator[pa.RecordBatch], text_at: int = 1, most: int = BATCH_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about ``most`` characters at most, and their texts (null as empty). A longer
    text comes alone and whole."""
    for batch in batches:
        col = batch.column(text_at)
        if col.null_count:
            col = col.fill_null("")
        size = np.diff(np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4)) if len(col) else np.zeros(0)
        begin, held = 0, 0
        for i, s in enumerate(size.tolist()):
            if held and held + s > most:
                yield batch.slice(begin, i - begin), col.slice(begin, i - begin).to_pylist()
                begin, held = i, 0
            held += s
        if begin < len(col):
            yield batch.slice(begin), col.slice(begin).to_pylist()
