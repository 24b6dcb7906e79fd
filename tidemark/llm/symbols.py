"""Texts as numpy arrays of hashed symbols, in slices of bounded size.

Everything here runs inside a task on one Arrow batch.  A text is a run of
UTF-8 bytes in one shared buffer; words are maximal runs of bytes other than
0x20 and 0x09-0x0D.  A null text counts as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18  # symbols worked on at once
LONG_WORD = 4096  # bytes; longer words are hashed one by one
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 3  # odd, 3 modulo 4
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1 modulo 2^64 and their inverses."""
    if "p" not in _powers or len(_powers["p"][0]) < n:
        size = max(n, SLICE + LONG_WORD + 1)
        both = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.ones(size, U)
            done = 1
            while done < size:  # doubling: the second half is the first times b^done
                step = min(done, size - done)
                p[done: done + step] = p[:step] * U(pow(b, done, 1 << 64))
                done += step
            both.append(p)
        _powers["p"] = (both[0], both[1])
    return _powers["p"]


class Spans:
    """Hashes of any spans of one symbol array, from one prefix sum."""

    def __init__(self, values: np.ndarray):
        self.up, down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * down[: len(values)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(U))

    def windows(self, n: int) -> np.ndarray:
        """Hashes of all spans of n symbols, by their start."""
        k = len(self.sums) - n
        return mix((self.sums[n:] - self.sums[:k]) * self.up[:k] + U(n)) if k > 0 else np.empty(0, U)



def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in one array, and each text's offsets (rows + 1)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    offsets = offsets.astype(np.int64)
    raw = raw[offsets[0]: offsets[-1]] if len(offsets) else raw
    return raw, offsets - (offsets[0] if len(offsets) else 0)


def row_groups(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) of at most ``limit`` symbols; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = max(a + 1, min(b, n))
        yield a, b
        a = b


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes of ``raw``) of all words, and word offsets of each text."""
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(raw)]
    begins[first] = inside[first]  # a text begins a word even where the one before ends without space
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(start), U)
    a = 0
    while a < len(start):  # blocks of bytes, cut between words
        b = max(a + 1, int(np.searchsorted(start, start[a] + SLICE)))
        lo = start[a]
        hi = min(int(start[b - 1]) + LONG_WORD, int(end[b - 1]))
        spans = Spans(BYTE[raw[lo:hi]])
        out[a:b] = spans.hash(start[a:b] - lo, np.minimum(end[a:b], hi) - lo)
        a = b
    for i in np.flatnonzero(end - start > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(raw[start[i]: end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingles(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's n-word shingles and their offsets by text.

    A text of fewer words has its whole sequence as its one shingle; without
    words it has none.  Texts are worked on in groups of bounded size.
    """
    size = np.diff(offsets)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(at[-1], U)
    for a, b in row_groups(offsets):
        for lo in range(int(offsets[a]), max(int(offsets[b]), int(offsets[a]) + 1), SLICE):
            hi = min(lo + SLICE + n - 1, int(offsets[b]))
            spans = Spans(hashes[lo:hi])
            start = np.concatenate([[0], np.cumsum(count[a:b])])
            doc = np.repeat(np.arange(b - a), count[a:b])
            begin = offsets[a:b][doc] + np.arange(start[-1]) - start[doc]
            end = np.minimum(begin + n, offsets[a + 1: b + 1][doc])
            here = (begin >= lo) & (begin < lo + SLICE)
            out[at[a]: at[b]][here] = spans.hash(begin[here] - lo, end[here] - lo)
    return out, at
