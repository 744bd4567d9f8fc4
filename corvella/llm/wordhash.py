"""Words of whole Arrow text columns as 64-bit hashes, found and hashed without a Python object per word.

A word's hash takes eight bytes at a time through a mixing step that is no polynomial of them; words of more than LONG
bytes are hashed by blake2b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of words, after lower-casing A-Z: all but ASCII white space; or ASCII letters, digits and all of other scripts.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

LONG = 64
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xE9846AF9B1A615D3)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def hash_words(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the words data[start : start + size]."""
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", raw, strides=(1,))  # the eight bytes from each place
    h = (size.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    take = lambda at, left: eight[at] & _KEEP[np.minimum(left, 8)]
    step = lambda h, x: scramble(h ^ x) + h * np.uint64(0xD6E8FEB86659FD93)
    if len(size):
        h = step(h, take(start, size))
        more = np.flatnonzero((size > 8) & (size <= LONG))
        at, left = start[more], size[more]
        while len(more):
            at, left = at + 8, left - 8
            h[more] = step(h[more], take(at, left))
            going = left > 8
            more, at, left = more[going], at[going], left[going]
        for k in np.flatnonzero(size > LONG).tolist():
            h[k] = int.from_bytes(hashlib.blake2b(data[start[k] : start[k] + size[k]], digest_size=8).digest(), "little")
    return scramble(h)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls have no bytes."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Words:
    """Words of some texts: data (bytes, A-Z lower-cased if so asked), start, end (places in data), doc (row), hash, first (by row, into the words)."""

    def __init__(self, column: pa.Array, kind: np.ndarray, lower: bool = True):
        raw, at = text_buffer(column)
        self.data = _LOWER[raw] if lower else raw
        n, rows = len(raw), len(at) - 1
        inside = kind[self.data]
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        if n:
            before[at[:-1][at[:-1] < n]] = False
            after[at[1:][at[1:] > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.hash = hash_words(self.data, self.start, self.end - self.start)
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(rows), self.count)


def pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of each have about most bytes (or are a single one)."""
    for batch in batches:
        size = batch.column(column).cast(pa.large_string())
        lengths = np.diff(text_buffer(size)[1])
        group = np.cumsum(lengths) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
