"""Vectorised text primitives over Arrow string columns.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` in the UTF-8 text, so
word boundaries are those of the code-point pattern (the separators are ASCII).
All functions work on the flat UTF-8 buffer of many documents at once; no Python
string is made.  Hash values depend only on the bytes, never on the process.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once; a longer document is handled alone and whole.
CHUNK_BYTES = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LOWER = _LOWER.astype(np.uint8)
#: Longer ranges are hashed one by one; shorter ones eight bytes a step, all at once.
LONG = 256
_STEPS = (U64(0x9FB21C651E98DF25), U64(0xC2B2AE3D27D4EB4F))
_STARTS = (U64(0x2545F4914F6CDD1D), U64(0x9E3779B97F4A7C15))


class Flat(NamedTuple):
    """The documents ``first .. first + n`` of a column as one byte buffer."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def flatten(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, raw = column.buffers()
    if at is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Flat]:
    """Consecutive pieces of at most ``limit`` bytes, whole documents each."""
    data, offsets = flatten(column)
    n, k = len(offsets) - 1, 0
    while k < n:
        e = max(k + 1, int(np.searchsorted(offsets, offsets[k] + limit, "right")) - 1)
        yield Flat(k, data[offsets[k] : offsets[e]], offsets[k : e + 1] - offsets[k])
        k = e


class Words(NamedTuple):
    """Byte ranges of the words; document d owns words ``at[d] .. at[d + 1]``."""

    start: np.ndarray
    end: np.ndarray
    at: np.ndarray


def words(flat: Flat) -> Words:
    n = len(flat.data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(flat.n + 1, np.int64))
    inside = ~_SPACE[flat.data]
    cut = np.zeros(n + 1, bool)
    cut[flat.offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(start, end, np.searchsorted(start, flat.offsets))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each byte range, A-Z folded first if ``lower``."""
    return _range_hashes(_LOWER[data] if lower else data, start, end, 0)


def range_hashes2(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Another 64-bit hash of each byte range, A-Z folded, of another function."""
    return _range_hashes(_LOWER[data], start, end, 1)


def _range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """The state takes in eight bytes a step and is mixed after each, so that no algebra of
    the bytes (periods, swaps, Thue-Morse strings) survives; ranges over LONG bytes go
    through xxh3.  ``which`` picks one of two unrelated functions."""
    size = end - start
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    h = mix(size.astype(U64) * _STEPS[1 - which] + _STARTS[which])
    live = np.flatnonzero((size > 0) & (size <= LONG))
    at = start[live]
    while len(live):
        left = end[live] - at
        x = eight[at] & (U64((1 << 64) - 1) >> ((8 - np.minimum(left, 8)).astype(U64) * U64(8)))
        h[live] = mix((h[live] ^ x) * _STEPS[which] + _STARTS[1 - which])
        on = left > 8
        live, at = live[on], at[on] + 8
    long = np.flatnonzero(size > LONG)
    if len(long):
        import xxhash

        raw = data.tobytes()
        h[long] = [xxhash.xxh3_64_intdigest(raw[a:b], which + 1) for a, b in zip(start[long].tolist(), end[long].tolist())]
    return h


def word_hashes(flat: Flat, w: Words, lower: bool = True) -> np.ndarray:
    return range_hashes(flat.data, w.start, w.end, lower)


def shingles(hashes: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words, and each document's range of them.

    A document with fewer words but at least one has one window: all its words.
    """
    n = np.diff(at)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    to = np.concatenate(([0], np.cumsum(counts)))
    doc = np.repeat(np.arange(len(n)), counts)
    where = at[doc] + np.arange(to[-1]) - to[doc]
    width = np.minimum(n, size)[doc]
    h = np.zeros(len(where), U64)
    for k in range(size):
        live = width > k
        nxt = mix(h * U64(0x9FB21C651E98DF25) + hashes[np.where(live, where + k, 0)] + U64(k + 1)) if len(hashes) else h
        h = np.where(live, nxt, h)
    return h, to


def distinct_sorted(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's values sorted and without repeats, with new ranges."""
    v = values.copy()
    for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
        v[s:e].sort()
    keep = np.ones(len(v), bool)
    keep[1:] = v[1:] != v[:-1]
    keep[at[:-1][at[:-1] < len(v)]] = True
    total = np.concatenate(([0], np.cumsum(keep)))
    return v[keep], total[at]
