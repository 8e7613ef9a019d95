"""Word shingles of whole batches of texts as arrays of hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together; a longer text is hashed alone.
CHUNK_BYTES = 1 << 18

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo two to the 64."""
    if len(_POWERS[0]) < n:
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, CHUNK_BYTES), b, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and how many each text has. Words: runs of ASCII letters and digits and of bytes from 128."""
    n = len(data)
    is_word = _WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts, ends = is_word.copy(), is_word.copy()
    starts[1:] &= ~is_word[:-1] | edge[1:n]
    ends[:-1] &= ~is_word[1:] | edge[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, inverse = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    hashes = mix((sums[e] - sums[s]) * inverse[s]) if len(s) else np.empty(0, np.uint64)
    return hashes, np.diff(np.searchsorted(s, offsets))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles as (text, 48-bit hash, count), by text and hash. A text with fewer words is one shingle of all."""
    words, count = word_hashes(data, offsets)
    first = np.cumsum(count) - count
    made = np.where(count >= size, count - size + 1, (count > 0).astype(count.dtype))
    text = np.repeat(np.arange(len(count)), made)
    at = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(made) - made, made)
    h = np.zeros(len(at), np.uint64)
    padded = np.r_[words, np.zeros(size, np.uint64)]
    for k in range(size):
        h += np.where(k < count[text], padded[at + k], np.uint64(0)) * _PLACES[k]
    key = np.sort((text.astype(np.uint64) << np.uint64(48)) | (mix(h) >> np.uint64(16)))
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    weight = np.diff(np.r_[new, len(key)])
    key = key[new]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), weight


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a string column: first and end row, their bytes, and the offsets in these."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, min(a + 4096, int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES, side="right")) - 1))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b
