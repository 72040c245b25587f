"""Vectorised byte kernels over Arrow string batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are worked on at once; a longer text is a piece of its own.
CHUNK_BYTES = 1 << 19
_P = 0x9E3779B97F4A7C55
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

SEP = np.zeros(256, bool)
SEP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        a = np.full(n + 1, base, np.uint64)
        a[0] = 1
        have = _powers[base] = np.cumprod(a, dtype=np.uint64)
    return have[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its offsets; null counts as empty."""
    column = column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) or pa.types.is_string(column.type) else column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(buf: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of runs of whole texts of about ``limit`` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Rolling:
    """Hashes of any substring of a buffer from one prefix sum (polynomial modulo 2**64)."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power(_P, n)[:n], out=self.sums[1:])
        self.inverse = power(_PINV, n)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of other bytes than white space, and the first word of each text."""
    n = len(buf)
    solid = np.zeros(n + 1, bool)
    solid[:n] = ~SEP[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = solid[:n]
    starts = np.flatnonzero(solid & (~before | edge))
    ends = np.flatnonzero(before & (~solid | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def word_ids(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: eight bytes at a time through a finaliser, longer words than 64 bytes by BLAKE2.

    The steps are not linear, so no family of words collides by its structure; equal ones need chance (2**-64 a pair).
    """
    size = ends - starts
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    h = mix(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    live = np.arange(len(size))
    for k in range(0, 64, 8):
        live = live[size[live] > k]
        if not len(live):
            break
        rest = np.minimum(size[live] - k, 8).astype(np.uint64)
        v = eight[starts[live] + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest))
        h[live] = mix(h[live] ^ v)
    for i in np.flatnonzero(size > 64).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


def _blocks(buf: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[np.ndarray]:
    """A text in blocks of about ``limit`` bytes that end behind white space; a longer word stays whole."""
    begin, n = 0, len(buf)
    while n - begin > 2 * limit:
        end = begin + limit
        while end < n:
            gap = SEP[buf[end : end + 65536]]
            if gap.any():
                end += int(gap.argmax()) + 1
                break
            end = min(n, end + 65536)
        yield buf[begin:end]
        begin = end
    yield buf[begin:]


def _words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of lower-cased texts, and the first of each text."""
    if len(offsets) == 2 and len(buf) > 2 * CHUNK_BYTES:
        parts = []
        for b in _blocks(buf):
            low = LOWER[b]
            starts, ends, _ = words(low, np.array([0, len(b)]))
            parts.append(word_ids(low, starts, ends))
        w = np.concatenate(parts)
        return w, np.array([0, len(w)])
    low = LOWER[buf]
    starts, ends, first = words(low, offsets)
    return word_ids(low, starts, ends), first


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit ids of its distinct shingles of ``width`` words, after lower-casing A-Z.

    A text of fewer words has its whole sequence as the only one; one without words has none. Long texts are read in
    blocks, so beside the words' hashes a task holds a few bytes for each byte of a block.
    """
    w, first = _words_of(buf, offsets)
    grams = np.zeros(max(0, len(w) - width + 1), np.uint64)
    for k in range(width):
        grams += w[k : k + len(grams)] * power(0xA0761D6478BD642F, width)[k + 1]
    grams = mix(grams)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            yield mix((w[a:b] * power(0xE7037ED1A0B428DB, width)[1 : b - a + 1]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)
