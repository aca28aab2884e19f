"""Word shingles of many texts at once, as 63-bit hashes, on the bytes of an Arrow column."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

# Bytes hashed together; a longer text is hashed by itself.
BYTES_AT_ONCE = 1 << 20

_RANDOM = np.random.default_rng(11)
_BY_BYTE = _RANDOM.integers(1, 2**63, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S)) * _M1
    h = (h ^ (h >> _S)) * _M2
    return h ^ (h >> _S)


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BYTES_AT_ONCE, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles as sorted int64 hashes.

    A-Z are lowered; words are runs of bytes other than blanks and \\t to \\r. A text of fewer words than a shingle has
    its whole sequence as the only one; without words the set is empty.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    for first, last in _chunks(offsets):
        begin = offsets[first]
        part = data[begin:offsets[last]]
        edges = offsets[first:last + 1] - begin
        n = len(part)
        if not n:
            for _ in range(first, last):
                yield np.zeros(0, np.int64)
            continue
        up, down = _powers(max(2 * BYTES_AT_ONCE, 1 << (n - 1).bit_length()))
        blank = (part == 32) | ((part >= 9) & (part <= 13))
        apart = np.zeros(n + 1, bool)
        apart[edges] = True
        inner = ~blank
        start = np.flatnonzero(inner & (apart[:n] | np.concatenate([[True], blank[:-1]])))
        end = np.flatnonzero(inner & (apart[1:] | np.concatenate([blank[1:], [True]]))) + 1
        lower = part + (((part >= 65) & (part <= 90)) * np.uint8(32))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BY_BYTE[lower] * up[:n])])
        word = _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
        bounds = np.searchsorted(start, edges).tolist()
        hashed = word.copy()
        for k in range(1, min(words, len(word))):
            hashed[:len(word) - k] = _mix(hashed[:len(word) - k] * _M1 + word[k:])
        for a, b in zip(bounds, bounds[1:]):
            if b - a >= words:
                found = hashed[a:b - words + 1]
            elif b > a:
                few = word[a:a + 1]
                for k in range(1, b - a):
                    few = _mix(few * _M2 + word[a + k:a + k + 1])
                found = few
            else:
                found = word[:0]
            yield np.unique(found >> np.uint64(1)).astype(np.int64)


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
