"""Words of many texts at once: hashes straight from the bytes of an Arrow column, without a Python object per word.

A word's hash is the sum, modulo 2^64, of a random number for each byte times a power of an odd base that counts from the
word's first byte, then mixed by a bijection.  The sum is the difference of two running sums over a block of bytes, divided
by a power of the base, so a block costs the same whatever its words are.  Two words share a hash with a chance of 2^-64,
or a few powers of two more where they have the same bytes in another order.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes whose running sum is taken at once; a longer word makes its block longer.
BLOCK = 1 << 17
_BASE = 0xD6E8FEB86659FD93
#: Numbers of the bytes, equal for A-Z and a-z, and which bytes are white space.
_NUMBER = np.array([xxhash.xxh64_intdigest(bytes([b]).lower(), 0) for b in range(256)], dtype=np.uint64)
_SPACE = np.array([b in b"\t\n\v\f\r " for b in range(256)])
#: Stands for the end of a text; white space cannot be part of a word.
END = np.uint64(xxhash.xxh64_intdigest(b" ", 0))


def _powers(base: int, count: int) -> np.ndarray:
    """The first ``count`` powers of ``base``; those of a usual block are kept."""
    return _grown(base, BLOCK)[:count] if count <= BLOCK else _grown.__wrapped__(base, count)


@lru_cache(maxsize=2)
def _grown(base: int, count: int) -> np.ndarray:
    steps = np.full(count, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _sums(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hash of each data[start:stop], block by block."""
    out, i = np.empty(len(starts), dtype=np.uint64), 0
    while i < len(starts):
        first = starts[i]
        j = max(i + 1, int(np.searchsorted(stops, first + BLOCK, side="right")))
        span = data[first:stops[j - 1]]
        running = np.zeros(len(span) + 1, dtype=np.uint64)
        np.cumsum(_NUMBER[span] * _powers(_BASE, len(span)), out=running[1:])
        low = starts[i:j] - first
        back = _powers(pow(_BASE, -1, 1 << 64), int(low[-1]) + 1)
        out[i:j] = (running[stops[i:j] - first] - running[low]) * back[low]
        i = j
    return _mixed(out)


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, each text's followed by END, and how many each text has.

    Words are what white space leaves, with A-Z lower-cased; null counts as the empty text.
    """
    if not len(texts):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, values = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(values, dtype=np.uint8)[at[0]:at[-1]] if at[-1] > at[0] else np.zeros(0, dtype=np.uint8)
    at = at - at[0]
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begin, end = at[:-1][at[:-1] < len(data)], at[1:][at[1:] > 0] - 1
    first[begin], last[end] = inside[begin], inside[end]  # no word goes on from one text to the next
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    sizes = np.diff(np.searchsorted(starts, at)) + 1
    out = np.full(len(starts) + len(texts), END)
    words = np.ones(len(out), dtype=bool)
    words[np.cumsum(sizes) - 1] = False
    out[words] = _sums(data, starts, stops)
    return out, sizes
