"""Whole-text tokenising over Arrow string buffers with NumPy.

Texts of an Arrow batch lie end to end in one byte buffer, so a block of documents is
split into words and hashed with a few array operations instead of a Python loop over
words. Nothing here truncates a text: a document longer than a block is a block of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def ascii_lower_table() -> np.ndarray:
    """Byte table that lower-cases A-Z and leaves every other byte alone."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def space_separated() -> np.ndarray:
    """Word bytes of ``[^\\x20\\x09-\\x0D]+``; in UTF-8 all bytes of other characters are >= 0x80."""
    table = np.ones(256, dtype=bool)
    table[0x20] = False
    table[0x09:0x0E] = False
    return table


def alphanumeric() -> np.ndarray:
    """Word bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` once A-Z are lower-cased."""
    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = True
    table[0x61:0x7B] = True
    table[0x80:] = True
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift-multiply); a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of byte ranges: a polynomial over random byte values, taken from prefix sums.

    ``hash(s, e) = mix((P[e] - P[s]) * a**-s)`` with ``P`` the running sum of ``value[byte] * a**i``
    modulo 2**64, so equal byte strings hash alike wherever they stand.
    """

    def __init__(self) -> None:
        rng = np.random.Generator(np.random.PCG64(20240229))
        self.values = rng.integers(1, _MASK, size=256, dtype=np.uint64, endpoint=True)
        self.powers = np.ones(1, dtype=np.uint64)
        self.inverses = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 1 << 16)
            for name, base in (("powers", _MULTIPLIER), ("inverses", pow(_MULTIPLIER, -1, 1 << 64))):
                table = np.full(size, base, dtype=np.uint64)
                table[0] = 1
                setattr(self, name, np.cumprod(table, dtype=np.uint64))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), dtype=np.uint64)
        i = 0
        while i < len(starts):
            base = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, base + BLOCK_BYTES, side="right")))
            n = int(ends[j - 1]) - base
            self._grow(n + 1)
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(self.values[data[base : base + n]] * self.powers[:n], out=sums[1:])
            s, e = starts[i:j] - base, ends[i:j] - base
            out[i:j] = mix((sums[e] - sums[s]) * self.inverses[s] + (e - s).astype(np.uint64))
            i = j
        return out


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES):
    """Yield ``(first, last, data, offsets)`` for runs of rows of about ``block_bytes``; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + block_bytes, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Byte starts and ends of all words, and where each document's words begin (n + 1 entries)."""
    if not len(data):
        zero = np.zeros(0, dtype=np.int64)
        return zero, zero, np.zeros(len(offsets), dtype=np.int64)
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)
