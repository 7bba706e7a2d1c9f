"""Words and hashes of UTF-8 text in numpy, over the bytes of an Arrow column.

Text is cut into slices of about a megabyte (one row at least), so memory is
bounded by the slice or the longest row, and every step is vectorised.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_M = (1 << 64) - 1
#: Bytes up to which a word is hashed by polynomials modulo 2**64. From some 500 on there are words that
#: collide under every odd base (Thue-Morse words); well below that there are none of this kind.
LONG_WORD = 64
#: Odd multipliers of the two polynomial hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words of letters, digits and non-ASCII bytes: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z is lower-cased.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Words between ASCII white space: [^\x20\x09-\x0D]+.
SPACED = np.ones(256, dtype=bool)
SPACED[32] = False
SPACED[9:14] = False

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 16 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(data: np.ndarray, base: int) -> np.ndarray:
    """s with s[j] - s[i] = sum of (data[t] + 1) * base**t over i <= t < j."""
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the byte ranges [start, end), equal for equal bytes wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(pow(base, -1, 1 << 64), len(sums))[start])


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows in bytes); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, at, body = column.buffers()
    at = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + n + 1]
    body = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, side="right")) - 1)
        yield low, high, body[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high
    pa.default_memory_pool().release_unused()  # else a worker keeps what its largest batches took


@dataclass
class Words:
    """Words of the rows of a slice, in order; rows [first[r], first[r+1]) belong to row r."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    sums: np.ndarray
    lowered: np.ndarray

    def hashes(self, which: int = 0) -> np.ndarray:
        """A hash of each word; those of more than LONG_WORD bytes, among which the polynomials are known to meet, by BLAKE2."""
        sums = self.sums if which == 0 else prefix_sums(self.lowered, BASES[which])
        found = range_hash(sums, self.start, self.end, BASES[which])
        for at in np.flatnonzero(self.end - self.start > LONG_WORD).tolist():
            word = self.lowered[self.start[at] : self.end[at]]
            found[at] = int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=bytes([which])).digest(), "little")
        return found


def words(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> Words:
    """The maximal runs of bytes of the kind, with A-Z lower-cased; none crosses rows."""
    inside = kind[data]
    begins, ends = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = at[(at > 0) & (at < len(data))]
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    lowered = _LOWER[data]
    first = np.searchsorted(start, at)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return Words(start, end, row, first, prefix_sums(lowered, BASES[0]), lowered)


def grams(hashes: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A hash of each run of size successive word hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, (size * 0x9E3779B97F4A7C15 + salt) & _M, dtype=np.uint64)
    for j in range(size):
        total += hashes[j : j + n] * powers(0xA0761D6478BD642F, size + 1)[j + 1]
    return mix(total)


def binary_rows(matrix: np.ndarray, empty: np.ndarray | None = None) -> pa.Array:
    """Each row of a C-ordered matrix as one binary value; empty marks rows without value bytes."""
    width = matrix.dtype.itemsize * matrix.shape[1]
    if empty is not None:
        matrix = matrix[~empty]
        sizes = np.where(empty, 0, width)
    else:
        sizes = np.full(len(matrix), width)
    at = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=at[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(matrix).tobytes())])
