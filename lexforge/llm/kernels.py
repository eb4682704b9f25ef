"""Vectorised text kernels shared by the operators of this subpackage.

Everything works on the UTF-8 bytes of an Arrow string column, a few MB at a
time, so memory is bounded by ``CHUNK_BYTES`` (or one longer document).
All hashes are 64 bits, equal in every process and on every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64; bijective on 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_BYTE = seeds(256, 17)
_BASE = int(seeds(1, 23)[0]) | 1
_ROLL = int(seeds(1, 29)[0]) | 1
_ROLL_INV = pow(_ROLL, -1, 1 << 64)


class _Powers:
    """Powers of a base modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.table = base, np.ones(1, U64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            step = U64(pow(self.base, len(self.table), 1 << 64))
            self.table = np.concatenate([self.table, self.table * step])
        return self.table[:n]


_POW, _ROLLS, _ROLLS_INV = _Powers(_BASE), _Powers(_ROLL), _Powers(_ROLL_INV)

_b = np.arange(256)
#: Bytes of words that white space separates: anything but 0x20 and 0x09-0x0D.
NOT_SPACE = ~((_b == 0x20) | ((_b >= 0x09) & (_b <= 0x0D)))
#: Bytes of words of lower-cased letters, digits and non-ASCII characters.
ALNUM = ~((_b <= 0x2F) | ((_b >= 0x3A) & (_b <= 0x60)) | ((_b >= 0x7B) & (_b <= 0x7F)))
#: A-Z to a-z, byte by byte.
LOWER = np.where((_b >= 65) & (_b <= 90), _b + 32, _b).astype(np.uint8)


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n, lo + 65_536)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


class Words:
    """Words of a run of documents: ``start``, ``end`` (bytes), ``doc`` (row), ``hash``, and ``first`` (documents' first words, with an end)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, kind: np.ndarray, lower: bool = False, hashes: bool = True) -> None:
        if lower:
            data = LOWER[data]
        n = len(data)
        self.data = data
        mask = kind[data]
        before = np.zeros(n, bool)
        before[1:] = mask[:-1]
        heads = off[:-1][off[:-1] < n]
        before[heads] = False
        after = np.zeros(n, bool)
        after[:-1] = mask[1:]
        tails = off[1:][off[1:] > 0] - 1
        after[tails] = False
        self.start = np.flatnonzero(mask & ~before)
        self.end = np.flatnonzero(mask & ~after) + 1
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self.len = self.end - self.start
        if hashes:
            self.hash = spans_hash(data[mask], self.len)

    def __len__(self) -> int:
        return len(self.start)


def spans_hash(data: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Hash of each of the adjoining, non-empty spans of ``data`` that have these lengths."""
    if not len(lens):
        return np.zeros(0, U64)
    at = np.cumsum(lens) - lens
    where = np.arange(len(data)) - np.repeat(at, lens)
    v = _BYTE[data]
    v *= _POW.upto(int(lens.max()))[where]
    return mix(np.add.reduceat(v, at) ^ (lens.astype(U64) * U64(0x9E3779B97F4A7C15)))


def rolling(h: np.ndarray, w: int) -> np.ndarray:
    """Rabin-Karp hashes of all windows of w consecutive hashes, whatever the document."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, U64)
    s = np.zeros(len(h) + 1, U64)
    np.cumsum(h * _ROLLS.upto(len(h)), out=s[1:])
    return mix((s[w:] - s[:-w]) * _ROLLS_INV.upto(n) + U64(w))


def within(doc: np.ndarray, w: int) -> np.ndarray:
    """Of all windows of w words: whether one document holds it."""
    return doc[: len(doc) - w + 1] == doc[w - 1 :] if len(doc) >= w else np.zeros(0, bool)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Index of the least value in each window of w values, the rightmost of equal ones."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, size = np.arange(len(x)), 1
    while size < w:
        step = min(size, w - size)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(x[b] <= x[a], b, a)
        size += step
    return at


def as_long(h: np.ndarray) -> np.ndarray:
    return h.astype(U64, copy=False).view(np.int64)


def bits_set(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bitmap has the bit of each hash; ``len(bitmap)`` is a power of two."""
    at = h & U64(len(bitmap) * 8 - 1)
    return (bitmap[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys in sorted arrays."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def binary_array(blobs: list[bytes]) -> pa.Array:
    return pa.array(blobs, pa.binary())
