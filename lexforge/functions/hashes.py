"""Tokens of texts, and 64-bit hashes of tokens and pairs, as arrays: equal in every process and on every run."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BLANK = np.isin(np.arange(256), [9, 10, 13, 32])
_GOLD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64; bijective on 64 bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_GOLD))
_BASE = int(_BYTE[100]) | 1
_powers = np.ones(1, U64)


def _upto(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * U64(pow(_BASE, len(_powers), 1 << 64))])
    return _powers[:n]


def powers(n: int) -> tuple[np.ndarray, np.uint64]:
    """Powers of an odd base, and what divides by it."""
    return _upto(n), U64(pow(_BASE, -1, 1 << 64))


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, last byte + 1, text) of what stands between blanks, tabs and line ends; a text that begins where another ends begins a token."""
    solid = ~_BLANK[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edges = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
    first[edges], last[edges - 1] = solid[edges], solid[edges - 1]
    begin = np.flatnonzero(first)
    return begin, np.flatnonzero(last) + 1, np.searchsorted(off, begin, "right") - 1


def of_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each of the non-empty spans, which follow one another."""
    if not len(begin):
        return np.zeros(0, U64)
    lens = end - begin
    at = np.cumsum(lens) - lens
    where = np.arange(int(lens.sum())) - np.repeat(at, lens)
    v = _BYTE[data[np.repeat(begin, lens) + where]] * _upto(int(lens.max()))[where]
    return mix(np.add.reduceat(v, at) ^ (lens.astype(U64) * U64(_GOLD)))


def of_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U64(3) + mix(b + U64(_GOLD)))


def of_word(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(of_spans(data, np.array([0]), np.array([len(data)]))[0]) if len(data) else 0
