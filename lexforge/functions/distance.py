"""Edit distances and neighbourhoods. The Arrow functions are meant for distinct candidate pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashes import mix, powers
from .text import MARK_ORDER

#: Keys that neighbour each other in the three rows of a keyboard.
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")


def keyboard_neighbours() -> frozenset[tuple[str, str]]:
    at = {c: (r, i + 0.5 * r) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
    return frozenset((a, b) for a in at for b in at if a != b and abs(at[a][0] - at[b][0]) <= 1 and abs(at[a][1] - at[b][1]) <= 1)


_NEAR = keyboard_neighbours()


def alignment(a: str, b: str, change=lambda x, y: 1.0, drop=lambda x: 1.0, swap: float = 1.0) -> float:
    """Cost of the optimal string alignment: no part is edited twice, neighbours may swap."""
    prev2: list[float] = []
    prev = [0.0]
    for y in b:
        prev.append(prev[-1] + drop(y))
    for i, x in enumerate(a, 1):
        row = [prev[0] + drop(x)]
        for j, y in enumerate(b, 1):
            best = min(prev[j] + drop(x), row[-1] + drop(y), prev[j - 1] + (0.0 if x == y else change(x, y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                best = min(best, prev2[j - 2] + swap)
            row.append(best)
        prev2, prev = prev, row
    return prev[-1]


def weighted(a: str, b: str, near: float = 0.5, mark: float = 0.5, swap: float = 0.7) -> float:
    """Alignment in which neighbours on the keyboard, marks and swaps cost less."""
    return alignment(a, b, lambda x, y: near if (x, y) in _NEAR else 1.0, lambda x: mark if x in MARK_ORDER else 1.0, swap)


@F.pandas_udf(T.IntegerType())
def osa(a: pd.Series, b: pd.Series) -> pd.Series:
    """Optimal string alignment distance; null if either is."""
    return pd.Series([None if x is None or y is None else int(alignment(x, y)) for x, y in zip(a, b, strict=True)], dtype="Int32")


@F.pandas_udf(T.DoubleType())
def weighted_osa(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else weighted(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.IntegerType())
def sequence_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Alignment over parts (such as syllables) instead of characters."""
    return pd.Series([None if x is None or y is None else int(alignment(list(x), list(y))) for x, y in zip(a, b, strict=True)], dtype="Int32")


def deletes(word: Column, distance: int = 1, prefix: int = 10) -> Column:
    """The word's prefix and what is left of it without up to ``distance`` (1 or 2) characters; never the empty string."""
    start = F.substring(word, 1, prefix)

    def once(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.lit(prefix))))

    out = F.concat(F.array(start), once(start))
    if distance > 1:
        again = F.flatten(F.transform(F.filter(once(start), lambda x: F.length(x) > 0), once))
        out = F.concat(out, again)
    return F.array_distinct(F.filter(out, lambda x: x != ""))


@F.arrow_udf(T.ArrayType(T.LongType()))
def deletion_hashes(words: pa.Array) -> pa.Array:
    """64-bit hashes of what ``deletes`` gives of whole words, without the strings; a word of one character has its own only."""
    out = []
    for word in words.to_pylist():
        v = mix(np.frombuffer((word or "").encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
        n, (pow_, back) = len(v), powers(len(v))
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * pow_, dtype=np.uint64)])
        less = mix((upto[:-1] + (upto[-1] - upto[1:]) * back) ^ np.uint64(n - 1)) if n > 1 else np.zeros(0, np.uint64)
        out.append(np.unique(np.concatenate([mix(upto[-1:] ^ np.uint64(n)), less]).view(np.int64)) if n else np.zeros(0, np.int64))
    return pa.array(out, pa.list_(pa.int64()))


def char_bigrams(word: Column) -> Column:
    return F.when(F.length(word) > 1, F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.substring(word, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the multisets of character bigrams; 0 without any."""
    x, y = char_bigrams(a), char_bigrams(b)
    n = F.size(x) + F.size(y)
    times = lambda arr, v: F.size(F.filter(arr, lambda z: z == v))
    both = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, v: s + F.least(times(x, v), times(y, v)))
    return F.when(n > 0, 2.0 * both / n).otherwise(F.lit(0.0))


def set_overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays as sets; 0 if both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))
