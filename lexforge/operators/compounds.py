"""Strings as words of a table with one edit in each, many strings at once, without a row for a piece of a string.

The terms come to each worker as 64-bit hashes of themselves and of what an edit leaves of them. All strings of one length are cut in the same places at once:
first into terms as they are; what can't be cut so is cut with edits. Terms with more hashes than a worker shall hold stay behind as rows, from the shortest length on
that doesn't fit: for these a bitmap says which pieces may match, and only those that a best split may have are asked for.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import alignment
from ..functions.hashes import U64, mix
from ..session import kept

_NONE = np.int32(2**31 - 1)
#: Score of an edit, above any sum of uses; score of what can't be.
_EDIT, _NEVER = 1 << 50, 1 << 60
_B = 0x9E3779B97F4A7C15 | 1
_POW = np.array([pow(_B, k, 1 << 64) for k in range(4096)], U64)
_ANY, _LESS, _MASKED = U64(0xD1B54A32D192ED03), U64(0x8CB92BA72F3D8DD7), U64(0xAEF17502108EF2D9)
_AT_ONCE = 8192


class _Hashes:
    """Hashes of all pieces of strings of one length, and of what an edit makes of them: rows are places, columns strings."""

    def __init__(self, texts: list[str], n: int) -> None:
        chars = np.array(texts, f"<U{n}").view(np.uint32).reshape(-1, n)
        self.v = mix(np.ascontiguousarray(chars.T).astype(U64) + U64(1))
        self.h = np.zeros((n + 1, len(texts)), U64)
        for i in range(n):
            self.h[i + 1] = self.h[i] * _POW[1] + self.v[i]

    def piece(self, i: int, j: int) -> np.ndarray:
        return self.h[j] - self.h[i] * _POW[j - i]

    def without(self, i: int, j: int, k: int) -> np.ndarray:
        return self.h[j] + (self.h[k] - self.h[k + 1]) * _POW[j - k - 1] - self.h[i] * _POW[j - i - 1]

    def masked(self, own: np.ndarray, j: int, k: int) -> np.ndarray:
        return mix((own + (_ANY - self.v[k]) * _POW[j - k - 1]) ^ _MASKED)

    def swapped(self, own: np.ndarray, j: int, k: int) -> np.ndarray:
        d = self.v[k + 1] - self.v[k]
        return mix(own + d * _POW[j - k - 1] - d * _POW[j - k - 2])


class _Bits:
    """Bitmap of hashes by their first bits."""

    def __init__(self, n: int, most: int = 30) -> None:
        b = min(most, max(10, math.ceil(math.log2(max(1, n) * 24))))
        self.shift, self.bits = U64(64 - b), np.zeros(1 << (b - 3), np.uint8)

    def add(self, h: np.ndarray) -> None:
        x = h >> self.shift
        np.bitwise_or.at(self.bits, (x >> U64(3)).astype(np.int64), np.left_shift(1, (x & U64(7)).astype(np.uint8)).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        x = h >> self.shift
        return (self.bits[(x >> U64(3)).view(np.int64)] >> (x & U64(7)).astype(np.uint8)) & np.uint8(1)


class _Table:
    """The least rank of each hash."""

    def __init__(self, keys: list[np.ndarray], ranks: list[np.ndarray]) -> None:
        k, r = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((keys, U64), (ranks, np.int32)))
        order = np.argsort(k, kind="stable")
        k, r = k[order], r[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]][: len(k)])
        self.keys, self.ranks = k[first], np.minimum.reduceat(r, first) if len(k) else r
        self.bits = _Bits(len(self.keys))
        self.bits.add(self.keys)

    def lower(self, best: np.ndarray, h: np.ndarray) -> None:
        """``best`` becomes the rank of the hash where that is less."""
        at = np.flatnonzero(self.bits.has(h))
        if len(at) and len(self.keys):
            x = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            ok = self.keys[x] == h[at]
            at, x = at[ok], x[ok]
            best[at] = np.minimum(best[at], self.ranks[x])


def _by_length(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    n = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    for m in np.unique(n).tolist():
        yield m, np.flatnonzero(n == m)


def _traces(h: _Hashes, n: int) -> Iterator[np.ndarray]:
    """What one edit leaves of strings: without a character, and with one masked."""
    own = h.piece(0, n)
    for k in range(n if n > 1 else 0):
        yield mix(h.without(0, n, k) ^ _LESS)
        yield h.masked(own, n, k)


class Lexicon:
    """Terms in the order of preference (their rank). ``longest``: traces of terms up to so many characters are here, those of longer ones in the bitmap only."""

    def __init__(self, terms: pa.Array, uses: np.ndarray, longest: int) -> None:
        self.terms, self.uses, self.longest = terms, uses, longest
        keys, ranks, tkeys, tranks = [], [], [], []
        groups = list(_by_length(terms))
        self.all_here = all(m <= longest for m, _ in groups)
        self.maybe = _Bits(sum(2 * m * len(at) for m, at in groups if m > longest))
        for m, every in groups:
            for lo in range(0, len(every), 1 << 16):
                at = every[lo : lo + (1 << 16)]
                h = _Hashes(terms.take(pa.array(at)).to_pylist(), m)
                keys.append(mix(h.piece(0, m)))
                ranks.append(at.astype(np.int32))
                for t in _traces(h, m):
                    if m <= longest:
                        tkeys.append(t)
                        tranks.append(at.astype(np.int32))
                    else:
                        self.maybe.add(t)
        self.exact, self.traces = _Table(keys, ranks), _Table(tkeys, tranks)

    def cost(self, rank: np.ndarray, edits: int) -> np.ndarray:
        out = np.full(len(rank), _NEVER, np.int64)
        at = np.flatnonzero(rank != _NONE)
        out[at] = edits * _EDIT - self.uses[rank[at]]
        return out


class _Cut:
    """Strings of one length with, for each piece, the rank of the term that it is (``exact``) or is one edit from (``near``)."""

    def __init__(self, texts: list[str], n: int, lex: Lexicon, shortest: int) -> None:
        self.n, self.lex, self.h = n, lex, _Hashes(texts, n)
        self.places = [(i, j) for j in range(shortest, n + 1) for i in range(j - shortest + 1)]
        self.own = {(i, j): self.h.piece(i, j) for i, j in self.places}
        self.exact = {}
        for at, own in self.own.items():
            lex.exact.lower(rank := np.full(len(texts), _NONE, np.int32), mix(own))
            self.exact[at] = rank

    def edit(self) -> None:
        """Find ``near``, and for pieces of which longer terms' traces are elsewhere the hashes to ask for: (place, column, hash) in ``asks``."""
        self.near, self.asks = {}, {}
        for (i, j), own in self.own.items():
            rank = np.full(len(own), _NONE, np.int32)
            less, h, lex = mix(own ^ _LESS), self.h, self.lex
            masks = [h.masked(own, j, k) for k in range(i, j)] if j - i > 1 else []
            for k in range(i, j if j - i > 1 else i):
                lex.exact.lower(rank, mix(h.without(i, j, k)))
                if k + 1 < j:
                    lex.exact.lower(rank, h.swapped(own, j, k))
            for t in (less, *masks):
                lex.traces.lower(rank, t)
            self.near[i, j] = rank
            away = ([less] if j - i + 1 > lex.longest else []) + (masks if j - i > lex.longest else [])
            if away and not lex.all_here:
                found = [(np.flatnonzero(lex.maybe.has(t)), t) for t in away]
                col, key = np.concatenate([c for c, _ in found]), np.concatenate([t[c] for c, t in found])
                open_ = self.exact[i, j][col] == _NONE
                if open_.any():
                    self.asks[i, j] = col[open_], key[open_]

    def costs(self, edits: bool) -> dict[tuple[int, int], np.ndarray]:
        out = {at: self.lex.cost(x, 0) for at, x in self.exact.items()}
        return {at: np.where(x < _NEVER, x, self.lex.cost(self.near[at], 1)) for at, x in out.items()} if edits else out


def _solve(cost: dict[tuple[int, int], np.ndarray], n: int, size: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(score, number of words, ends of words, whether another split is as good but for its texts) of the best splits: fewest edits, then words, then most uses."""
    best = np.full((most + 1, n + 1, size), _NEVER, np.int64)
    best[0, 0] = 0
    back, tied = np.zeros((most + 1, n + 1, size), np.int16), np.zeros((most + 1, n + 1, size), bool)
    for k in range(1, most + 1):
        for (i, j), c in cost.items():
            if k > 1 and not i or k == 1 and i:
                continue
            new = np.minimum(best[k - 1, i] + c, _NEVER)
            less, same = new < best[k, j], (new == best[k, j]) & (new < _NEVER // 2)
            best[k, j] = np.where(less, new, best[k, j])
            back[k, j] = np.where(less, i, back[k, j])
            tied[k, j] = np.where(less, tied[k - 1, i], tied[k, j] | same)
    end = best[1:, n]
    edits = np.where(end < _NEVER // 2, -((-end) // _EDIT), 1 << 20)
    words = np.argmin(edits, axis=0) + 1
    col = np.arange(size)
    ends = np.zeros((most, size), np.int16)
    j, left = np.full(size, n), words.copy()
    while (left > 0).any():
        x = np.flatnonzero(left > 0)
        ends[left[x] - 1, x] = j[x]
        j[x] = back[left[x], j[x], x]
        left[x] -= 1
    return best[words, n, col], words, ends, tied[words, n, col]


def split(s: str, known: dict[tuple[int, int], tuple[str, int, int]], most: int) -> tuple[list[str], int, int] | None:
    """(words, edits, uses) of the split of s into ``most`` words at most with the fewest edits, then fewest words, then most uses, then first by text; ``known`` maps places to (term, edits, uses)."""
    best: list[dict[int, tuple[int, int, list[str]]]] = [{0: (0, 0, [])}]
    for _ in range(most):
        now: dict[int, tuple[int, int, list[str]]] = {}
        for (i, j), (term, edits, uses) in known.items():
            if i in best[-1]:
                e, u, words = best[-1][i]
                new = (e + edits, u - uses, [*words, term])
                if j not in now or new < now[j]:
                    now[j] = new
        best.append(now)
    found = min(((x[len(s)][0], k, *x[len(s)][1:]) for k, x in enumerate(best) if k and len(s) in x), default=None)
    return None if found is None else (found[3], found[0], -found[2])


class _Out:
    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def batch(self) -> pa.RecordBatch:
        s, parts, d, f, asks = zip(*self.rows, strict=True) if self.rows else [()] * 5
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(s, pa.string()), pa.array(parts, pa.list_(pa.string())), pa.array(d, pa.int32()), pa.array(f, pa.int64()), pa.array(asks, pa.list_(_ASK))], ["string", "parts", "distance", "frequency", "asks"])


_ASK = pa.struct([("i", pa.int32()), ("j", pa.int32()), ("key", pa.int64())])
_ROWS = "string string, parts array<string>, distance int, frequency bigint, asks array<struct<i:int,j:int,key:bigint>>"
_held: dict[str, Lexicon] = {}


def _known(cut: _Cut, c: int, edits: bool) -> dict[tuple[int, int], tuple[str, int, int]]:
    out = {}
    for at in cut.places:
        r, e = cut.exact[at][c], 0
        if r == _NONE and edits:
            r, e = cut.near[at][c], 1
        if r != _NONE:
            out[at] = cut.lex.terms[int(r)].as_py(), e, int(cut.lex.uses[r])
    return out


def _settle(out: _Out, texts: list[str], cut: _Cut, which: np.ndarray, solved: tuple, most: int, edits: bool) -> None:
    """Rows of the strings whose columns are ``which``."""
    score, words, ends, tied = solved
    for c in which.tolist():
        s = texts[c]
        if score[c] >= _NEVER // 2:
            out.rows.append((s, [s], len(s), 0, None))
        elif tied[c]:
            out.rows.append((s, *split(s, _known(cut, c, edits), most), None))
        else:
            e = -((-int(score[c])) // _EDIT)
            to = ends[: words[c], c].tolist()
            places = list(zip([0, *to], to, strict=False))
            parts = [s[i:j] for i, j in places] if not e else [s[i:j] if cut.exact[i, j][c] != _NONE else cut.lex.terms[int(cut.near[i, j][c])].as_py() for i, j in places]
            out.rows.append((s, parts, e, e * _EDIT - int(score[c]), None))


def _asked(cut: _Cut, size: int, most: int) -> list[list[tuple[int, int, int]]]:
    """For each string what to ask for: pieces that may match a term elsewhere, as far as a split of ``most`` words may have them."""
    may = {at: (np.minimum(cut.exact[at], cut.near[at]) != _NONE) for at in cut.places}
    for at, (col, _) in cut.asks.items():
        may[at][col] = True
    fore, aft = np.full((cut.n + 1, size), 99, np.int8), np.full((cut.n + 1, size), 99, np.int8)
    fore[0] = aft[cut.n] = 0
    for i, j in sorted(cut.places, key=lambda x: x[1]):
        fore[j] = np.where(may[i, j], np.minimum(fore[j], fore[i] + 1), fore[j])
    for i, j in sorted(cut.places, key=lambda x: -x[0]):
        aft[i] = np.where(may[i, j], np.minimum(aft[i], aft[j] + 1), aft[i])
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(size)]
    for (i, j), (col, key) in cut.asks.items():
        ok = fore[i][col].astype(int) + aft[j][col] < most
        for c, k in zip(col[ok].tolist(), key[ok].view(np.int64).tolist(), strict=True):
            out[c].append((i, j, k))
    return out


def _lexicon(token: str, terms, longest: int) -> Lexicon:
    if token not in _held:
        _held.clear()
        _held[token] = Lexicon(terms.value[0], terms.value[1], longest)
    return _held[token]


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, list[str]]]:
    """(length, strings) of ``size`` strings of one length at once, wherever batches end, and of what is left at the end."""
    held: dict[int, list[str]] = {}
    for batch in batches:
        for n, at in _by_length(batch.column(0)):
            own = held.setdefault(n, [])
            own += batch.column(0).take(pa.array(at)).to_pylist()
            while len(own) >= size:
                yield n, own[:size]
                del own[:size]
    yield from ((n, own) for n, own in held.items() if own)


def _find(token: str, terms, local: int, longest: int, shortest: int, most: int):
    """Arrow function: (string) to rows of its best split, or of what has to be asked for to find it."""

    def edited(out: _Out, n: int, texts: list[str], lex: Lexicon) -> None:
        cut = _Cut(texts, n, lex, shortest)
        cut.edit()
        asks = _asked(cut, len(texts), most) if cut.asks else [[]] * len(texts)
        here = np.flatnonzero([not x for x in asks])
        _settle(out, texts, cut, here, _solve(cut.costs(True), n, len(texts), most), most, True)
        out.rows += [(s, None, None, None, x) for s, x in zip(texts, asks, strict=True) if x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, out, open_ = _lexicon(token, terms, local), _Out(), {}
        for n, texts in _gathered(batches, _AT_ONCE):
            if shortest <= n <= longest:
                cut = _Cut(texts, n, lex, shortest)
                solved = _solve(cut.costs(False), n, len(texts), most)
                done = solved[0] < _NEVER // 2
                _settle(out, texts, cut, np.flatnonzero(done), solved, most, False)
                rest = open_.setdefault(n, [])
                rest += [texts[c] for c in np.flatnonzero(~done).tolist()]
                if len(rest) >= _AT_ONCE:
                    edited(out, n, rest, lex)
                    rest.clear()
            else:
                out.rows += [(s, [s], n, 0, None) for s in texts]
            if len(out.rows) >= _AT_ONCE:
                yield out.batch()
        for n, rest in open_.items():
            if rest:
                edited(out, n, rest, lex)
                yield out.batch()
        yield out.batch()

    return run


def _finish(token: str, terms, local: int, shortest: int, most: int):
    """Arrow function: (string, answers) to rows of its best split; an answer is (i, j, term, uses) and counts where the term is one edit away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, out = _lexicon(token, terms, local), _Out()
        for batch in batches:
            for n, every in _by_length(batch.column(0)):
                for lo in range(0, len(every), 1024):
                    own = batch.take(pa.array(every[lo : lo + 1024]))
                    texts = own.column(0).to_pylist()
                    cut = _Cut(texts, n, lex, shortest)
                    cut.edit()
                    for c, (s, answers) in enumerate(zip(texts, own.column(1).to_pylist(), strict=True)):
                        known = _known(cut, c, True)
                        for x in answers or ():
                            at, new = (x["i"], x["j"]), (x["term"], 1, x["uses"])
                            if (at not in known or known[at][1] and (-new[2], new[0]) < (-known[at][2], known[at][0])) and alignment(s[slice(*at)], new[0]) <= 1:
                                known[at] = new
                        out.rows.append((s, *(split(s, known, most) or ([s], n, 0)), None))
            yield out.batch()

    return run


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, uses) to (key, term, uses) of all traces."""
    for b in batches:
        for m, every in _by_length(b.column(0)):
            for lo in range(0, len(every), _AT_ONCE):
                own = b.take(pa.array(every[lo : lo + _AT_ONCE]))
                for t in _traces(_Hashes(own.column(0).to_pylist(), m), m):
                    yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), own.column(0), own.column(1)], ["key", "term", "uses"])


def lookup(strings: DataFrame, words: DataFrame, least: int = 1, longest: int = 24, shortest: int = 2, most: int = 5, local: int = 6_000_000) -> DataFrame:
    """(string, parts, distance, frequency) of distinct non-empty strings (string), as ``probes.lookup_compound`` with one edit. ``local`` (hashes of edited terms that a worker holds) changes no result."""
    spark = strings.sparkSession
    terms = words.filter((F.col("frequency") >= least) & (F.col("word") != "") & (F.length("word") <= longest + 1)).groupBy(F.col("word").alias("term")).agg(F.max("frequency").cast("long").alias("uses"))
    terms = kept(terms)
    every = terms.toArrow().sort_by([("uses", "descending"), ("term", "ascending")])
    text = pa.concat_arrays([pa.array([], pa.large_string()), *every.column("term").cast(pa.large_string()).chunks])
    size = np.bincount(pc.utf8_length(text).to_numpy(zero_copy_only=False), minlength=longest + 2)
    fits = np.flatnonzero(np.cumsum(2 * np.arange(len(size)) * size) <= local)
    here = int(fits[-1]) if len(fits) else 0
    held = spark.sparkContext.broadcast((text, every.column("uses").to_numpy().astype(np.int64)))
    token = uuid.uuid4().hex
    rows = strings.mapInArrow(_find(token, held, here, longest, shortest, most), _ROWS)
    out = ["string", "parts", "distance", "frequency"]
    if not size[here + 1 :].any():
        return rows.select(out)
    rows = kept(rows)
    far = terms.filter(F.length("term") > here).mapInArrow(_left, "key bigint, term string, uses bigint").groupBy("key").agg(F.min(F.struct((-F.col("uses")).alias("less"), "term")).alias("t"))
    open_ = rows.filter("parts is null")
    asked = open_.select("string", F.explode("asks").alias("a")).select("string", "a.*")
    met = asked.join(far, "key").groupBy("string").agg(F.collect_list(F.struct("i", "j", F.col("t.term").alias("term"), (-F.col("t.less")).alias("uses"))).alias("answers"))
    met = open_.select("string").join(met, "string", "left").select("string", "answers").mapInArrow(_finish(token, held, here, shortest, most), _ROWS)
    return rows.filter("parts is not null").select(out).unionByName(met.select(out))
