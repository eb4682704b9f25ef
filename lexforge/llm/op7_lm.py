"""LM scoring by online logistic context mixing over bits.

A text is its lower-cased bytes and an end symbol, cut into units: a word, the white space behind it and a symbol that closes it (two bytes that UTF-8 doesn't have).
Each byte is eight binary decisions. For every decision several predictors have a logit from the counts of the training documents, by hashed context
within the unit: the last two bytes, from the fourth byte on all bytes before, from the sixth on the last four.

The logits are combined by gated weights: the longest context takes the share that its count earns (n of n + tau), the next one its share of the rest, and so on.
What the bits say of a whole unit is then refined by how often it followed the word before: (count + kappa * bits) of (count of the word + kappa).
``MIXERS`` are several tau and kappa; a document is coded by all of them, and the weights among them are updated online, after each block
of the document, by how well they coded it. All predictions depend on what stands before only, so the score is the log10 probability of the text.

Counts are kept by hashes of the whole contexts, whose bits follow the size of the corpus (64 slots for each of its bytes), so they grow with it. Contexts lie inside units,
so a task settles most of its work once for each distinct unit of a part of its documents. It sends the part's distinct (context, byte) pairs, (word, unit) pairs and tokens to
buckets with their training counts; a bucket sums the counts of all parts and answers each part; the part meets its answers and is scored. Buckets are
ranges of hashes, and their number follows the size of the corpus, so that no task grows with it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, store, table
from .kernels import _BYTE, _POW, LOWER, NOT_SPACE, U64, chunks, group_starts, mix, seeds, spans_hash

#: End of a text and of a unit: bytes that UTF-8 doesn't have.
_END, _CLOSE = 0xFF, 0xFE
_FOLD = np.where(np.arange(256) >= _CLOSE, 0xFD, LOWER).astype(np.uint8)
_WORD = NOT_SPACE & (np.arange(256) < _CLOSE)
_END_TOKEN = U64(0xE0D0E0D0E0D)
#: Kinds of contexts: last two bytes, last four, whole unit so far.
TWO, FOUR, PREFIX = range(3)
_SALT = seeds(4, 707)
#: Bytes of a unit before a predictor speaks.
_FROM = {TWO: 0, PREFIX: 3, FOUR: 5}
#: Added to the counts of zeros and ones.
PRIOR = 0.15
#: Gates (tau, scale): a context seen n times takes n / (n + tau) of what longer ones left, and the mix is scaled.
GATES = ((0.3, 1.1), (3.0, 1.1))
#: Mixers (gate, kappa): what the bits say weighs as much as kappa occurrences of the word before.
MIXERS = tuple((g, k) for g in range(len(GATES)) for k in (1.0, 10.0, 100.0, 1000.0))
#: Units of a document that are coded between two updates of the weights among the mixers, and what each update shares out evenly.
BLOCK, SHARE = 16, 0.02


# ---------------------------------------------------------------- units and contexts


def units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes with the symbols that close units and documents, lengths of the units, first unit of each document, with an end)."""
    m = len(off) - 1
    data = _FOLD[data]
    blank = ~NOT_SPACE[data]
    closes = np.zeros(len(data), bool)
    closes[1:] = blank[:-1] & ~blank[1:]
    full = off[:-1] < off[1:]
    closes[off[:-1][full]] = False
    last = off[1:][full]
    last = last[blank[last - 1]]
    buf = np.insert(data, np.r_[np.flatnonzero(closes), last, off[1:]], np.repeat(np.array([_CLOSE, _END], np.uint8), [int(closes.sum()) + len(last), m]))
    end = np.flatnonzero(buf >= _CLOSE) + 1
    stop = buf[end - 1] == _END
    return buf, np.diff(end, prepend=0).astype(np.int32), np.r_[0, np.flatnonzero(stop) + 1]


class Part:
    """Documents as runs of distinct units: ``data`` and ``lens`` of these, ``unit`` their numbers in order, ``first`` unit of each document, with an end."""

    def __init__(self, data: np.ndarray, lens: np.ndarray, unit: np.ndarray, first: np.ndarray) -> None:
        self.data, self.lens, self.unit, self.first = data, lens, unit, first
        self.off = np.cumsum(lens, dtype=np.int64) - lens
        self.kind_of = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
        self.at = np.arange(len(data), dtype=np.int32) - self.off.astype(np.int32)[self.kind_of]
        self.hash = spans_hash(data, lens)
        word = _WORD[data]
        n = np.add.reduceat(word, self.off, dtype=np.int64)
        self.has = n > 0
        own = np.full(len(lens), _END_TOKEN)
        own[self.has] = spans_hash(data[word], n[self.has])
        # tokens, sorted, and the token of each distinct unit; the end is one, also of units without a word
        self.token, inverse = np.unique(np.r_[own, _END_TOKEN], return_inverse=True)
        self.token_of, self.end = inverse[:-1].astype(np.int32), int(inverse[-1])

    def followers(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes of a word (at the start, the end token) and the unit behind it; ``follows``: units that follow one, the token before, and the number of the hash."""
        before = np.empty(len(self.unit), np.int32)
        before[1:] = self.token_of[self.unit[:-1]]
        ok = np.ones(len(self.unit), bool)
        ok[1:] = self.has[self.unit[:-1]]
        before[self.first[:-1]] = self.end
        ok[self.first[:-1]] = True
        place = np.flatnonzero(ok).astype(np.int32)
        before, own = before[place], mix(self.hash)
        v = np.empty(len(place), U64)
        for lo, hi in _blocks(len(v)):
            v[lo:hi] = mix((self.token[before[lo:hi]] + own[self.unit[place[lo:hi]]]) ^ _SALT[3]) >> U64(64 - bits)
        keys, number = _distinct([v])
        self.follows = place, before, number[0]
        return keys

    def spread(self, x: np.ndarray) -> np.ndarray:
        """Values of documents to their units."""
        return np.repeat(x, np.diff(self.first))

    def contexts(self, bits: int) -> Iterator[tuple[int, np.ndarray | slice, np.ndarray]]:
        """For each kind: places in ``data``, and context and byte in one word."""
        d, at = self.data, self.at

        def named(i: np.ndarray, kind: int, hashed) -> np.ndarray:
            out = np.empty(len(i), U64)
            for lo, hi in _blocks(len(i)):  # block by block, for the room that steps between take
                j = i[lo:hi]
                out[lo:hi] = ((mix(hashed(j) ^ _SALT[kind]) >> U64(64 - bits)) << U64(8)) | d[j]
            return out

        byte = lambda j, far: d[j - far].astype(U64)
        spoken = lambda j, far: np.where(at[j] >= far, byte(np.maximum(j, far), far) + U64(1), U64(0))
        i = np.arange(len(d), dtype=np.int32)
        yield TWO, slice(None), named(i, TWO, lambda j: spoken(j, 1) | spoken(j, 2) << U64(9))
        i = np.flatnonzero(at >= _FROM[FOUR]).astype(np.int32)
        yield FOUR, i, named(i, FOUR, lambda j: byte(j, 1) | byte(j, 2) << U64(8) | byte(j, 3) << U64(16) | byte(j, 4) << U64(24))
        i = np.flatnonzero(at >= _FROM[PREFIX]).astype(np.int32)
        sums, power = np.zeros(len(d) + 1, U64), _POW.upto(int(at.max(initial=0)) + 1)
        for lo, hi in _blocks(len(d)):
            np.cumsum(_BYTE[d[lo:hi]] * power[at[lo:hi]], out=sums[lo + 1 : hi + 1])
            sums[lo + 1 : hi + 1] += sums[lo]
        yield PREFIX, i, named(i, PREFIX, lambda j: sums[j] - sums[self.off[self.kind_of[j]]])

    def numbered(self, bits: int) -> np.ndarray:
        """Sorted distinct pairs; ``number`` gets the number of the pair at each byte of ``data`` for each kind, -1 where it doesn't speak."""
        places: list[tuple[int, np.ndarray | slice]] = []

        def pairs() -> Iterator[np.ndarray]:
            for kind, place, pair in self.contexts(bits):
                places.append((kind, place))
                yield pair

        keys, numbers = _distinct(pairs())
        self.number = {}
        for kind, place in places:
            self.number[kind] = np.full(len(self.data), -1, np.int32)
            self.number[kind][place] = numbers.pop(0)
        return keys

    def counts(self, train: np.ndarray, n_pairs: int, n_followers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often tokens, pairs and followers occur in the documents ``train``."""
        mine = self.spread(train)
        times = np.bincount(self.unit[mine], minlength=len(self.lens))
        tokens = np.bincount(self.token_of, weights=times * self.has, minlength=len(self.token))
        tokens[self.end] += train.sum()
        pairs = np.zeros(n_pairs)
        for number in self.number.values():
            at = np.flatnonzero(number >= 0)
            pairs += np.bincount(number[at], weights=times[self.kind_of[at]], minlength=n_pairs)
        place, _, number = self.follows
        followers = np.bincount(number[mine[place]], minlength=n_followers)
        return tokens.astype(np.int64), pairs.astype(np.int64), followers

    def base(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, known tokens, sum of log10(c + 1)) of each document by the training counts of the part's tokens."""
        c, word = tokens[self.token_of[self.unit]], self.has[self.unit]
        sums = lambda x: np.add.reduceat(x, self.first[:-1])
        end = int(tokens[self.end])
        return sums(word.astype(np.int64)) + 1, sums((word & (c > 0)).astype(np.int64)) + int(end > 0), sums(np.where(word, np.log10(c + 1.0), 0)) + math.log10(end + 1)

    def bit_costs(self, codes: np.ndarray) -> np.ndarray:
        """Nats of each distinct unit by its bits, under each gate; ``codes`` are the answers to the numbered pairs."""
        logit, seen = logits(codes)
        # one pair tells all that stands before a byte: of the last two up to the third byte, of the unit so far from there on
        told = np.where(self.at < _FROM[PREFIX], self.number[TWO], self.number[PREFIX])
        lead = np.full(len(codes), -1, np.int32)
        lead[told] = np.arange(len(told), dtype=np.int32)
        lead = lead[lead >= 0]
        each = np.zeros((len(codes), len(GATES)), np.float32)
        for ks, lo, hi in (((TWO,), 0, 3), ((PREFIX, TWO), 3, 5), ((PREFIX, FOUR, TWO), 5, 1 << 31)):
            i = lead[(self.at[lead] >= lo) & (self.at[lead] < hi)]
            for a in range(0, len(i), 8192):
                p = i[a : a + 8192]
                each[told[p]] = cost([self.number[k][p] for k in ks], logit, seen)
        del logit, seen
        return np.stack([np.add.reduceat(each[told, g].astype(np.float64), self.off) for g in range(len(GATES))], axis=1)

    def scores(self, codes: np.ndarray, followers: np.ndarray, tokens: np.ndarray, run: int = 1 << 18) -> np.ndarray:
        """log10 probability of each document by the answers to its pairs, followers and tokens; documents of some ``run`` units at a time."""
        bits = self.bit_costs(codes)
        with np.errstate(under="ignore"):
            share = np.exp(-bits)
        many = {kappa: np.log(tokens + kappa) for _, kappa in MIXERS}
        place, before, number = self.follows
        out, lo = np.zeros(len(self.first) - 1), 0
        while lo < len(out):
            hi = max(lo + 1, int(np.searchsorted(self.first, self.first[lo] + run, "right")) - 1)
            a, z = self.first[lo], self.first[hi]
            unit = self.unit[a:z]
            x, y = np.searchsorted(place, [a, z])
            at, n, token = place[x:y] - a, followers[number[x:y]].astype(np.float64), before[x:y]
            own = unit[at]
            loss = np.empty((z - a, len(MIXERS)))
            for m, (gate, kappa) in enumerate(MIXERS):
                loss[:, m] = bits[unit, gate]
                p = n + kappa * share[own, gate]
                tiny = np.flatnonzero(p < 1e-200)  # many bits of a unit that never followed
                p[tiny] = 1
                p = many[kappa][token] - np.log(p)
                p[tiny] = many[kappa][token[tiny]] - math.log(kappa) + bits[own[tiny], gate]
                loss[at, m] = p
            out[lo:hi] = coded(loss, self.first[lo : hi + 1] - a)
            lo = hi
        return -out / np.log(10)


def _blocks(n: int, size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    return ((lo, min(n, lo + size)) for lo in range(0, n, size))


def _distinct(arrays: Iterable[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(sorted distinct values of all arrays, for each array their numbers); equal values of two arrays, which hashes have by chance only, are two."""
    keys, numbers, n = [], [], 0
    for x in arrays:
        d = pa.array(x).dictionary_encode()
        keys.append(d.dictionary.to_numpy(zero_copy_only=False))
        numbers.append(d.indices.to_numpy(zero_copy_only=False) + np.int32(n))
        n += len(keys[-1])
    keys = np.concatenate(keys)
    order = np.argsort(keys)
    rank = np.empty(n, np.int32)
    rank[order] = np.arange(n, dtype=np.int32)
    return keys[order], [rank[x] for x in numbers]


# ---------------------------------------------------------------- counts as codes

_EXACT, _STEPS = 16, 3
#: Count that a code stands for: whole up to 16, from there three steps an octave.
VALUES = np.r_[np.arange(_EXACT + 1), _EXACT * 2.0 ** (np.arange(1, 256 - _EXACT) / _STEPS)]


def quantised(count: np.ndarray) -> np.ndarray:
    """Code of each count."""
    out = np.minimum(count, _EXACT).astype(np.uint8)
    large = np.flatnonzero(count > _EXACT)
    out.reshape(-1)[large] = np.minimum(_EXACT + np.rint(_STEPS * np.log2(count.reshape(-1)[large] / _EXACT)), 255)
    return out


#: Codes of a pair: eight of how often its bits so far occurred (all but the last as steps to the next), and eight of the other bits there.
_CODES = 16


def answers(keys: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Codes of sorted distinct pairs, which hold all the bytes of their contexts: how often the byte's first 1, ... 8 bits occurred, and how often another bit than the first, ... eighth did after the same bits."""
    sums = []
    for j in range(9):
        first = group_starts(keys >> U64(8 - j))
        sums.append(np.repeat(np.add.reduceat(count, first), np.diff(np.r_[first, len(keys)])) if len(keys) else count)
    own = [quantised(x) for x in sums[1:]]
    return np.stack([*(own[b] - own[b + 1] for b in range(7)), own[7], *(quantised(sums[b] - sums[b + 1]) for b in range(8))], axis=1)


def logits(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(logits of the bits that are there, occurrences of what stands before them), by pair and bit; those of two bytes that differ in a bit are opposite, and equal, there."""
    value = VALUES.astype(np.float32)
    level = np.log(VALUES + PRIOR).astype(np.float32)
    logit, seen = np.empty((len(codes), 8), np.float32), np.empty((len(codes), 8), np.float32)
    own = codes[:, 7]
    for b in range(7, -1, -1):
        other = codes[:, 8 + b]
        logit[:, b] = level[own] - level[other]
        seen[:, b] = value[own] + value[other]
        if b:
            own = own + codes[:, b - 1]  # modulo 256
    return logit, seen


def cost(numbers: list[np.ndarray], logit: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Nats of bytes under each gate; ``numbers``: of the pairs of each predictor, the longest context first."""
    x, n = [logit[i] for i in numbers], [seen[i] for i in numbers]
    out = np.empty((len(numbers[0]), len(GATES)), np.float32)
    for m, (tau, scale) in enumerate(GATES):
        z, rest = 0, np.float32(1)
        for a, c in zip(x, n, strict=True):
            w = c / (c + np.float32(tau))
            w *= rest
            z = z + w * a
            rest = rest - w
        # no bit costs more than 20 nats; so the product of four factors stays in range
        v = np.exp(np.clip(z * np.float32(-scale), -20, 20))
        v += 1
        out[:, m] = np.log(v[:, 0] * v[:, 1] * v[:, 2] * v[:, 3]) + np.log(v[:, 4] * v[:, 5] * v[:, 6] * v[:, 7])
    return out


def coded(loss: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Nats of each document: its blocks are coded by the mixers together, whose weights follow the blocks before."""
    n_units = np.diff(first)
    total, m = np.zeros(len(n_units)), loss.shape[1]
    if not len(loss):
        return total
    n_blocks = -(-n_units // BLOCK)
    start = np.repeat(first[:-1], n_blocks) + BLOCK * (np.arange(n_blocks.sum()) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks))
    sums = np.add.reduceat(loss, start, axis=0)
    order = np.argsort(-n_blocks, kind="stable")
    begin, left = (np.cumsum(n_blocks) - n_blocks)[order], n_blocks[order]
    weight = np.full((len(order), m), 1 / m)
    for t in range(int(left[0])):
        live = int(np.searchsorted(-left, -t, "left"))
        x = sums[begin[:live] + t]
        least = x.min(axis=1)
        p = weight[:live] * np.exp(least[:, None] - x)
        s = p.sum(axis=1)
        total[order[:live]] += least - np.log(s)
        weight[:live] = p / s[:, None] * (1 - SHARE) + SHARE / m
    return total


# ---------------------------------------------------------------- exchange


def held_out(ids: pa.Array) -> np.ndarray:
    """crc32(doc_id as text) mod 7 is 2; a null id isn't held out."""
    return np.array([x is not None and zlib.crc32(str(x).encode()) % 7 == 2 for x in ids.to_pylist()], bool)


_CODEC = pa.Codec("zstd", compression_level=3)


def packed(x: np.ndarray) -> bytes:
    """Rows of numbers, byte by byte of all rows, compressed."""
    x = np.ascontiguousarray(x)
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def unpacked(blob: bytes, kind: str, width: int = 1) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(_CODEC.decompress(memoryview(blob)[8:], size, asbytes=True), np.uint8)
    rows = np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize * width, -1).T)
    out = rows.view(kind)
    return out[:, 0] if width == 1 else out


def _joined(x: bytes, y: bytes) -> bytes:
    return len(x).to_bytes(8, "little") + x + y


def _pairs_packed(keys: np.ndarray) -> bytes:
    """Sorted numbers, by their differences."""
    return packed(np.diff(keys, prepend=U64(0)).astype("<u8"))


def _pairs_of(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob, "<u8"), dtype=U64)


def _pieces(keys: np.ndarray, width: int, buckets: int) -> Iterator[tuple[int, slice]]:
    """(bucket, its slice) of sorted numbers of ``width`` bits; a bucket is a range that whole contexts (all but the low 8 bits) lie in."""
    least = np.array([((i << (width - 8)) // buckets) << 8 for i in range(buckets)], U64)
    ends = np.searchsorted(keys, least)
    for i, (x, y) in enumerate(zip(ends, [*ends[1:], len(keys)], strict=True)):
        if y > x:
            yield i, slice(x, y)


_ASKED = "bucket int, part bigint, a binary, b binary, c binary"
_ANSWERED = "part bigint, kind int, bucket int, a binary, b binary, c binary, n bigint, v bigint"


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _asked(bits: int, buckets: int, flush: int):
    """Arrow function: (doc_id, text) to rows by task part. Of each kind (tokens, pairs, followers, in this order) ``buckets`` buckets get sorted numbers with their training counts; buckets below 0 get the documents as runs of units."""
    names, types = ["bucket", "part", "a", "b", "c"], [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def rows(key: int, joined: list[np.ndarray]) -> Iterator[tuple]:
        ids, stats, buf, lens, counts, hashes = joined
        joined.clear()
        first = np.r_[0, np.cumsum(counts)]
        d = pa.array(hashes).dictionary_encode()
        unit = d.indices.to_numpy(zero_copy_only=False)
        lead = np.empty(len(d.dictionary), np.int64)
        lead[unit[::-1]] = np.arange(len(unit))[::-1]  # the first of equal ones is written last
        order = np.argsort(-np.bincount(unit), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        unit, lead = rank[unit], lead[order]
        start, kept = (np.cumsum(lens, dtype=np.int64) - lens)[lead], lens[lead]
        shift = start - (np.cumsum(kept, dtype=np.int64) - kept)
        data = buf[np.repeat(shift, kept) + np.arange(int(kept.sum()))]
        del buf, lens, hashes, d, shift, start, rank, order, lead
        part = Part(data, kept, unit, first)
        yield -1 - key % buckets, key, packed(np.c_[ids, stats, np.diff(first)].astype("<i8")), _joined(packed(data), packed(kept.astype("<u4"))), packed(unit.astype("<u4"))
        pairs, followers = part.numbered(bits), part.followers(bits)
        counts = part.counts(stats[:, 1] == 0, len(pairs), len(followers))
        for kind, (keys, width, n) in enumerate(zip((part.token, pairs, followers), (64, bits + 8, bits), counts, strict=True)):
            for i, x in _pieces(keys, width, buckets):
                yield kind * buckets + i, key, _pairs_packed(keys[x]), packed(n[x].astype("<i8")), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, part, size = TaskContext.get().partitionId(), 0, 0
        held: list[list[np.ndarray]] = [[] for _ in range(6)]

        def out() -> pa.RecordBatch:
            joined = []
            for x in held:  # the pieces go as they are joined
                joined.append(np.concatenate(x))
                x.clear()
            made = _batch(list(rows((task << 24) + part, joined)), names, types)
            pa.default_memory_pool().release_unused()
            return made

        for b in batches:
            own = b.column(0).cast(pa.int64())
            stats = np.stack([own.is_valid().to_numpy(zero_copy_only=False), held_out(own)], axis=1).astype(np.int64)
            plain = own.fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, off in chunks(b.column(1), 1 << 18):
                buf, lens, first = units(data, off)
                for x, y in zip(held, (plain[lo:hi], np.c_[stats[lo:hi], np.diff(off)], buf, lens, np.diff(first), spans_hash(buf, lens)), strict=True):
                    x.append(y)
                size += len(buf)
                if size > flush:
                    yield out()
                    size, part = 0, part + 1
        if size:
            yield out()

    return run


def _answered(buckets: int):
    """Arrow function over rows sorted by bucket. Kind 0: the documents of a part as they came. Kinds 1 to 3, in the order of the numbers: training counts of a part's tokens in a bucket, codes of its pairs (see ``answers``), counts of its followers.
    A bucket's training tokens, all and distinct, are rows of a part below 0."""
    names = ["part", "kind", "bucket", "a", "b", "c", "n", "v"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def out(bucket: int, held: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        keys = [_pairs_of(x[1]) for x in held]
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.zeros(len(every), np.int64)
        ends = np.r_[0, np.cumsum([len(x) for x in keys])]
        for (_, _, n), lo, hi in zip(held, ends[:-1], ends[1:], strict=True):
            count[inverse[lo:hi]] += unpacked(n, "<i8")  # a part's keys are distinct
        kind = 1 + bucket // buckets
        value = answers(every, count) if kind == 2 else count.astype("<i8")
        made = [(x[0], kind, bucket % buckets, packed(value[inverse[lo:hi]]), None, None, None, None) for x, lo, hi in zip(held, ends[:-1], ends[1:], strict=True)]
        if kind == 1:
            made.append((-1 - bucket, 0, None, None, None, None, int(count.sum()), int((count > 0).sum())))
        return _batch(made, names, types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for bucket, part, x, y, z in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                if bucket < 0:
                    yield _batch([(part, 0, None, x, y, z, None, None)], names, types)
                    continue
                if bucket != now:
                    if held:
                        yield out(now, held)
                    now, held = bucket, []
                held.append((part, x, y))
        if held:
            yield out(now, held)

    return run


def _scored(bits: int):
    """Arrow function over rows sorted by (part, kind, bucket): the documents of each part with their scores, and the buckets' tokens."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "n_bytes", "base", "score", "n", "v"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]

    def out(row: tuple[bytes, bytes, bytes], answers: tuple[list[bytes], list[bytes], list[bytes]]) -> pa.RecordBatch:
        ids, valid, held, size, n_units = unpacked(row[0], "<i8", 5).T
        at = 8 + int.from_bytes(row[1][:8], "little")
        part = Part(unpacked(row[1][8:at], "u1"), unpacked(row[1][at:], "<u4").astype(np.int64), unpacked(row[2], "<u4").astype(np.int32), np.r_[0, np.cumsum(n_units)])
        n_pairs, n_followers = len(part.numbered(bits)), len(part.followers(bits))
        tokens, codes, followers = (np.concatenate([unpacked(x, kind, width) for x in blobs]) for blobs, (kind, width) in zip(answers, (("<i8", 1), ("u1", _CODES), ("<i8", 1)), strict=True))
        if (len(tokens), len(codes), len(followers)) != (len(part.token), n_pairs, n_followers):
            raise ValueError("a part has not met all its answers")
        n_tokens, known, base = part.base(tokens)
        none = pa.nulls(len(ids), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=valid == 0), pa.array(held > 0), pa.array(n_tokens), pa.array(known), pa.array(size), pa.array(base), pa.array(part.scores(codes, followers, tokens)), none, none], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, row, answers = None, None, ([], [], [])
        for b in batches:
            for part, kind, x, y, z, n, v in zip(*(b.column(c).to_pylist() for c in ("part", "kind", "a", "b", "c", "n", "v")), strict=True):
                if part < 0:
                    yield _batch([(None, None, None, None, None, None, None, n, v)], names, types)
                elif part != now:
                    if row is not None:
                        yield out(row, answers)
                        pa.default_memory_pool().release_unused()
                    now, row, answers = part, (x, y, z), ([], [], [])
                else:
                    answers[kind - 1].append(x)
        if row is not None:
            yield out(row, answers)

    return run


def lm_scores(docs: DataFrame, flush: int | None = None, bucket_bytes: int = 8_000_000) -> DataFrame:
    """Return (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each row of ``docs`` (doc_id bigint, text).

    Trains on the rows that aren't held out: all their texts, whole, give counts. ``flush`` is the bytes of a part (14 MB, more from 57 GB of text on, 64 MB at most), ``bucket_bytes`` the text for which there is
    a bucket; neither changes a result. bits_per_byte counts the bits of the end, too, and is null for empty texts. Null text is
    empty: one token, the end. Rows are scored one by one, repeated or with null doc_id as well. Other columns are
    ignored. Without documents there are no rows; without training documents the model is uniform and c, N and V are 0.
    """
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    flush = flush or min(64_000_000, max(14_000_000, size // 4096))
    buckets = max(1, -(-size // bucket_bytes))
    bits = min(55, max(24, math.ceil(math.log2(size + 1)) + 6))
    # parts take the room that large Arrow batches would
    with batches_of(docs.sparkSession, 500):
        asked = docs.mapInArrow(_asked(bits, buckets, flush), _ASKED).repartition("bucket").sortWithinPartitions("bucket", "part")
        # more partitions than parts, so that few hold more than one
        n_parts = min(200_000, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * -(-size // flush)))
        met = asked.mapInArrow(_answered(buckets), _ANSWERED).repartition(n_parts, "part").sortWithinPartitions("part", "kind", "bucket")
        rows = store(met.mapInArrow(_scored(bits), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, n_bytes bigint, base double, score double, n bigint, v bigint"))
    n, v = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    base = F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    per_byte = F.col("score") * F.lit(-math.log2(10)) / F.when(F.col("n_bytes") > 0, F.col("n_bytes"))
    return rows.filter("n is null").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", per_byte.alias("bits_per_byte"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
