"""Confusable words judged by the pairs of the whole corpus around them, without a row for a token or a pair.

A part of the texts tells the bucket of each word which confusable words stand behind it (and, where both sides count, before it) and how often. A bucket has all
words of a context together, so it sees which partners of a word stand there as well; nobody asks for pairs that don't exist.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as A

from ..functions.hashes import U64, of_spans
from ..session import batches_of, kept
from .exchange import _parts, _runs, _texts, per_million, placed, tokens_in
from .suggest import ratio_confidence

#: Candidates that are looked up at once; bits of the bitmap that spares most of them.
_AT_ONCE, _BITS = 1 << 19, 22
#: Probability of a pair that isn't there, in millionths.
_UNSEEN = 1
_MET = A.StructType([A.StructField("part", A.LongType()), A.StructField("bucket", A.IntegerType()), A.StructField("body", A.BinaryType()), A.StructField("check", A.LongType())])


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays byte by byte: first bytes of all numbers, then the second ones, so that small numbers take little room."""
    raw = b"".join(x for a in arrays for x in (len(a).to_bytes(8, "little"), np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()))
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _unpack(body: bytes, *kinds) -> list[np.ndarray]:
    raw, at, out = pa.Codec("zstd").decompress(body[8:], int.from_bytes(body[:8], "little"), asbytes=True), 0, []
    for kind in kinds:
        n = int.from_bytes(raw[at : at + 8], "little")
        wide = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * wide, at + 8).reshape(wide, n).T).view(kind).ravel())
        at += 8 + n * wide
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of numbers that mostly rise."""
    return np.diff(x, prepend=0).astype("<i4")


def word_hash(words: pa.Array) -> np.ndarray:
    data, off = _texts(words)
    return of_spans(data, off[:-1], off[1:])


@F.arrow_udf(A.LongType())
def _hashed(words: pa.Array) -> pa.Array:
    return pa.array(word_hash(words).view(np.int64))


class Sets:
    """Words of confusable pairs in the order of their texts, the partners of each, and how often each has a word behind it."""

    def __init__(self, text: pa.Array, a: np.ndarray, b: np.ndarray, total: np.ndarray) -> None:
        self.text, self.total, self.n = text, total, max(1, len(text))
        h = word_hash(text)
        self.order = np.argsort(h).astype(np.int32)
        self.hash = h[self.order]
        a, b = np.r_[a, b], np.r_[b, a]
        order = np.lexsort((b, a))
        self.other = b[order].astype(np.int32)
        self.many = np.bincount(a, minlength=len(text))
        self.first = np.cumsum(self.many) - self.many

    def at(self, h: np.ndarray) -> np.ndarray:
        """The places of words by their hashes; -1 for words of no pair."""
        if not len(self.hash):
            return np.full(len(h), -1, np.int32)
        x = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[x] == h, self.order[x], np.int32(-1))

    def partners(self, u: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of u, partner), for some rows at once; rows in order, partners of a row in order."""
        upto = np.cumsum(self.many[u])
        lo = 0
        while lo < len(u):
            before = upto[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(upto, before + _AT_ONCE, "right")))
            many = self.many[u[lo:hi]]
            row = np.repeat(np.arange(lo, hi), many)
            yield row, self.other[np.repeat(self.first[u[lo:hi]] - (upto[lo:hi] - many - before), many) + np.arange(len(row))]
            lo = hi


def sets_of(pairs: DataFrame, docs: DataFrame, text: str) -> Sets:
    """Pairs (w1, w2, f1, f2) come to the driver: of words that are common enough to be in one, about 40 bytes for each pair. A word has none behind it where a text ends."""
    t = pairs.select("w1", "w2", "f1", "f2").toArrow()
    both = pa.chunked_array([x for c in ("w1", "w2") for x in t[c].chunks], pa.string()).combine_chunks()
    both = (pa.concat_arrays(both.chunks) if isinstance(both, pa.ChunkedArray) else both).dictionary_encode()
    words, place = both.dictionary, both.indices.to_numpy(zero_copy_only=False)
    by_text = pc.sort_indices(words).to_numpy()
    rank = np.empty(len(words), np.int64)
    rank[by_text] = np.arange(len(words))
    total = np.zeros(len(words), np.int64)
    total[rank[place]] = np.concatenate([x.to_numpy(zero_copy_only=False) for c in ("f1", "f2") for x in t[c].chunks] or [np.zeros(0)])
    words = words.take(pa.array(by_text))
    last = F.substring_index(F.rtrim(F.translate(F.lower(F.coalesce(F.col(text), F.lit(""))), "\t\n\r", "   ")), " ", -1)
    ends = docs.select(last.alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    ends = ends.withColumn("h", _hashed("word")).select("h", "n")
    place = rank[place]
    out = Sets(words, place[: len(t)], place[len(t) :], total)
    if len(words):
        e = ends.toArrow()
        at = out.at(e["h"].to_numpy().view(U64))
        out.total[at[at >= 0]] -= e["n"].to_numpy()[at >= 0]
    return out


class _Side:
    """Distinct pairs (context, confusable word) of a part, in the order of ``key``, and ``at``, the pair of each place."""

    def __init__(self, words: np.ndarray, context: np.ndarray, u: np.ndarray, n: int, buckets: int, totals: np.ndarray | None) -> None:
        self.places = np.flatnonzero(u >= 0)
        self.key, self.at, self.counts = np.unique(context[self.places] * n + u[self.places], return_inverse=True, return_counts=True)
        own, self.u = np.divmod(self.key, n)
        many = np.bincount(own, minlength=len(words))
        ids = np.flatnonzero(many if totals is None else totals)
        bucket = (words[ids] % U64(buckets)).astype(np.int32)
        by = np.argsort(bucket, kind="stable")
        self.bucket, self.ids = bucket[by], ids[by]
        self.many = many[self.ids]
        first = (np.cumsum(many) - many)[self.ids]
        upto = np.cumsum(self.many)
        self.order = np.repeat(first - (upto - self.many), self.many) + np.arange(len(self.key))
        self.hash, self.totals = words[self.ids], np.zeros(len(self.ids), np.int64) if totals is None else totals[self.ids]
        self.check = _check(words[own], self.u)

    def asks(self, base: int) -> Iterator[tuple[int, bytes]]:
        upto = np.r_[0, np.cumsum(self.many)]
        for lo, hi in _runs(self.bucket):
            x = self.order[upto[lo] : upto[hi]]
            yield base + int(self.bucket[lo]), _pack(self.hash[lo:hi], self.many[lo:hi].astype("<u4"), self.totals[lo:hi].astype("<u4"), _steps(self.u[x]), self.counts[x].astype("<u4"))


def _check(context: np.ndarray, u: np.ndarray) -> int:
    return int(np.sum((context ^ U64(0x9E3779B97F4A7C15)) * (u.astype(U64) * U64(2) + U64(1)), dtype=U64).view(np.int64)) if len(u) else 0


class _Part:
    """Tokens of a part's texts and its pairs with confusable words: ``left`` behind, ``right`` before a context."""

    def __init__(self, rows: pa.RecordBatch, sets: Sets, buckets: int, both: bool) -> None:
        self.data, self.off = _texts(rows.column(1))
        self.begin, self.length, self.doc, h = tokens_in(self.data, self.off)
        same = self.here = np.flatnonzero(self.doc[1:] == self.doc[:-1])
        words, w = np.unique(h, return_inverse=True)
        self.u = sets.at(words)[w]
        self.left = _Side(words, w[same], self.u[same + 1], sets.n, buckets, np.bincount(w[same], minlength=len(words)))
        self.right = _Side(words, w[same + 1], self.u[same], sets.n, buckets, None) if both else None


def _ask(shared, buckets: int, flush: int, both: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _parts(batches, flush):
            part = _Part(rows, shared.value, buckets, both)
            for side, base in ((part.left, 0), (part.right, buckets)):
                asks = list(side.asks(base)) if side else []
                for lo in range(0, len(asks), 64):
                    bucket, body = zip(*asks[lo : lo + 64], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(body), pa.int64()), pa.array(bucket, pa.int32()), pa.array(body, pa.binary()), pa.nulls(len(body), pa.int64())], _MET.names)
            part = rows = side = asks = None
            pa.default_memory_pool().release_unused()

    return run


class _Bucket:
    """All pairs of the contexts of a bucket: ``key`` (context, word), ``count``, ``total`` of the pair's first word, ``p`` in millionths."""

    def __init__(self, held: list[bytes], sets: Sets, right: bool) -> None:
        asks = [_unpack(x, U64, "<u4", "<u4", "<i4", "<u4") for x in held]
        h, many, totals, u, n = (np.concatenate(x) for x in zip(*((a, b, c, np.cumsum(d), e) for a, b, c, d, e in asks), strict=True))
        self.runs = [len(x[0]) for x in asks]
        self.sizes = [len(x[3]) for x in asks]
        self.words, self.run = np.unique(h, return_inverse=True)
        c, self.n = self.run, sets.n
        context = np.repeat(c, many)
        self.checks = [_check(self.words[context[z - k : z]], u[z - k : z]) for z, k in zip(np.cumsum(self.sizes).tolist(), self.sizes, strict=True)]
        self.key, self.at = np.unique(context * self.n + u, return_inverse=True)
        self.count = np.bincount(self.at, n, len(self.key)).astype(np.int64)
        self.context, self.u = np.divmod(self.key, self.n)
        self.totals = np.bincount(c, totals, len(self.words)).astype(np.int64)
        self.total = sets.total[self.u] if right else self.totals[self.context]
        self.p = per_million(self.count, self.total)

    def meeting(self, rows: np.ndarray, sets: Sets) -> tuple[np.ndarray, np.ndarray]:
        """(row, row of a partner that stands in the same context) for the ``rows``."""
        alone = np.bincount(self.context, minlength=len(self.words)) == 1
        rows = rows[~alone[self.context[rows]]]
        spread = lambda x: (x.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - _BITS)
        seen = np.zeros(1 << _BITS, bool)
        seen[spread(self.key)] = True
        out: list[list[np.ndarray]] = [[], []]
        for row, other in sets.partners(self.u[rows]):
            row = rows[row]
            wanted = self.context[row] * self.n + other
            maybe = np.flatnonzero(seen[spread(wanted)])
            row, wanted = row[maybe], wanted[maybe]
            at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            hit = self.key[at] == wanted
            out[0].append(row[hit])
            out[1].append(at[hit])
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def _by_bucket(each):
    """Arrow function over asks sorted by bucket: ``each`` (bucket, parts, bodies) of every bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = None, [], []
        for b in batches:
            for part, bucket, body in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if bucket != now and held:
                    yield from each(now, parts, held)
                    pa.default_memory_pool().release_unused()
                    parts, held = [], []
                now = bucket
                parts.append(part)
                held.append(body)
        if held:
            yield from each(now, parts, held)

    return run


def _tell(shared, buckets: int):
    """Answers: of each run (context) asked for its uses, of each pair how often it is there and a bound of how much better a partner fits the context; and the pairs of partners that the part doesn't have itself."""

    def each(bucket: int, parts: list[int], held: list[bytes]) -> Iterator[pa.RecordBatch]:
        sets = shared.value
        b = _Bucket(held, sets, bucket >= buckets)
        row, other = b.meeting(np.arange(len(b.key)), sets)
        many = np.bincount(row, minlength=len(b.key))
        first = np.cumsum(many) - many
        some = np.flatnonzero(many)
        best = np.full(len(b.key), _UNSEEN, np.int64)
        if len(some):
            best[some] = np.maximum(np.maximum.reduceat(b.p[other], first[some]), _UNSEEN)
        bound = np.where(b.p > 0, np.clip(np.ceil(4 * np.log2(best / np.maximum(b.p, 1)) + 1e-6) + 100, 0, 255), 0).astype(np.uint8)
        lo = at = 0
        for part, size, runs, check in zip(parts, b.sizes, b.runs, b.checks, strict=True):
            x, run = b.at[lo : lo + size], b.run[at : at + runs]
            lo, at = lo + size, at + runs
            k = many[x]
            more = other[np.repeat(first[x] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))]
            new = np.zeros(len(b.key), bool)
            new[more] = True
            new[x] = False
            new = np.flatnonzero(new)
            # extras stand in the order of the contexts, not of the runs: which run each is of goes with them
            place = np.zeros(len(b.words), np.int64)
            place[run] = np.arange(runs)
            body = _pack(b.totals[run].astype("<u4"), b.count[x].astype("<u4"), bound[x], _steps(place[b.context[new]]), _steps(b.u[new]), b.count[new].astype("<u4"))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([bucket], pa.int32()), pa.array([body], pa.binary()), pa.array([check], pa.int64())], _MET.names)

    return _by_bucket(each)


def _deal(flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _parts(batches, flush):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                to.write_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([-1], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.nulls(1, pa.int64())], _MET.names)

    return run


class _Told:
    """What the buckets said of the pairs of one side of a part: ``p`` in millionths, and ``most``, a bound of how many times likelier a partner is (infinite where p is 0)."""

    def __init__(self, side: _Side, answers: list[bytes], check: int, sets: Sets, right: bool) -> None:
        got = [_unpack(x, "<u4", "<u4", np.uint8, "<i4", "<i4", "<u4") for x in answers]
        runs = np.cumsum([0, *(len(x[0]) for x in got)])
        got = [(*x[:3], np.cumsum(x[3], dtype=np.int64) + lo, np.cumsum(x[4], dtype=np.int64), x[5]) for x, lo in zip(got, runs[:-1].tolist(), strict=True)]
        total, count, bound, run, u, n = (np.concatenate([x[i] for x in got]).astype(np.int64) if got else np.zeros(0, np.int64) for i in range(6))
        if len(count) != len(side.key) or len(total) != len(side.ids) or check != side.check:
            raise ValueError("a part has not met its answers: the documents came in another order than before")
        own = np.repeat(total, side.many)
        p = per_million(count, sets.total[side.u[side.order]] if right else own)
        q = per_million(n, sets.total[u] if right else total[run])
        self.n, self.p, self.most = sets.n, np.empty(len(p), np.int64), np.empty(len(p))
        self.p[side.order] = p
        self.most[side.order] = np.where(p > 0, 2.0 ** ((bound - 100) / 4), np.inf)
        self.context = side.key // sets.n
        key = np.r_[side.key, side.ids[run] * sets.n + u]
        order = np.argsort(key, kind="stable")
        self.key, self.q = key[order], np.r_[self.p, q][order]

    def of(self, row: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Probability of the partner in the context of the pair ``row`` (-1: no context)."""
        out = np.full(len(row), _UNSEEN, np.int64)
        if len(self.key):
            wanted = self.context[row] * self.n + other
            at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            hit = (row >= 0) & (self.key[at] == wanted)
            out[hit] = self.q[at[hit]]
        return out


def _best(part: _Part, sets: Sets, left: _Told, right: _Told, min_ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, partner, ratio) of the best partner of each token that has one."""
    rows = []
    for side, told, shift in ((part.left, left, 1), (part.right, right, 0)):
        at = np.full(len(part.u), -1, np.int64)
        at[part.here[side.places] + shift] = side.at
        rows.append((at, told))
    token = np.flatnonzero(part.u >= 0)
    share = lambda x: x / 1e6
    own, most = np.ones(len(token)), np.ones(len(token))
    for at, told in rows:
        there = at[token] >= 0
        x = np.where(there, at[token], 0)
        own = own * share(np.where(there, told.p[x] if len(told.p) else 0, _UNSEEN))
        most = most * np.where(there, told.most[x] if len(told.p) else 0, 1)
    # the best that any partner could reach; over 0 a ratio is infinite or NaN
    may = (own == 0) | (most >= min_ratio * (1 - 1e-9))
    token, own = token[may], own[may]
    out: list[list[np.ndarray]] = [[], [], []]
    for row, other in sets.partners(part.u[token]):
        t = token[row]
        (la, lt), (ra, rt) = rows
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = share(lt.of(la[t], other)) * share(rt.of(ra[t], other)) / own[row]
        order = np.where(np.isnan(ratio), np.inf, np.where(np.isinf(ratio), np.finfo(float).max, ratio))  # NaN is above all
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        top = np.repeat(np.maximum.reduceat(order, first), np.diff(np.r_[first, len(row)]))
        hit = np.flatnonzero((order == top) & (order >= min_ratio))
        hit = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]] if len(hit) else hit
        for x, y in zip(out, (t[hit], other[hit], ratio[hit]), strict=True):
            x.append(y)
    return tuple(np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(out, (np.int64, np.int32, float), strict=True))


def _judge(shared, buckets: int, min_ratio: float, names: list[str]):
    def out(blob: bytes, answers: list[tuple[int, bytes, int]]) -> Iterator[pa.RecordBatch]:
        sets = shared.value
        rows = pa.ipc.open_stream(blob).read_all().combine_chunks().to_batches()[0]
        part = _Part(rows, sets, buckets, True)
        told = []
        for side, right in ((part.left, False), (part.right, True)):
            own = [x for x in answers if (x[0] >= buckets) == right]
            told.append(_Told(side, [x[1] for x in own], int(np.sum(np.array([x[2] for x in own], np.int64).view(U64), dtype=U64).view(np.int64)), sets, right))
        token, other, ratio = _best(part, sets, *told, min_ratio)
        lo = 0
        for x, columns in placed(rows, part, token):
            hi = lo + len(x)
            yield pa.RecordBatch.from_arrays([*columns, sets.text.take(pa.array(other[lo:hi])), pa.array(ratio[lo:hi], from_pandas=False)], names)
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blob, answers = None, None, []
        for b in batches:
            for part, bucket, body, check in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if part != now:
                    if blob is not None:
                        yield from out(blob, answers)
                        pa.default_memory_pool().release_unused()
                    now, blob, answers = part, None, []
                if bucket < 0:
                    blob = body
                else:
                    answers.append((bucket, body, check))
        if blob is not None:
            yield from out(blob, answers)

    return run


def _begun(docs: DataFrame, doc: str, text: str, flush: int | None, bucket_bytes: int) -> tuple[DataFrame, int, int, int]:
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(doc), low.alias("low"), F.when(F.length(low) != F.length(text), F.col(text)).alias("raw"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return rows, flush or min(32_000_000, max(8_000_000, size // 4096)), max(1, -(-size // bucket_bytes)), size


def homophones(docs: DataFrame, doc: str, text: str, pairs: DataFrame, min_ratio: float = 5.0, flush: int | None = None, bucket_bytes: int = 8_000_000) -> DataFrame:
    """(doc, start, end, text, fix, confidence) of tokens whose partner in ``pairs`` (w1, w2, f1, f2: uses in ``docs``) fits both neighbours better, as ``detect.homophones`` finds them with all bigrams of the documents themselves.

    ``docs`` has to give its rows in the same order each time, as files do; where it doesn't, an error says so. ``flush`` (bytes of a part) and ``bucket_bytes`` change no result.
    """
    rows, flush, buckets, size = _begun(docs, doc, text, flush, bucket_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(sets_of(pairs, docs, text))
    asked = rows.mapInArrow(_ask(shared, buckets, flush, True), _MET).repartition(max(1, min(2 * buckets, 20_000)), "bucket").sortWithinPartitions("bucket", "part")
    answers = asked.mapInArrow(_tell(shared, buckets), _MET)
    n_parts = min(200_000, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * -(-size // flush)))
    met = rows.mapInArrow(_deal(flush), _MET).unionByName(answers).repartition(n_parts, "part").sortWithinPartitions("part", "bucket")
    out = A.StructType([docs.schema[doc], A.StructField("start", A.IntegerType()), A.StructField("end", A.IntegerType()), A.StructField("text", A.StringType()), A.StructField("fix", A.StringType()), A.StructField("ratio", A.DoubleType())])
    with batches_of(docs.sparkSession, 500):
        found = kept(met.mapInArrow(_judge(shared, buckets, min_ratio, out.names), out))
    return found.select(doc, "start", "end", "text", "fix", ratio_confidence(F.col("ratio")).alias("confidence"))


def _fitting(shared, min_ratio: float, names: list[str]):
    """Of each context and confusable word the best partner there."""

    def each(bucket: int, parts: list[int], held: list[bytes]) -> Iterator[pa.RecordBatch]:
        sets = shared.value
        b = _Bucket(held, sets, False)
        # up to so many uses of a context, six places are exact enough: a partner min_ratio times as likely has nearly as many uses
        may = np.flatnonzero((b.count >= 0.9 * min_ratio) | (b.total > 100_000))
        variant, word = b.meeting(may, sets)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = (b.p[variant] / 1e6) / (b.p[word] / 1e6)
        order = np.where(np.isnan(ratio), np.inf, np.where(np.isinf(ratio), np.finfo(float).max, ratio))  # NaN is above all
        good = np.flatnonzero(order >= min_ratio)
        good = good[np.lexsort((b.u[variant[good]], -order[good], word[good]))]
        good = good[np.r_[True, word[good][1:] != word[good][:-1]]] if len(good) else good
        for lo in range(0, len(good), 1 << 15):
            x = good[lo : lo + (1 << 15)]
            w = word[x]
            yield pa.RecordBatch.from_arrays([pa.array(b.words[b.context[w]].view(np.int64)), sets.text.take(pa.array(b.u[w])), sets.text.take(pa.array(b.u[variant[x]])), pa.array(ratio[x], from_pandas=False)], names)

    return _by_bucket(each)


def statistical(docs: DataFrame, text: str, words: DataFrame, pairs: DataFrame, min_ratio: float = 10.0, flush: int | None = None, bucket_bytes: int = 8_000_000) -> DataFrame:
    """(left, word, variant, ratio, confidence) as ``suggest.statistical_confusables`` finds them with the bigrams of ``docs``, each pair of neighbours asked for once: partners of ``pairs`` that fit the word before much better. ``words``: (word, frequency) of ``docs``. Of ``min_ratio`` at least 1."""
    if min_ratio < 1:
        raise ValueError("min_ratio is at least 1")
    rows, flush, buckets, _ = _begun(docs.withColumn("_doc", F.lit(0)), "_doc", text, flush, bucket_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(sets_of(pairs, docs, text))
    asked = rows.mapInArrow(_ask(shared, buckets, flush, False), _MET).repartition(max(1, min(buckets, 20_000)), "bucket").sortWithinPartitions("bucket", "part")
    with batches_of(docs.sparkSession, 500):
        found = kept(asked.mapInArrow(_fitting(shared, min_ratio, ["h", "word", "variant", "ratio"]), "h bigint, word string, variant string, ratio double"))
    left = words.filter(F.col("frequency") >= 0.9 * min_ratio).select(F.col("word").alias("left")).withColumn("h", _hashed("left"))
    return found.join(left, "h").select("left", "word", "variant", "ratio", ratio_confidence(F.col("ratio")).alias("confidence"))
