"""Judgements of tokens by counts of the whole corpus, without a row for each token or pair.

Texts are dealt into parts of some MB. A part asks for each of its distinct pairs once, bucket by bucket, as packed 64-bit hashes in an order that it finds again;
a bucket answers in that order, so an answer is a number for each pair asked for. Texts are shuffled once, to their answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as A

from ..functions.hashes import U64, of_pairs, of_spans, spans
from ..session import kept

#: Bytes of text that are tokenised at once; rows that go back at once.
_AT_ONCE, _ROWS = 1 << 18, 1 << 15
_ASKED = A.StructType([A.StructField("bucket", A.IntegerType()), A.StructField("part", A.LongType()), A.StructField("words", A.BinaryType()), A.StructField("runs", A.BinaryType()), A.StructField("pairs", A.BinaryType()), A.StructField("counts", A.BinaryType())])
_ANSWERED = A.StructType([A.StructField("part", A.LongType()), A.StructField("bucket", A.IntegerType()), A.StructField("body", A.BinaryType()), A.StructField("check", A.LongType()), A.StructField("hot", A.BinaryType()), A.StructField("total", A.LongType())])


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets."""
    column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]], off - off[0]


def _parts(batches: Iterator[pa.RecordBatch], flush: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(part, rows) of (doc, small letters, text): rows until they have ``flush`` bytes, wherever batches end."""
    task, part, held, size = TaskContext.get().partitionId() if TaskContext.get() else 0, 0, [], 0

    def out() -> tuple[int, pa.RecordBatch]:
        made = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()
        return (task << 24) + part, made

    for batch in batches:
        lo = 0
        ends = np.cumsum(np.diff(_texts(batch.column(1))[1]))
        while lo < len(batch):
            before = ends[lo - 1] if lo else 0
            hi = int(np.searchsorted(ends, before + flush - size, "left")) + 1
            held.append(batch.slice(lo, min(hi, len(batch)) - lo))
            size += int(ends[min(hi, len(batch)) - 1] - before)
            lo = min(hi, len(batch))
            if size >= flush:
                yield out()
                part, size = part + 1, 0
    if held:
        yield out()


def tokens_in(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, length, text, hash) of the tokens of texts."""
    found: list[list[np.ndarray]] = [[], [], [], []]
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + _AT_ONCE, "right")) - 1)
        own = data[off[lo] : off[hi]]
        begin, end, doc = spans(own, off[lo : hi + 1] - off[lo])
        for x, y in zip(found, ((begin + off[lo]).astype(np.int64), (end - begin).astype(np.int32), (doc + lo).astype(np.int32), of_spans(own, begin, end)), strict=True):
            x.append(y)
        lo = hi
    return tuple(np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(found, (np.int64, np.int32, np.int32, U64), strict=True))


class Part:
    """Tokens of a part's texts: ``begin`` and ``end`` (bytes), ``doc`` (row), ``hash``; and its distinct pairs in the order in which it asks for them."""

    def __init__(self, rows: pa.RecordBatch, buckets: int, hot: np.ndarray) -> None:
        self.data, self.off = _texts(rows.column(1))
        self.begin, self.length, self.doc, self.hash = tokens_in(self.data, self.off)
        self.same = self.doc[1:] == self.doc[:-1]
        a, b = self.hash[:-1][self.same], self.hash[1:][self.same]
        self.pairs, first, self.at, self.counts = np.unique(of_pairs(a, b), return_index=True, return_inverse=True, return_counts=True)
        self.first = a[first]
        # pairs of a very common word are dealt by themselves, others by their first word
        self.hot = np.isin(self.first, hot)
        self.bucket = (np.where(self.hot, self.pairs, self.first) % U64(buckets)).astype(np.int32)
        self.order = np.lexsort((self.first, self.bucket))
        self.check = int(np.bitwise_xor.reduce(self.pairs).view(np.int64)) if len(self.pairs) else 0

    def asks(self) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
        bucket = self.bucket[self.order]
        for lo, hi in _runs(bucket):
            x = self.order[lo:hi]
            starts = np.array([a for a, _ in _runs(self.first[x])])
            yield int(bucket[lo]), self.first[x][starts].tobytes(), np.diff(np.r_[starts, len(x)]).astype("<u4").tobytes(), self.pairs[x].tobytes(), self.counts[x].astype("<u4").tobytes()

    def met(self, answers: np.ndarray, check: int) -> np.ndarray:
        """The answers, which came in the order of the buckets, in the order of ``pairs``. ``check``: of the pairs that were asked for."""
        if len(answers) != len(self.pairs) or check != self.check:
            raise ValueError("a part has not met its answers: the documents came in another order than before")
        out = np.empty(len(answers), answers.dtype)
        out[self.order] = answers
        return out


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    if not len(keys):
        return []
    at = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
    return list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def _ask(buckets: int, hot: np.ndarray, flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _parts(batches, flush):
            asks = [(b, key, *x) for b, *x in Part(rows, buckets, hot).asks()]
            for lo in range(0, len(asks), 64):
                yield pa.RecordBatch.from_arrays([pa.array(x, f) for x, f in zip(zip(*asks[lo : lo + 64], strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], _ASKED.names)
            asks = rows = None
            pa.default_memory_pool().release_unused()

    return run


def per_million(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """count / total to six places, in millionths: halves go up, as in SQL's round."""
    return (2_000_000 * count + total) // np.maximum(2 * total, 1)


def _answer(hot: np.ndarray, min_count: int, judge):
    """Arrow function over asks sorted by bucket: for a pair what ``judge`` (count, millionths) says; for one of a very common word its count, whose sums by first word come as rows of their own. Pairs below ``min_count`` have 0."""

    def out(bucket: int, held: list[tuple]) -> pa.RecordBatch:
        sizes = [len(x[3]) // 8 for x in held]
        pairs = np.concatenate([np.frombuffer(x[3], U64) for x in held])
        first = np.concatenate([np.repeat(np.frombuffer(x[1], U64), np.frombuffer(x[2], "<u4")) for x in held])
        n = np.concatenate([np.frombuffer(x[4], "<u4") for x in held])
        every, one, at = np.unique(pairs, return_index=True, return_inverse=True)
        count = np.bincount(at, n, len(every)).astype(np.int64)
        count[count < min_count] = 0
        words, w = np.unique(first[one], return_inverse=True)
        total = np.bincount(w, count, len(words)).astype(np.int64)
        common = np.isin(words, hot)
        value = np.where(common[w], count, np.where(count > 0, judge(count, per_million(count, total[w])), 0)).astype("<i4")[at]
        rows, lo = [], 0
        for x, size in zip(held, sizes, strict=True):
            rows.append((x[0], bucket, value[lo : lo + size].tobytes(), int(np.bitwise_xor.reduce(pairs[lo : lo + size]).view(np.int64)), None, None))
            lo += size
        rows += [(None, bucket, None, None, words[i].tobytes(), int(total[i])) for i in np.flatnonzero(common)]
        return pa.RecordBatch.from_arrays([pa.array(x, f) for x, f in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int64()), strict=True)], _ANSWERED.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for bucket, *x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != now and held:
                    yield out(now, held)
                    pa.default_memory_pool().release_unused()
                    held = []
                now = bucket
                held.append(x)
        if held:
            yield out(now, held)

    return run


def _deal(flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _parts(batches, flush):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as to:
                to.write_batch(rows)
            none = lambda kind: pa.nulls(1, kind)
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([-1], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), none(pa.int64()), none(pa.binary()), none(pa.int64())], _ANSWERED.names)

    return run


def _chars(data: np.ndarray, off: np.ndarray, begin: np.ndarray, length: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of spans in code points of their texts."""
    tail = np.flatnonzero((data & 0xC0) == 0x80)
    at = lambda x: x - np.searchsorted(tail, x)
    base = at(off[:-1])[doc]
    return (at(begin) - base).astype(np.int32), (at(begin + length) - base).astype(np.int32)


def placed(rows: pa.RecordBatch, part, taken: np.ndarray) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """(tokens, [doc, start, end, token]) of the tokens ``taken`` of a part, some at once."""
    # places are those of the text as it was, where small letters are more or fewer
    odd = rows.column(2).is_valid().to_numpy(zero_copy_only=False)
    raw = None
    if odd.any():
        data, off = _texts(pc.coalesce(rows.column(2), rows.column(1)))
        raw = data, off, *spans(data, off)
    for lo in range(0, len(taken), _ROWS):
        x = taken[lo : lo + _ROWS]
        doc, begin, length = part.doc[x], part.begin[x], part.length[x]
        a, z = int(doc[0]), int(doc[-1]) + 1
        whole = part.data[part.off[a] : part.off[z]]
        if raw is None:
            start, end = _chars(whole, part.off[a : z + 1] - part.off[a], begin - part.off[a], length, doc - a)
        else:
            data, off, first, last, _ = raw
            start, end = _chars(data[off[a] : off[z]], off[a : z + 1] - off[a], first[x] - off[a], (last - first)[x], doc - a)
        upto = np.r_[0, np.cumsum(length)]
        at = np.repeat(begin - upto[:-1], length) + np.arange(upto[-1])
        token = pa.StringArray.from_buffers(len(x), pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(part.data[at]))
        yield x, [rows.column(0).take(pa.array(doc)), pa.array(start), pa.array(end), token]


def _judge(buckets: int, hot: np.ndarray, totals: np.ndarray, flush: int, judge, choose, names: list[str]):
    """Arrow function over a part's texts (bucket -1) and its answers: the tokens that ``choose`` takes from what is said of the pairs on their left and right (-1 without a neighbour)."""

    def out(blob: bytes, answers: list[bytes], check: int) -> Iterator[pa.RecordBatch]:
        rows = pa.ipc.open_stream(blob).read_all().combine_chunks().to_batches()[0]
        part = Part(rows, buckets, hot)
        said = part.met(np.concatenate([np.frombuffer(x, "<i4") for x in answers]) if answers else np.zeros(0, "<i4"), check).astype(np.int64)
        h = np.flatnonzero(part.hot)
        total = totals[np.searchsorted(hot, part.first[h])]
        said[h] = np.where(said[h] > 0, judge(said[h], per_million(said[h], total)), 0)
        left, right = np.full(len(part.hash), -1, np.int64), np.full(len(part.hash), -1, np.int64)
        here = np.flatnonzero(part.same)
        left[here + 1] = right[here] = said[part.at]
        taken = np.flatnonzero(choose(left, right))
        for _, columns in placed(rows, part, taken):
            yield pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blob, answers, check = None, None, [], 0
        for b in batches:
            for part, bucket, body, own in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if part != now and blob is not None:
                    yield from out(blob, answers, check)
                    pa.default_memory_pool().release_unused()
                if part != now:
                    now, blob, answers, check = part, None, [], 0
                if bucket < 0:
                    blob = body
                else:
                    answers.append(body)
                    check ^= own
        if blob is not None:
            yield from out(blob, answers, check)

    return run


def _common(rows: DataFrame, share: float) -> np.ndarray:
    """Hashes of the words with more than ``share`` of the tokens, as far as a hundredth of the texts shows; they say how work is dealt, and no result depends on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = Part(b, 1, np.zeros(0, U64))
            words, n = np.unique(part.hash, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["w", "n"])

    n = rows.sample(0.01, 7).mapInArrow(run, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    least = (n.agg(F.sum("n")).first()[0] or 0) * share
    return np.sort(np.array([r[0] for r in n.filter(F.col("n") > max(least, 20)).select("w").collect()], np.int64).view(U64))


def unlikely(docs: DataFrame, doc: str, text: str, min_count: int = 2, threshold: float = 0.001, flush: int | None = None, bucket_bytes: int = 8_000_000, hot_share: float | None = None) -> DataFrame:
    """(doc, start, end, token) of the tokens, in small letters, whose pairs with both neighbours are rarer than ``threshold``, as ``detect.unlikely`` finds them with the bigrams of the documents themselves (``min_count`` or more, probabilities to six places).

    ``docs`` has to give its rows in the same order each time, as files do; where it doesn't, an error says so. Steps are kept in ``spark.checkpoint.dir``. ``flush`` (bytes of a part), ``bucket_bytes`` and ``hot_share`` change no result.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(doc), low.alias("low"), F.when(F.length(low) != F.length(text), F.col(text)).alias("raw"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    flush = flush or min(64_000_000, max(12_000_000, size // 4096))
    buckets = max(1, -(-size // bucket_bytes))
    hot = _common(rows, hot_share or 1 / (4 * buckets)) if buckets > 1 or hot_share else np.zeros(0, U64)
    least = np.int64(np.ceil(threshold * 1e6 - 1e-6))
    likely = lambda count, millionths: (millionths >= least).astype(np.int64)
    asked = rows.mapInArrow(_ask(buckets, hot, flush), _ASKED).repartition("bucket").sortWithinPartitions("bucket", "part")
    answers = kept(asked.mapInArrow(_answer(hot, min_count, likely), _ANSWERED))
    totals = np.zeros(len(hot), np.int64)
    for word, n in answers.filter("hot is not null").groupBy("hot").agg(F.sum("total").alias("n")).collect():
        totals[np.searchsorted(hot, np.frombuffer(bytes(word), U64))] = n
    n_parts = min(200_000, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * -(-size // flush)))
    met = rows.mapInArrow(_deal(flush), _ANSWERED).unionByName(answers.filter("hot is null")).repartition(n_parts, "part").sortWithinPartitions("part", "bucket")
    out = A.StructType([docs.schema[doc], A.StructField("start", A.IntegerType()), A.StructField("end", A.IntegerType()), A.StructField("token", A.StringType())])
    choose = lambda left, right: (left <= 0) & (right <= 0) & ((left == 0) | (right == 0))
    return met.mapInArrow(_judge(buckets, hot, totals, flush, likely, choose, out.names), out)
