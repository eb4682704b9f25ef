"""Substring dedup: repeated windows of ``window`` words, by Rabin-Karp hashes.

1. Anchors. Each window's least hash of half-window k-grams is its anchor; equal windows
   have equal anchors. Anchors are counted in Spark, and those that stand
   in several documents go to the executors as a bitmap of fixed size. A window whose anchor isn't
   there occurs in one document only, so its hash needs no shuffle; this loses no window.
2. Windows. The Rabin-Karp hashes of all other windows are gathered by hash. A task first
   settles what repeats inside its own rows, so that a window that a third of all documents
   share comes once from a task and not once from a document. The least doc_id of each hash decides.
3. Removal. A document's removed windows merge into maximal intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LAST, bitmap, bitmap_bits, repeated_ids, same, store, table, tags_of
from .kernels import NOT_SPACE, Words, as_long, bits_set, chunks, group_starts, mix, rolling, sliding_min, within


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)


def _anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of each window's anchor, anchor hashes); windows that cross documents included."""
    k = (window + 1) // 2
    grams = rolling(w.hash, k)
    return sliding_min(grams, window - k + 1), grams


def _anchor_rows(window: int, flush: int):
    def reduced(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        h, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        h, lo, hi = h[order], lo[order], hi[order]
        at = group_starts(h)
        return h[at], np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        out = lambda h, lo, hi: pa.RecordBatch.from_arrays([pa.array(as_long(h)), pa.array(lo), pa.array(hi)], ["anchor", "lo", "hi"])
        for batch in batches:
            ids = _ids(batch)
            for lo, _, data, off in chunks(batch.column(1)):
                w = Words(data, off, NOT_SPACE)
                best, grams = _anchors(w, window)
                if not len(best):
                    continue
                at = np.unique(best[within(w.doc, window)])
                doc = ids[lo + w.doc[at]]
                if len(at):
                    parts.append((mix(grams[at]), doc, doc))
                    n += len(at)
            if n > flush:
                yield out(*reduced(parts))
                parts, n = [], 0
        if parts:
            yield out(*reduced(parts))

    return run


def _runs(doc: np.ndarray, tag: np.ndarray, pos: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal intervals (doc, tag, start, end) covered by windows at sorted (doc, tag, pos)."""
    if not len(doc):
        return doc, tag, pos, pos
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (pos[1:] > pos[:-1] + window)
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(doc)] - 1
    return doc[at], tag[at], pos[at], pos[last] + window


def _window_rows(window: int, kept, repeated, flush: int):
    """Arrow function: (doc_id, text, hash of the text) to (hash, doc_id, tag, start, end, settled)."""

    def rows(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h, doc, tag, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((doc, h))
        hs, ds = h[order], doc[order]
        at = group_starts(hs)
        if not len(at):
            return
        least = np.repeat(ds[at], np.diff(np.r_[at, len(hs)]))
        gone = np.zeros(len(h), bool)
        gone[order] = ds > least
        g = np.flatnonzero(gone)
        g = g[np.lexsort((pos[g], tag[g], doc[g]))]
        d, t, start, end = _runs(doc[g], tag[g], pos[g], window)
        own = mix(d.view(np.uint64) * np.uint64(1_000_003) + start.astype(np.uint64))
        p = np.flatnonzero(~gone)
        yield pa.RecordBatch.from_arrays(
            [pa.array(as_long(np.r_[h[p], own])), pa.array(np.r_[doc[p], d]), pa.array(np.r_[tag[p], t]), pa.array(np.r_[pos[p], start].astype(np.int32)), pa.array(np.r_[pos[p] + window, end].astype(np.int32)), pa.array(np.r_[np.zeros(len(p), bool), np.ones(len(d), bool)])],
            ["hash", "doc_id", "tag", "start", "end", "settled"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            ids = _ids(batch)
            tags = tags_of(ids, batch.column(2).to_numpy(), repeated)
            for lo, _, data, off in chunks(batch.column(1)):
                w = Words(data, off, NOT_SPACE)
                best, grams = _anchors(w, window)
                if not len(best):
                    continue
                hot = bits_set(kept.value, mix(grams))
                at = np.flatnonzero(within(w.doc, window) & hot[best])
                if len(at):
                    parts.append((rolling(w.hash, window)[at], ids[lo + w.doc[at]], tags[lo + w.doc[at]], at - w.first[w.doc[at]]))
                    n += len(at)
                if n > flush:
                    yield from rows(parts)
                    parts, n = [], 0
        if parts:
            yield from rows(parts)

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, hash of the text, cuts) to (doc_id, n_words, n_removed, kept_sha256)."""
    for b in batches:
        n_words, n_gone, sha = [], [], []
        for text, own, cuts in zip(b.column("text"), b.column("own").to_pylist(), b.column("cuts"), strict=True):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            n, gone = len(words), 0
            if cuts.is_valid:
                kept, to = [], 0
                for x in cuts.as_py():
                    a, z = max(x["start"], to), x["end"]
                    if z > to and x["tag"] in (0, own):
                        kept += words[to:a]
                        gone += z - a
                        to = z
                words = kept + words[to:]
            n_words.append(n)
            n_gone.append(gone)
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def removals(docs: DataFrame, window: int = 50, bits: int = 27, flush: int = 2_000_000) -> DataFrame:
    """Return (doc_id, tag, start, end) of overlapping or adjoining intervals of words (from 0, end exclusive) whose windows also start in a document with a smaller doc_id.

    ``tag`` is xxhash64 of the row's text where several rows have the doc_id, else 0. A bitmap of 2**bits bits or more (16 an anchor, 128 MB at most) says which anchors repeat; if it is too small for
    the input more windows are shuffled, with the same result. ``flush``: windows that a task settles together.
    A null doc_id counts as the largest (and rows with it don't precede one another, as rows of one doc_id don't).
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("own"))
    repeated = repeated_ids(docs)
    anchors = docs.mapInArrow(_anchor_rows(window, flush // 4), "anchor bigint, lo bigint, hi bigint")
    shared = store(anchors.groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("anchor"))
    kept = spark.sparkContext.broadcast(bitmap(shared, "anchor", bitmap_bits(shared.count(), least=bits)))
    rows = docs.mapInArrow(_window_rows(window, kept, repeated, flush), "hash bigint, doc_id bigint, tag bigint, start int, end int, settled boolean")
    first = F.min(F.when(~F.col("settled"), F.col("doc_id"))).over(Window.partitionBy("hash"))
    return rows.withColumn("first", first).filter("settled or doc_id > first").select("doc_id", "tag", "start", "end")


def dedup_digests(docs: DataFrame, window: int = 50) -> DataFrame:
    """Return (doc_id, n_words, n_removed, kept_sha256) for each row of ``docs`` (doc_id bigint, text).

    Null text has no words. Texts shorter than a window keep all words. Each row loses windows of its own text only, also where rows share a doc_id. Without documents there are no rows. Other columns are ignored.
    """
    cuts = removals(docs, window).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "tag"))).alias("cuts"))
    cuts = cuts.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(LAST), F.col("doc_id")))
    joined = same(docs.select("doc_id", "text", F.xxhash64("text").alias("own")), cuts, "doc_id").select("doc_id", "text", "own", "cuts")
    return joined.mapInArrow(_digests, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digests(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
first AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS m FROM win),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(p, p + 50)))) AS q FROM first WHERE doc_id > m GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS s
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) t
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(q) AS i FROM gone) g WHERE g.doc_id = t.doc_id AND g.i = t.i)
  GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(q), 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
