"""Benchmark decontamination by winnowing.

Words are hashed; of every window of ``window`` words the least hash of its
k-grams is kept as a fingerprint (k = (window + 1) // 2), so a document and an
item that share a whole window always share the fingerprint at its place.
Documents' and items' fingerprints are joined and each hit is extended, word by
word, to both sides; hits that reach ``window`` equal words mark spans. Items
shorter than a window are looked up as a whole, by the hash of all their words.

A bitmap of the items' fingerprints (at most 128 MB, whatever their number) goes to
the executors and only spares the join rows that can't match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, bitmap_bits, same, store, table
from .kernels import ALNUM, Words, as_long, bits_set, chunks, mix, rolling, sliding_min, within

_HITS = "array<struct<pos:int,n:int,fp:bigint,words:binary>>"
_HIT_TYPE = pa.list_(pa.struct([("pos", pa.int32()), ("n", pa.int32()), ("fp", pa.int64()), ("words", pa.binary())]))


def _select(w: Words, window: int) -> np.ndarray:
    """Places of the winnowed k-grams."""
    k = (window + 1) // 2
    grams = rolling(w.hash, k)
    best = sliding_min(grams, window - k + 1)
    ok = within(w.doc, window)
    return np.unique(best[ok[: len(best)]]), grams


def _around(w: Words, at: np.ndarray, k: int, side: int, missing: int) -> np.ndarray:
    """Hashes of the words from ``side`` before to ``side`` behind each k-gram; places outside of the document hold ``missing``."""
    idx = at[:, None] + np.arange(-side, k + side)
    ok = (idx >= 0) & (idx < len(w))
    idx = np.clip(idx, 0, max(len(w) - 1, 0))
    ok &= w.doc[idx] == w.doc[at][:, None]
    return np.where(ok, w.hash[idx], np.uint64(missing))


def _fingerprint(window: int, lengths: tuple[int, ...], keep, item: bool):
    """Arrow function: (id, text) to (id, n_words, hits). Items give all fingerprints; documents those in the bitmap, and n-grams of the lengths of short items."""
    k, missing = (window + 1) // 2, 1 if item else 2
    side = window - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, off in chunks(batch.column(1)):
                w = Words(data, off, ALNUM, lower=True)
                n_words = np.diff(w.first)
                at, grams = _select(w, window)
                found = [(at, np.zeros(len(at), np.int32), mix(grams[at]) if len(at) else grams[:0])]
                for n in lengths:
                    h, ok = rolling(w.hash, n), within(w.doc, n)
                    if item:
                        ok = ok & (n_words[w.doc[: len(ok)]] == n)
                    p = np.flatnonzero(ok)
                    found.append((p, np.full(len(p), n, np.int32), mix(h[p] + np.uint64(n))))
                at, n, fp = (np.concatenate(x) for x in zip(*found, strict=True))
                if keep is not None:
                    ok = bits_set(keep.value, fp)
                    at, n, fp = at[ok], n[ok], fp[ok]
                order = np.argsort(at, kind="stable")
                at, n, fp = at[order], n[order], fp[order]
                around = _around(w, at, k, side, missing).astype("<u8")
                blobs = [row.tobytes() if m == 0 else b"" for row, m in zip(around, n, strict=True)]
                ends = np.searchsorted(at, w.first)
                hits = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()),
                    pa.StructArray.from_arrays([pa.array(at - w.first[w.doc[at]] if len(at) else at, pa.int32()), pa.array(n, pa.int32()), pa.array(as_long(fp)), pa.array(blobs, pa.binary())], fields=list(_HIT_TYPE.value_type)),
                )
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n_words, pa.int64()), hits], ["id", "n_words", "hits"])

    return run


def _extend(window: int):
    """Arrow function: joined fingerprints to (doc, start, end, item) of the spans that reach a window."""
    k = (window + 1) // 2
    side = window - k
    names = ["id", "start", "end", "item"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, pos = b.column("n").to_numpy(), b.column("pos").to_numpy()
            start, end = pos.copy(), pos + n
            long = np.flatnonzero(n == 0)
            keep = n > 0
            if len(long):
                x, y = (np.frombuffer(b"".join(b.column(c).take(pa.array(long)).to_pylist()), "<u8").reshape(len(long), k + 2 * side) for c in ("words", "item_words"))
                eq = x == y
                left = np.cumprod(eq[:, :side][:, ::-1], axis=1).sum(1)
                right = np.cumprod(eq[:, side + k :], axis=1).sum(1)
                start[long], end[long] = pos[long] - left, pos[long] + k + right
                keep[long] = eq[:, side : side + k].all(1) & (left + k + right >= window)
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), pa.array(start[keep], pa.int32()), pa.array(end[keep], pa.int32()), b.column("item").take(at)], names)

    return run


def judged(docs: DataFrame, items: DataFrame, window: int = 13, percent: int = 5) -> DataFrame:
    """Return (id, n_words, n_hit, n_items, items_sha256, contaminated, items) for each row of ``docs``; id is (doc_id, xxhash64 of the text). See ``contamination``."""
    spark = docs.sparkSession
    items = items.filter("item_id is not null").select("item_id", "text")
    lengths = tuple(range(1, window))
    prints = store(items.mapInArrow(_fingerprint(window, lengths, None, True), f"id {items.schema['item_id'].dataType.simpleString()}, n_words bigint, hits {_HITS}"))
    prints = prints.select(F.col("id").alias("item"), F.explode("hits").alias("h")).select("item", F.col("h.fp").alias("fp"), F.col("h.n").alias("item_n"), F.col("h.words").alias("item_words")).distinct()
    stats = prints.agg(F.count("*"), F.collect_set("item_n")).first()
    kept = spark.sparkContext.broadcast(bitmap(prints, "fp", bitmap_bits(stats[0])))
    short = tuple(sorted(n for n in stats[1] if n))
    rows = docs.select(F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("id"), "text")
    id_type = rows.schema["id"].dataType.simpleString()
    base = store(rows.mapInArrow(_fingerprint(window, short, kept, False), f"id {id_type}, n_words bigint, hits {_HITS}"))
    hits = base.select("id", F.explode("hits").alias("h")).select("id", "h.*")
    joined = hits.join(prints, (hits.fp == prints.fp) & (hits.n == prints.item_n)).select("id", "pos", "n", "words", "item", "item_words")
    spans = joined.mapInArrow(_extend(window), f"id {id_type}, start int, end int, item {prints.schema['item'].dataType.simpleString()}")
    # one row a document: its items, and the union of its spans by a running end
    one = spans.groupBy("id").agg(F.array_sort(F.transform(F.collect_set("item"), lambda x: x.cast("string"))).alias("items"), F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    union = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda s, x: F.struct((s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["to"]), F.lit(0))).alias("n"), F.greatest(s["to"], x["end"]).alias("to")),
    )["n"]
    one = one.select("id", "items", union.alias("n_hit"))
    out = same(base.select("id", "n_words"), one, "id")
    out = out.select("id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.select(
        "id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"), "items",
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, percent: int = 5) -> DataFrame:
    """Return (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items) for each row of ``docs`` (doc_id, text), judged against ``items`` (item_id, text).

    A document word is hit if a run of ``window`` words around it also stands in an item, or if
    it lies in an occurrence of a whole item shorter than that. Contaminated: hit, and at
    least ``percent`` of the words are. Null and empty texts have no words; items without words match nothing; a null
    item_id is no item. Each row is judged by its own text, also where rows share a doc_id or have none. Extra columns are ignored. Without items nothing is hit.
    """
    out = judged(docs, items, window, percent)
    return out.select(F.col("id.doc_id").alias("doc_id"), *out.columns[1:])


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, p, n, item_id FROM dw JOIN iw USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hit)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""
