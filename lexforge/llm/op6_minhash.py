"""Near-duplicate documents by min-max hashing.

Under each permutation both the least and the greatest hash of a document's shingles are kept, so
a signature of 2n values costs n hash evaluations. Bands of the signature name buckets.

* Documents with equal shingle sets are one class from the start (one aggregation), so copies cost no pairs.
* In each bucket the member with most bucket mates leads. All members of all buckets of one leader form a group;
  two classes that share a bucket thus share a group, and rows grow with the members, not with their pairs.
* Full shingle sets go to the groups; there every pair is compared exactly, in one matrix product, and only a
  spanning forest of the links leaves.
* Groups above ``block`` members (or ``block_shingles`` shingles) are cut into blocks. First each member is compared with its leader, block by block;
  those that link to it are one class and needn't be compared with each other. The rest, few among near copies of one text, is compared with all
  members, block by block. So no pair is left out, no task grows, and rows grow with the group, not with its square, as long as the rest fits a block.
* Connected components of the edges give the classes of the result.

The chance that a pair at the very threshold shares no band is below 1e-6 (see ``bands``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, ids_bitmap, store, table
from .kernels import NOT_SPACE, U64, Words, as_long, bits_set, chunks, group_starts, mix, rolling, seeds, within


def bands(percent: int) -> tuple[int, int]:
    """(bands, values a band) of at most 192 values: as many values a band as let a pair at the threshold miss all bands with a chance of at most 1e-6 (32 of 6 at 85 %, 38 of 5 at 80 %).

    Where even bands of one value miss more, that is the choice down to a recall of 0.99; below (2 %) a ValueError is raised.
    """
    miss = {r: (1 - (percent / 100) ** r) ** (192 // r) for r in range(1, 33)}
    if miss[1] > 0.01:
        raise ValueError(f"a similarity of {percent} % is too low for 192 values")
    r = max((r for r in miss if miss[r] <= 1e-6), default=1)
    return 192 // r, r


def shingles(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (row, shingle hash); fewer than k words are one shingle."""
    w = Words(data, off, NOT_SPACE, lower=True)
    n_words = np.diff(w.first)
    doc, h = [], []
    for n in range(1, k + 1):
        ok = within(w.doc, n)
        if n < k:
            ok = ok & (n_words[w.doc[: len(ok)]] == n)
        at = np.flatnonzero(ok)
        doc.append(w.doc[at])
        h.append(rolling(w.hash, n)[at])
    doc, h = np.concatenate(doc), np.concatenate(h)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    at = group_starts(doc, h)
    return doc[at], h[at]


def _signatures(k: int, n_bands: int, rows: int):
    half = -(-n_bands * rows // 2)
    a, b = seeds(half, 101) | U64(1), seeds(half, 211)
    salt = seeds(n_bands, 307)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, off in chunks(batch.column(1)):
                m = hi - lo
                doc, h = shingles(data, off, k)
                at = group_starts(doc) if len(doc) else np.zeros(0, np.int64)
                has = doc[at]
                n = np.zeros(m, np.int64)
                n[has] = np.diff(np.r_[at, len(doc)])
                sets = np.zeros((2, m), U64)
                keys = np.zeros((len(at), n_bands), U64)
                if len(at):
                    for i in (0, 1):
                        sets[i, has] = np.add.reduceat(mix(h ^ salt[i]), at)
                    v = np.empty_like(h)
                    values = np.empty((2 * half, len(at)), U64)
                    for i in range(half):
                        np.multiply(h, a[i], out=v)
                        np.add(v, b[i], out=v)
                        np.minimum.reduceat(v, at, out=values[2 * i])
                        np.maximum.reduceat(v, at, out=values[2 * i + 1])
                    for j in range(n_bands):
                        x = np.full(len(at), salt[j], U64)
                        for r in range(rows):
                            x = mix(x ^ values[j * rows + r]) * U64(0x9E3779B97F4A7C15)
                        keys[:, j] = x
                ends = np.zeros(m + 1, np.int32)
                ends[1:] = np.cumsum(n > 0) * n_bands
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, m), pa.array(n), pa.array(as_long(sets[0])), pa.array(as_long(sets[1])), pa.ListArray.from_arrays(pa.array(ends), pa.array(as_long(keys.ravel())))],
                    ["doc_id", "n_shingles", "set1", "set2", "keys"],
                )

    return run


def _sets(k: int, wanted):
    """Arrow function: (doc_id, text) to (doc_id, shingle hashes) of the documents in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            if wanted is None:
                continue
            ok = bits_set(wanted.value, mix(ids.fill_null(0).to_numpy(zero_copy_only=False).view(U64))) & ids.is_valid().to_numpy(zero_copy_only=False)
            at = pa.array(np.flatnonzero(ok))
            ids, texts = ids.take(at), batch.column(1).take(at)
            for lo, hi, data, off in chunks(texts):
                doc, h = shingles(data, off, k)
                ends = np.searchsorted(doc, np.arange(hi - lo + 1))
                h = np.ascontiguousarray(h, "<u8")
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array([h[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["doc_id", "shingles"])

    return run


def linked(sets: list[np.ndarray], percent: int, columns: int = 4096) -> np.ndarray:
    """Component (least member's index) of each set under links 100 * |a & b| >= percent * |a | b|; all pairs are compared."""
    m = len(sets)
    label = np.arange(m)
    size = np.array([len(x) for x in sets], np.int64)
    if m < 2 or not size.any():
        return label
    owner = np.repeat(np.arange(m), size)
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    at = group_starts(value)
    df = np.diff(np.r_[at, len(value)])
    shared = np.repeat(df > 1, df)
    owner = owner[shared]
    df = df[df > 1]
    inter = np.zeros((m, m), np.float32)
    col = np.repeat(np.arange(len(df)), df)
    for c in range(0, len(df), columns):
        a, z = np.searchsorted(col, [c, c + columns])
        x = np.zeros((m, min(columns, len(df) - c)), np.float32)
        x[owner[a:z], col[a:z] - c] = 1
        inter += x @ x.T
    link = np.zeros((m, m), bool)
    for r in range(0, m, 256):
        link[r : r + 256] = (100 + percent) * inter[r : r + 256].astype(np.float64) >= percent * (size[r : r + 256, None] + size[None, :])
    link &= (size > 0)[:, None] & (size > 0)[None, :]
    np.fill_diagonal(link, False)
    for i in range(m):
        if label[i] == i and link[i].any():
            seen = np.zeros(m, bool)
            seen[i] = True
            front = np.array([i])
            while len(front):
                near = link[front].any(axis=0) & ~seen
                seen |= near
                front = np.flatnonzero(near)
            label[seen] = i
    return label


def _forest(percent: int):
    """Arrow function over rows sorted by group (leader, i, j): (a, b) edges of a spanning forest of each group's links."""

    def edges(ids: list[int], sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
        order = np.argsort(np.array(ids), kind="stable")
        ids, sets = [ids[x] for x in order], [sets[x] for x in order]
        label = linked(sets, percent)
        at = np.flatnonzero(label != np.arange(len(label)))
        return [ids[x] for x in at], [ids[label[x]] for x in at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets = None, [], []
        for b in batches:
            a_out, b_out = [], []
            keys = list(zip(*(b.column(c).to_pylist() for c in ("leader", "i", "j")), strict=True))
            docs = b.column("doc_id").to_pylist()
            for key, doc, blob in zip(keys, docs, b.column("shingles"), strict=True):
                if key != group:
                    if len(ids) > 1:
                        x, y = edges(ids, sets)
                        a_out += x
                        b_out += y
                    group, ids, sets = key, [], []
                ids.append(doc)
                sets.append(np.frombuffer(blob.as_buffer(), "<u8").astype(U64))
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])
        if len(ids) > 1:
            x, y = edges(ids, sets)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    return run


def _star(percent: int):
    """Arrow function over rows sorted by (leader, i), the leader's own row first: (leader, doc_id, linked) of the other rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, centre = None, np.zeros(0, U64)
        for b in batches:
            out = []
            for key, doc, blob in zip(zip(b.column("leader").to_pylist(), b.column("i").to_pylist(), strict=True), b.column("doc_id").to_pylist(), b.column("shingles"), strict=True):
                own = np.frombuffer(blob.as_buffer(), "<u8").astype(U64)
                if key != group:
                    group, centre = key, own
                    continue
                at = np.searchsorted(centre, own)
                both = int((centre[np.minimum(at, len(centre) - 1)] == own).sum()) if len(centre) else 0
                out.append((key[0], doc, (100 + percent) * both >= percent * (len(own) + len(centre))))
            x = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(x, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["leader", "doc_id", "linked"])

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, block: int = 2048, block_shingles: int = 4_000_000) -> DataFrame:
    """Return (doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id bigint, text).

    Shingles are k lower-cased words. Rows link if 100 * intersection >= percent * union of their sets;
    component_id is the least doc_id reachable by links. Null and empty texts have no shingles and link with nothing;
    so does a row without doc_id, whose component_id is null and which is kept. Rows that share a doc_id are one node.
    Without documents there are no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    n_bands, rows = bands(percent)
    sigs = store(docs.mapInArrow(_signatures(k, n_bands, rows), "doc_id bigint, n_shingles bigint, set1 bigint, set2 bigint, keys array<bigint>"))
    classes = sigs.filter("n_shingles > 0 and doc_id is not null").groupBy("set1", "set2").agg(F.min("doc_id").alias("rep"))
    members = sigs.select("doc_id", "keys", "n_shingles").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    placed = members.select("doc_id", "n_shingles", F.explode("keys").alias("key"))
    full = placed.groupBy("key").agg(F.count("*").alias("mates")).filter("mates > 1")
    placed = store(placed.join(full, "key"))
    degree = placed.groupBy("doc_id").agg(F.sum("mates").alias("degree"))
    placed = placed.join(degree, "doc_id")
    leaders = placed.groupBy("key").agg(F.max(F.struct("degree", -F.col("doc_id"))).alias("best")).select("key", (-F.col("best.col2")).alias("leader"))
    groups = store(placed.join(leaders, "key").select("leader", "doc_id", "n_shingles").distinct())
    sizes = groups.groupBy("leader").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") / block_shingles)).cast("int").alias("blocks"))
    dealt = groups.select("leader", "doc_id").join(sizes, "leader")
    sets = lambda ids: docs.mapInArrow(_sets(k, ids_bitmap(ids.select("doc_id").distinct())), "doc_id bigint, shingles binary")
    small = dealt.filter("blocks = 1").select("leader", F.lit(0).alias("i"), F.lit(0).alias("j"), "doc_id")
    edges = _compared(small, sets(groups), percent)
    large = store(dealt.filter("blocks > 1"))
    if not large.isEmpty():
        edges = edges.unionByName(_large_groups(large, sets(large), percent, block))
    found = components(edges)
    classes = classes.join(found, classes.rep == found.node, "left").select("set1", "set2", F.coalesce("component", "rep").alias("component_id"))
    out = sigs.drop("keys").join(classes, ["set1", "set2"], "left")
    mine = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", mine.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _compared(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of a spanning forest of the links in each cell (leader, i, j) of documents."""
    grouped = cells.join(sets, "doc_id").repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j", "doc_id")
    return grouped.select("leader", "i", "j", "doc_id", "shingles").mapInArrow(_forest(percent), "a bigint, b bigint")


def _large_groups(large: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Edges (a, b) that connect what links connect in groups (leader, doc_id, blocks) of several blocks."""
    own = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    leaders = large.select("leader", "blocks").distinct().select("leader", each("blocks").alias("i"), F.col("leader").alias("doc_id"))
    rows = large.filter("doc_id != leader").select("leader", own("blocks").alias("i"), "doc_id").unionByName(leaders)
    met = rows.join(sets, "doc_id").repartition("leader", "i").sortWithinPartitions("leader", "i", F.col("doc_id") != F.col("leader"))
    star = store(met.select("leader", "i", "doc_id", "shingles").mapInArrow(_star(percent), "leader bigint, doc_id bigint, linked boolean"))
    edges = star.filter("linked").select(F.col("leader").alias("a"), F.col("doc_id").alias("b"))
    rest = star.filter("not linked").select("leader", "doc_id")
    n_rest = store(rest.groupBy("leader").agg(F.ceil(F.count("*") / block).cast("int").alias("rests")))
    if n_rest.isEmpty():
        return edges
    both = large.join(n_rest, "leader")
    cells = rest.join(both, ["leader", "doc_id"]).select("leader", own("rests").alias("i"), each("blocks").alias("j"), "doc_id")
    cells = store(cells.unionByName(both.select("leader", each("rests").alias("i"), own("blocks").alias("j"), "doc_id")).distinct())
    return edges.unionByName(_compared(cells, sets, percent))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM k JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT x, b FROM r JOIN e ON y = a),
c AS (SELECT x, min(y) AS m FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m, d.doc_id) AS component_id, coalesce(m, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON x = d.doc_id
"""
