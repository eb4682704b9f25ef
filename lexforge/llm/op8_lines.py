"""Line dedup with a log-template tree.

Lines are split at newlines, tokens at white space. The tree has a fixed depth: token count, then the
first ``depth`` tokens, in which tokens with a digit count as a variable field. The path is a line's leaf.

1. Leaves (and long lines, see below) are counted by document; in most leaves no line can recur and their lines go no further.
2. In the others the distinct lines, fields masked, pass by with their counts, the commonest first. A task holds the templates of one leaf, not its lines;
   above ``leaf_lines`` lines candidates come from an index by runs of equal tokens, which gives the same templates.
   There, lines join the template that shares most of their tokens, if that is at least ``similarity`` of them; where they differ the template gets a field.
3. Templates in at least ``min_docs`` documents recur. Their lines stay in the document with the least doc_id and are dropped from all others.

Long lines (``long_words`` tokens that are no field) that are alike but for their fields recur from two documents on; see ``recurring_long_lines``.

Counts of lines are summed inside a task before they are shuffled, so a line of a third of all documents is one row a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LAST, bitmap, fresh, repeated_ids, salted, same, store, table, tags_of
from .kernels import NOT_SPACE, U64, Words, as_long, bits_set, chunks, group_starts, mix

_b = np.arange(256)
_LINE = _b != 10
_DIGIT = (_b >= 48) & (_b <= 57)
_FIELD = U64(0xF1E1D)


class Lines:
    """Lines with tokens of a run of documents: ``doc``, ``no`` (from 0, all lines counted), ``leaf``, ``hash`` (of the masked tokens), and tokens ``tok[first:end]``."""

    def __init__(self, data: np.ndarray, off: np.ndarray, depth: int) -> None:
        w = Words(data, off, NOT_SPACE)
        lines = Words(data, off, _LINE, hashes=False)
        digits = np.r_[0, np.cumsum(_DIGIT[data])]
        self.tok = np.where(digits[w.end] > digits[w.start], _FIELD, w.hash)
        first = np.searchsorted(w.start, lines.start)
        end = np.searchsorted(w.start, lines.end)
        has = end > first
        self.first, self.end, self.doc = first[has], end[has], lines.doc[has]
        breaks = np.r_[0, np.cumsum(data == 10)]
        self.no = (breaks[lines.start] - breaks[off[lines.doc]])[has]
        n = self.end - self.first
        leaf = n.astype(U64) * U64(0x9E3779B97F4A7C15)
        for i in range(depth):
            at = np.minimum(self.first + i, self.end - 1)
            leaf = mix(leaf ^ np.where(i < n, self.tok[at], U64(0)))
        self.leaf = leaf
        self.hash = _line_hashes(self.tok, self.first, self.end)


def _line_hashes(tok: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(first):
        return np.zeros(0, U64)
    n = end - first
    where = np.arange(len(tok)) - np.repeat(first, n)
    return mix(np.add.reduceat(mix(tok + where.astype(U64) * U64(0xD1B54A32D192ED03)), first) + n.astype(U64))


def _survey(depth: int | None, words: int | None, flush: int):
    """Arrow function: (doc_id, text) to (kind, key, documents): 0 the leaves of a tree of ``depth``, 1 the lines of ``words`` tokens that are no field; None leaves a kind out."""

    def out(parts: tuple[list[np.ndarray], list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for kind, found in enumerate(parts):
            if found:
                key, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(as_long(key)), pa.array(n)], ["kind", "key", "docs"])

    def once(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        return key[group_starts(doc, key)] if len(key) else key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = ([], []), 0
        for b in batches:
            for _, _, data, off in chunks(b.column(1)):
                x = Lines(data, off, depth or 0)
                if depth is not None:
                    parts[0].append(once(x.doc, x.leaf))
                    n += len(parts[0][-1])
                if words is not None:
                    plain = np.r_[0, np.cumsum(x.tok != _FIELD)]
                    at = np.flatnonzero(plain[x.end] - plain[x.first] >= words)
                    parts[1].append(once(x.doc[at], x.hash[at]))
                    n += len(parts[1][-1])
            if n > flush:
                yield from out(parts)
                parts, n = ([], []), 0
        yield from out(parts)

    return run


def _masked(depth: int, kept, flush: int):
    """Arrow function: (doc_id, text) to distinct (leaf, line, documents, tokens) in the leaves of the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        size = 0

        def out() -> pa.RecordBatch:
            keys = np.array(list(seen), U64)
            v = list(seen.values())
            return pa.RecordBatch.from_arrays([pa.array(as_long(np.array([x[0] for x in v], U64))), pa.array(as_long(keys)), pa.array([x[1] for x in v], pa.int64()), pa.array([x[2] for x in v], pa.binary())], ["leaf", "line", "docs", "tokens"])

        for b in batches:
            for _, _, data, off in chunks(b.column(1)):
                x = Lines(data, off, depth)
                at = np.flatnonzero(bits_set(kept.value, x.leaf))
                at = at[np.lexsort((x.hash[at], x.doc[at]))]
                at = at[group_starts(x.doc[at], x.hash[at])] if len(at) else at
                for i, h, leaf in zip(at, x.hash[at].tolist(), x.leaf[at].tolist(), strict=True):
                    if (old := seen.get(h)) is not None:
                        old[1] += 1
                    else:
                        t = x.tok[x.first[i] : x.end[i]].astype("<u8").tobytes()
                        seen[h] = [leaf, 1, t]
                        size += len(t) + 200
            if size > flush:
                yield out()
                seen, size = {}, 0
        if seen:
            yield out()

    return run


class Leaf:
    """Templates of the lines of one leaf, which come with the commonest first, then by line."""

    def __init__(self, n: int, similarity: float, depth: int, leaf_lines: int) -> None:
        self.least = next((e for e in range(n + 1) if e / n >= similarity), n + 1)
        self.n, self.lines, self.leaf_lines = n, 0, leaf_lines
        self.made, self.fields = np.zeros((4, n), U64), np.zeros((4, n), bool)
        self.owner: list[int] = []
        # one of these runs of tokens is equal, and no field, where a line fits: there is a run more than tokens may differ
        cuts = np.linspace(min(depth, n), n, max(n - self.least, 0) + 2).astype(int)
        self.runs = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        self.index: dict[tuple[int, bytes], set[int]] | None = None

    def _keys(self, j: int) -> Iterator[tuple[int, bytes]]:
        for i, (a, z) in enumerate(self.runs):
            if not self.fields[j, a:z].any():
                yield i, self.made[j, a:z].tobytes()

    def put(self, line: int, tokens: bytes) -> int:
        """The template, by its first line, of a line."""
        t = np.frombuffer(tokens, "<u8").astype(U64)
        self.lines += 1
        if self.index is None and self.lines > self.leaf_lines:
            self.index = {}
            for j in range(len(self.owner)):
                for key in self._keys(j):
                    self.index.setdefault(key, set()).add(j)
        if self.index is None:
            at = np.arange(len(self.owner))
        else:
            at = np.array(sorted(set().union(*(self.index.get((i, t[a:z].tobytes()), ()) for i, (a, z) in enumerate(self.runs)))), int)
        if len(at):
            equal = ((self.made[at] == t) & ~self.fields[at]).sum(axis=1)
            best = int(np.argmax(equal))
            if equal[best] >= self.least:
                j = int(at[best])
                wider = self.made[j] != t
                if self.index is not None and (wider & ~self.fields[j]).any():
                    before = set(self._keys(j))
                    self.fields[j] |= wider
                    for key in before - set(self._keys(j)):
                        self.index[key].discard(j)
                else:
                    self.fields[j] |= wider
                return self.owner[j]
        j = len(self.owner)
        if j == len(self.made):
            self.made, self.fields = np.concatenate([self.made, np.zeros_like(self.made)]), np.concatenate([self.fields, np.zeros_like(self.fields)])
        self.made[j], self.fields[j] = t, False
        self.owner.append(line)
        if self.index is not None:
            for key in self._keys(j):
                self.index.setdefault(key, set()).add(j)
        return line


def _parse(similarity: float, depth: int, leaf_lines: int):
    """Arrow function over rows sorted by leaf, length, documents (most first) and line: (line, template)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaf = None, None
        for b in batches:
            temps = []
            for key, line, tokens in zip(*(b.column(c).to_pylist() for c in ("leaf", "line", "tokens")), strict=True):
                if (key, len(tokens)) != now:
                    now, leaf = (key, len(tokens)), Leaf(len(tokens) // 8, similarity, depth, leaf_lines)
                temps.append(leaf.put(line, tokens))
            yield pa.RecordBatch.from_arrays([b.column("line"), pa.array(temps, pa.int64())], ["line", "template"])

    return run


def _found(kept, repeated):
    """Arrow function: (doc_id, text, hash of the text) to (line, doc_id, tag, no) of the lines in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)
            tags = tags_of(ids, b.column(2).to_numpy(), repeated)
            for lo, _, data, off in chunks(b.column(1)):
                x = Lines(data, off, 0)
                at = np.flatnonzero(bits_set(kept.value, x.hash))
                row = lo + x.doc[at]
                yield pa.RecordBatch.from_arrays([pa.array(as_long(x.hash[at])), pa.array(ids[row]), pa.array(tags[row]), pa.array(x.no[at].astype(np.int32))], ["line", "doc_id", "tag", "no"])

    return run


def _rebuild(text_at: int, names: list[str]):
    """Arrow function: the columns of a table, the hash of the text and the lines to drop, to the columns with the rest of the text, its lines with a token and the dropped ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, gone = [], [], []
            for text, own, drop in zip(b.column(text_at).to_pylist(), b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if text is None:
                    texts.append(None)
                    n.append(0)
                    gone.append(0)
                    continue
                lines = text.split("\n")
                n.append(sum(1 for x in lines if x.strip("\t\n\x0b\x0c\r ")))
                out = {x["no"] for x in drop or () if x["tag"] in (0, own)}
                gone.append(len(out))
                if out:
                    text = "\n".join(x for i, x in enumerate(lines) if i not in out)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names)

    return run


def recurring_lines(
    docs: DataFrame, min_docs: int | None = 10, long_words: int | None = None, depth: int = 3, similarity: float = 0.75, leaf_lines: int = 20_000, bits: int = 26, flush: int = 400_000
) -> DataFrame:
    """Return (doc_id, tag, no) of the lines to drop from ``docs`` (doc_id bigint, text); see ``drop_lines``.

    ``tag`` is xxhash64 of the row's text where several rows have the doc_id, else 0. ``min_docs`` None: no templates, long lines only.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("own"))
    repeated = repeated_ids(docs)
    counted = docs.mapInArrow(_survey(None if min_docs is None else depth, long_words, flush), "kind int, key bigint, docs bigint").groupBy("kind", "key").agg(F.sum("docs").alias("docs"))
    found = store(counted.filter(F.col("docs") >= F.when(F.col("kind") == 0, F.lit(min_docs)).otherwise(2)).select("kind", "key"))
    rules = found.filter("kind = 1").select(F.col("key").alias("line"), F.col("key").alias("template"), "kind")
    if min_docs is not None:
        leaves = found.filter("kind = 0").select(F.col("key").alias("leaf"))
        busy = spark.sparkContext.broadcast(bitmap(leaves, "leaf", bits))
        lines = docs.mapInArrow(_masked(depth, busy, 100 * flush), "leaf bigint, line bigint, docs bigint, tokens binary")
        lines = lines.groupBy("line").agg(F.min("leaf").alias("leaf"), F.sum("docs").alias("docs"), F.min("tokens").alias("tokens"))
        lines = store(lines.join(leaves, "leaf", "left_semi").select("leaf", "line", "docs", "tokens"))
        order = lines.repartition("leaf").sortWithinPartitions("leaf", F.length("tokens"), F.desc("docs"), "line")
        parsed = store(order.mapInArrow(_parse(similarity, depth, leaf_lines), "line bigint, template bigint"))
        total = parsed.join(lines.select("line", "docs"), "line").groupBy("template").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
        rules = rules.unionByName(parsed.join(total.select("template"), "template", "left_semi").select("line", "template", F.lit(0).alias("kind")))
    rules = store(rules)
    kept = spark.sparkContext.broadcast(bitmap(rules, "line", bits))
    at = store(salted(docs.mapInArrow(_found(kept, repeated), "line bigint, doc_id bigint, tag bigint, no int"), rules, ["line"]).select("kind", "template", "doc_id", "tag", "no"))
    # a document counts once for a template, whichever of its lines fit
    firsts = at.groupBy("kind", "template", "doc_id").agg(F.count("*")).groupBy("kind", "template").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"))
    firsts = firsts.filter(F.col("docs") >= F.when(F.col("kind") == 0, F.lit(min_docs)).otherwise(2)).drop("docs")
    out = salted(at, firsts, ["kind", "template"]).filter("doc_id > first")
    return out.select(F.when(F.col("doc_id") != F.lit(LAST), F.col("doc_id")).alias("doc_id"), "tag", "no")


def recurring_long_lines(docs: DataFrame, words: int = 8, **options) -> DataFrame:
    """Return (doc_id, tag, no) of the lines of at least ``words`` tokens without a digit that stand, fields masked, in a document with a lesser doc_id too."""
    return recurring_lines(docs, None, words, **options)


def drop_lines(docs: DataFrame, min_docs: int = 10, long_words: int | None = None, **options) -> DataFrame:
    """Return the columns of ``docs`` (doc_id bigint, text and any others) with kept_text, n_lines (with a token) and n_dropped, which take the place of columns of these names.

    A template that ``min_docs`` documents have stays in the document with the least doc_id and goes from all others. With ``long_words`` lines
    of so many words do so from two documents on; without it documents below that many copies stay whole for near-duplicate search. Null text stays null and has no lines; empty lines are never dropped.
    A null doc_id counts as the largest; rows that share a doc_id count as one document, and each loses lines of its own text. Without documents there are no rows.
    """
    names = ("kept_text", "n_lines", "n_dropped")
    return without_lines(docs.drop(*[c for c in docs.columns if c.lower() in names]), recurring_lines(docs, min_docs, long_words, **options), names)


def without_lines(docs: DataFrame, gone: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    """The columns of ``docs`` and three of these new names: the result of ``drop_lines`` for the lines (doc_id, tag, no) to drop."""
    own, drop = fresh("own", docs), fresh("drop", docs)
    gone = gone.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("no", "tag"))).alias(drop))
    # texts are dealt by doc_id at every size, whether the list of lines could be broadcast or not
    joined = same(docs.withColumn(own, F.xxhash64("text")), gone.hint("merge"), "doc_id")
    out = [*docs.columns, *names]
    kinds = [T.StringType(), T.LongType(), T.LongType()]
    return joined.mapInArrow(_rebuild(docs.columns.index("text"), out), T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))]))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), long_words=8)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))
