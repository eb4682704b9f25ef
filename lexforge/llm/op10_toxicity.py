"""Toxicity: a learned lexicon, matched through Levenshtein automata, with context windows.

The lexicon (whole terms, and stems that many endings follow) is learned from a bounded sample of labelled documents.
The trie of the lexicon is intersected with the Levenshtein automata of its terms, and the product is made deterministic: one
table over byte classes that accepts every term, every stem with any ending, and every misspelling within one edit of a
longer term. All words of a chunk run through the table in step; most die after two bytes.

Each hit looks at a window of words around it: quotation marks around it or words of report say that it is
quoted. The counts of plain, misspelled and quoted hits enter a logistic model fitted on the sample.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import store, table
from .kernels import ALNUM, U64, Words, as_long, chunks, group_starts
from .op6_minhash import shingles

#: Words of report: what stands near them is cited, not meant.
REPORT = frozenset("said says say wrote writes quote quoted quotes quoting word words term phrase called calling insult insults slur slurs".split())
_QUOTES = re.compile("[\"“”„«»‘’‚]".encode().decode())
_FEATURES = 6


class Automaton:
    """Deterministic table of the product of the lexicon's trie and Levenshtein automata of one edit.

    ``terms`` match whole words, ``stems`` beginnings of words; those of at least ``least`` (terms) and ``least_stem`` bytes also match within one edit (of
    bytes). ``outcome`` of a state: 0 no match, 1 misspelled, 2 exact. State 0 is dead, 1 is the start.
    """

    def __init__(self, terms: list[str], stems: list[str], least: int = 5, least_stem: int = 7) -> None:
        words = [(x.encode(), False) for x in terms] + [(x.encode(), True) for x in stems]
        used = sorted({b for w, _ in words for b in w})
        self.classes = np.zeros(256, np.uint8)
        for i, b in enumerate(used):
            self.classes[b] = i + 1
        children: list[dict[int, int]] = [{}]
        near = [False]  # a term that may be misspelled goes through this node
        ends: list[int] = [0]  # 1 term, 2 stem
        fuzzy: list[bool] = [False]
        for w, stem in words:
            may, node = len(w) >= (least_stem if stem else least), 0
            for b in w:
                c = int(self.classes[b])
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    near.append(False)
                    ends.append(0)
                    fuzzy.append(False)
                node = children[node][c]
                near[node] |= may
            ends[node] |= 2 if stem else 1
            fuzzy[node] |= may
        n_classes = len(used) + 1

        def closure(states: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
            out = set(states)
            for node, e in states:
                if e == 0:
                    out |= {(x, 1) for x in children[node].values() if near[x]}
            return frozenset(out)

        # 0 edits of a stem: accepted for good, exact; 1 edit: accepted for good unless an exact match follows
        start = closure({(0, 0)})
        index: dict[object, int] = {frozenset(): 0, start: 1, "exact": 2, "near": 3}
        todo, rows = [start], {0: [0] * n_classes, 2: [2] * n_classes, 3: [3] * n_classes}
        outcome = {0: 0, 2: 2, 3: 1}
        while todo:
            s = todo.pop()
            i = index[s]
            outcome[i] = 2 if any(e == 0 and ends[n] for n, e in s) else int(any(e == 1 and ends[n] and fuzzy[n] for n, e in s))
            row = []
            for c in range(n_classes):
                to = set()
                for node, e in s:
                    if c in children[node]:
                        to.add((children[node][c], e))
                    if e == 0:
                        to |= {(x, 1) for k, x in children[node].items() if k != c and near[x]}
                        if near[node] or node == 0:
                            to.add((node, 1))
                t: object = closure(to)
                if any(e == 0 and ends[n] & 2 for n, e in t):
                    t = "exact"
                elif any(e == 1 and ends[n] & 2 and fuzzy[n] for n, e in t) and not any(e == 0 for _, e in t):
                    t = "near"
                if t not in index:
                    index[t] = len(index)
                    todo.append(t)
                row.append(index[t])
            rows[i] = row
        self.table = np.array([rows[i] for i in range(len(index))], np.int32)
        self.outcome = np.array([outcome[i] for i in range(len(index))], np.int8)

    def run(self, w: Words) -> np.ndarray:
        """Outcome of each word."""
        state = np.ones(len(w), np.int32)
        live, j = np.arange(len(w)), 0
        while len(live):
            s = self.table[state[live], self.classes[w.data[w.start[live] + j]]]
            state[live] = s
            j += 1
            live = live[(s > 3) & (w.len[live] > j)]
        return self.outcome[state]


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, toxic) with the least and the greatest hash of the text's five-word shingles; 0 where it has no words."""
    for b in batches:
        for lo, hi, data, off in chunks(b.column(1)):
            doc, h = shingles(data, off, 5)
            first = group_starts(doc) if len(doc) else np.zeros(0, np.int64)
            ends = np.zeros((2, hi - lo), U64)
            ends[0, doc[first]] = h[first]
            ends[1, doc[first]] = h[np.r_[first[1:], len(doc)] - 1] if len(first) else h[:0]
            yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in range(3)), *(pa.array(as_long(x)) for x in ends)], ["doc_id", "text", "toxic", "low", "high"])


def _grams(most: int):
    """Arrow function: (text, toxic) to (gram, toxic documents, clean documents); grams are words of two letters or more, beginnings of 4 to ``most`` letters (with *), and beginnings of two or more words of the document (with **)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                words = Counter(re.findall(r"[^\W\d_]{2,}", (text.as_py() or "").lower()))
                heads: Counter = Counter()
                for x, k in words.items():
                    for n in range(4, min(len(x), most) + 1):
                        heads[x[:n]] += k
                counts[toxic].update(words.keys())
                counts[toxic].update(f"{x}*" for x in heads)
                counts[toxic].update(f"{x}**" for x, k in heads.items() if k > 1)
        # what only clean documents have can't enter the lexicon
        grams = list(counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array([counts[1][g] for g in grams], pa.int64()), pa.array([0] * len(grams), pa.int64())], ["gram", "toxic", "clean"])
        grams = list(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array([0] * len(grams), pa.int64()), pa.array([counts[0][g] for g in grams], pa.int64())], ["gram", "toxic", "clean"])

    return run


def surprise(t: int, c: int, n_toxic: int, n_clean: int) -> float:
    """Log-likelihood ratio statistic of t of n_toxic against c of n_clean."""

    def ll(k: float, n: float) -> float:
        return sum(x * math.log(x / n) for x in (k, n - k) if x > 0)

    return 2 * (ll(t, n_toxic) + ll(c, n_clean) - ll(t + c, n_toxic + n_clean))


def choose_lexicon(rows: list[tuple[str, int, int]], n_toxic: int, n_clean: int, odds: float = 20.0, least: float = 25.0, most: int = 1000) -> tuple[list[str], list[str], list[str]]:
    """(terms, stems, weak stems) from (gram, toxic, clean) counts: grams ``odds`` times as common in toxic documents, with a ``surprise`` of ``least``.

    A beginning becomes a stem, at its longest that keeps 95 % of the documents, unless one word makes up most of it. Weak stems mean something
    only where they repeat within a document. ``most`` bounds the table of the automata; of more terms, or stems, those of most documents stay.
    """
    pure = {g: t for g, t, c in rows if (t + 0.5) / (n_toxic + 1) >= odds * (c + 0.5) / (n_clean + 1) and surprise(t, c, n_toxic, n_clean) >= least}
    words = {g: t for g, t in pure.items() if not g.endswith("*")}

    def shortest(heads: dict[str, int], known: dict[str, int]) -> dict[str, int]:
        stems: dict[str, int] = {}
        for h in sorted(heads, key=lambda x: (len(x), x)):
            if any(h.startswith(s) for s in [*stems, *known]):
                continue
            if max((t for w, t in words.items() if w.startswith(h)), default=0) >= 0.8 * heads[h]:
                continue
            while longer := [x for x, t in heads.items() if len(x) == len(h) + 1 and x.startswith(h) and t >= 0.95 * heads[h]]:
                h = min(longer)
            stems[h] = heads[h]
        return stems

    stems = shortest({g[:-1]: t for g, t in pure.items() if g.endswith("*") and not g.endswith("**")}, {})
    weak = shortest({g[:-2]: t for g, t in pure.items() if g.endswith("**")}, stems)
    terms = {w: t for w, t in words.items() if not any(w.startswith(s) for s in stems)}
    rank = lambda d: sorted(d, key=lambda x: (-d[x], x))[:most]
    return rank(terms), rank(stems), rank(weak)


def _quoted(w: Words, i: int, ends: tuple[int, int], width: int) -> bool:
    """Whether hit i is cited: within quotation marks, or words of report in its window."""
    lo, hi = max(ends[0], i - width), min(ends[1] - 1, i + width)
    before = w.data[max(0, w.start[lo] - 4) : w.start[i]].tobytes().decode(errors="ignore")
    behind = w.data[w.end[i] : w.end[hi] + 4].tobytes().decode(errors="ignore")
    marks = len(_QUOTES.findall(before)), len(_QUOTES.findall(behind))
    if marks[0] % 2 == 1 and marks[1] >= 1:
        return True
    return any(x in REPORT for x in re.findall(r"\w+", before)[-3:])


def _hits(machines: tuple[Automaton, Automaton], w: Words, width: int) -> np.ndarray:
    """Per document: plain, misspelled, quoted and weak hits."""
    out = np.zeros((len(w.first) - 1, 4))
    outcome = machines[0].run(w)
    for i in np.flatnonzero(outcome):
        d = int(w.doc[i])
        out[d, 2 if _quoted(w, int(i), (int(w.first[d]), int(w.first[d + 1])), width) else 0 if outcome[i] == 2 else 1] += 1
    out[:, 3] = np.bincount(w.doc[machines[1].run(w) > 0], minlength=len(out))
    return out


def features(hits: np.ndarray) -> np.ndarray:
    """Rows of the logistic model: 1, any plain hit, more plain hits, misspelled hits, quoted hits, repeated weak hits."""
    plain, wrong, quoted, weak = np.minimum(hits, 8).T
    return np.column_stack([np.ones(len(hits)), plain > 0, np.log1p(np.maximum(plain - 1, 0)), np.log1p(wrong), np.log1p(quoted), np.maximum(weak - 1, 0)])


#: Ridge of each weight and where it pulls to: one plain hit may mean all, and misspelled hits count until the sample says otherwise.
_RIDGE = np.array([1e-3, 0.02, 0.3, 0.3, 0.3, 0.3])
_PULL = np.array([0.0, 0.0, 0.0, 4.0, 0.0, 0.0])
#: The most that the intercept may be: a text without any hit is clean (0.27), however many labels are toxic.
_SILENT = -1.0


def _newton(x: np.ndarray, y: np.ndarray, ridge: np.ndarray, pull: np.ndarray, steps: int) -> np.ndarray:
    beta = pull.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * (beta - pull))
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: np.ndarray = _RIDGE, pull: np.ndarray = _PULL, steps: int = 80) -> np.ndarray:
    """Weights by Newton's method under a quadratic penalty; where the intercept would pass ``_SILENT`` it is held there and the others are fitted again."""
    beta = _newton(x, y, ridge, pull, steps)
    if beta[0] > _SILENT:
        held, to = ridge.copy(), pull.copy()
        held[0], to[0] = 1e9, _SILENT
        beta = _newton(x, y, held, to, steps)
        beta[0] = _SILENT
    return beta


def _seen(machines, width: int):
    """Arrow function: (text, toxic) to its hits, of each kind 8 at most (more tell the features nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in chunks(b.column(0)):
                h = np.minimum(_hits(machines.value, Words(data, off, ALNUM, lower=True, hashes=False), width), 8)
                yield pa.RecordBatch.from_arrays([*(pa.array(h[:, i]) for i in range(4)), b.column(1).slice(lo, hi - lo)], ["plain", "wrong", "quoted", "weak", "toxic"])

    return run


def _scores(machines, beta: np.ndarray, width: int, text: int, names: list[str]):
    """Arrow function: the rows as they come, with the score of column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in chunks(b.column(text)):
                x = features(_hits(machines.value, Words(data, off, ALNUM, lower=True, hashes=False), width))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns), pa.array(1 / (1 + np.exp(-np.clip(x @ beta, -30, 30))))], names)

    return run


def held_out(doc_id):
    """Whether crc32(doc_id as text) mod 5 is 0; a null doc_id is never in the sample, and counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


class Toxicity:
    """What the labelled sample taught: the automata and the weights; ``learned`` is false where a kind of label was missing."""

    def __init__(self, spark: SparkSession, lexicon: tuple[list[str], list[str], list[str]] = ((), (), ()), learned: bool = False, width: int = 6) -> None:
        terms, stems, weak = lexicon
        self.machines = spark.sparkContext.broadcast((Automaton(list(terms), list(stems)), Automaton([], list(weak), least_stem=1000)))
        self.beta, self.learned, self.width = np.zeros(_FEATURES), learned, width

    def scored(self, docs: DataFrame, score: str) -> DataFrame:
        """All columns of ``docs`` and the column ``score``, which must be a new name."""
        if not self.learned:
            return docs.withColumn(score, F.lit(0.0))
        names = [*docs.columns, score]
        return docs.mapInArrow(_scores(self.machines, self.beta, self.width, docs.columns.index("text"), names), T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def learn(docs: DataFrame, labels: DataFrame, sample: int = 12_000, width: int = 6, seed: int = 10, parts: int = 32) -> Toxicity:
    """Fit the lexicon and the weights on the labelled sample; see ``toxicity``."""
    spark = docs.sparkSession
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = usable.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample).collect()
    if not known:
        return Toxicity(spark)
    wanted = F.broadcast(spark.createDataFrame([tuple(r) for r in known], "doc_id bigint, toxic int"))
    drawn = docs.select("doc_id", "text").join(wanted, "doc_id").select("doc_id", "text", "toxic").mapInArrow(_sketched, "doc_id bigint, text string, toxic int, low bigint, high bigint")
    one = drawn.groupBy("toxic", "low", "high").agg(F.min(F.struct("doc_id", "text")).alias("x"))
    teach = store(one.select("x.text", "toxic").repartition(parts, "text"))
    n = dict(teach.groupBy("toxic").count().collect())
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        return Toxicity(spark)
    grams = teach.mapInArrow(_grams(8), "gram string, toxic bigint, clean bigint").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # what the odds would refuse anyway stays on the executors
    rows = grams.filter(f"toxic > 2 and (toxic + 0.5) * {n_clean + 1} >= 20.0 * (clean + 0.5) * {n_toxic + 1}").collect()
    out = Toxicity(spark, choose_lexicon([tuple(r) for r in rows], n_toxic, n_clean), True, width)
    kinds = ["plain", "wrong", "quoted", "weak", "toxic"]
    seen = teach.mapInArrow(_seen(out.machines, width), "plain double, wrong double, quoted double, weak double, toxic int").groupBy(*kinds).count().orderBy(*kinds).collect()
    x = np.repeat(np.array([[*r[:5]] for r in seen], float), [r[5] for r in seen], axis=0)
    out.beta = fit_logistic(features(x[:, :4]), x[:, 4])
    return out


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 12_000, width: int = 6, seed: int = 10) -> DataFrame:
    """Return (doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id bigint, text), learning from ``labels`` (doc_id, toxic).

    ``sample`` bounds the labelled ids that are learned from: those with the least hashes among those that aren't held out. Of sampled texts of one label
    whose five-word shingles have the same least and the same greatest hash (near copies, as a rule) one teaches, so that copies don't make their own words look toxic.
    Null and empty texts have no hits and score like a text without any, which is below 0.5 whatever the labels are. Null labels and ids teach nothing; a doc_id
    with both labels is toxic. Without labels of both kinds nothing is learned and every score is 0. Rows are scored one by one, also with
    null or repeated doc_id; other columns are ignored.
    """
    own = docs.select("doc_id", "text")
    scored = learn(own, labels, sample, width, seed).scored(own, "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
