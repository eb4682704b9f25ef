"""Detectors: places in a text that a pattern or a table finds; strategies over tokens and their neighbours; suppression."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as A

from ..functions import text as T
from ..functions.bits import may_be_in, members, small
from ..functions.syllable_rules import MEDIALS, VOWELS, violations
from ..session import kept
from .suggest import ratio_of

#: Patterns on raw text, before normal forms hide what they find: type, pattern, what stands there instead.
RAW = (
    ("zero_width", f"[{T.ZERO_WIDTH}]+", ""),
    ("broken_virama", f"{T.VIRAMA}(?=[{VOWELS}])", T.ASAT),
    ("medial_order", "[ြ]ျ|[ွ][ျြ]|ှ[ျြွ]", None),
    ("leading_e", "(?<![က-၏])ေ(?=[က-အ])", None),
    ("vowel_before_medial", f"[{VOWELS}][{MEDIALS}]", None),
    ("vowel_order", "[ုူ][ိီဲ]|[ာါ]ေ", None),
    ("incomplete_stacking", f"{T.VIRAMA}(?![က-အ])", ""),
    ("duplicate_mark", f"([{MEDIALS}{VOWELS}{T.ASAT}့း])\\1+", None),
    ("vowel_after_dot", f"့[{VOWELS}]", None),
)
#: Patterns on normal text.
NORMAL = (
    ("broken_stacking", f"[က-အ]{T.VIRAMA}[{VOWELS}]", None),
    ("vowel_after_asat", f"{T.ASAT}[{VOWELS}]", None),
    ("missing_end", r"(?<=[က-၏])(?<!။)\Z", T.SENTENCE_END),
    ("punctuation", "[၊။]{2,}|[ \t\n\r]+[၊။]", None),
    ("latin_stop", "(?<=[က-၏])[.,]", T.SENTENCE_END),
)


_SPANS = A.ArrayType(A.StructType([A.StructField("start", A.IntegerType()), A.StructField("end", A.IntegerType()), A.StructField("text", A.StringType())]))
#: Matches that are Python objects at once; bytes of texts whose tokens are found at once (a longer text is one piece), and tokens that go back at once.
_AT_ONCE, _PIECE, _ROWS = 1 << 16, 1 << 21, 1 << 15
_BLANK = np.isin(np.arange(256), [9, 10, 13, 32])


def scan(text: Column, pattern: str) -> Column:
    """Array of (start, end, text) of the matches, in code points from 0; null for null.

    An Arrow function: built-in functions give matches without their places, and a fold over an array copies it at each step. Matches are packed into
    Arrow arrays as they are found: as one dict each, those of a batch of texts took far more memory than the texts.
    """
    compiled = re.compile(pattern)

    @F.arrow_udf(_SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        upto, starts, ends, words, packed = array("i", [0]), array("i"), array("i"), [], []
        for x in texts:
            if (x := x.as_py()) is not None:
                for m in compiled.finditer(x):
                    starts.append(m.start())
                    ends.append(m.end())
                    words.append(m.group())
                    if len(words) == _AT_ONCE:
                        packed.append(pa.array(words, pa.string()))
                        words = []
            upto.append(len(starts))
        packed.append(pa.array(words, pa.string()))
        values = pa.StructArray.from_arrays([pa.array(np.frombuffer(starts, np.int32)), pa.array(np.frombuffer(ends, np.int32)), pa.concat_arrays(packed)], ["start", "end", "text"])
        return pa.ListArray.from_arrays(pa.array(np.frombuffer(upto, np.int32)), values, mask=texts.is_null())

    return spans(text)


def by_patterns(docs: DataFrame, doc: str, text: str, patterns=RAW, confidence: float = 0.9) -> DataFrame:
    """(doc, error_type, start, end, text, fix, confidence) of all matches of all patterns."""

    def one(kind: str, pattern: str, fix: str | None) -> Column:
        return F.transform(scan(F.col(text), pattern), lambda x: F.struct(F.lit(kind).alias("error_type"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), F.lit(fix).cast("string").alias("fix")))

    found = F.flatten(F.array(*[one(*p) for p in patterns]))
    return docs.filter(F.col(text).isNotNull()).select(doc, F.inline(found)).withColumn("confidence", F.lit(confidence))


def _found(around: bool):
    """Arrow function: (doc, text) to (doc, idx, start, end, token), with ``around`` also (prev2, prev, next, next2, next_end), a row for each token."""

    def rows(docs: pa.Array, data: np.ndarray, off: np.ndarray) -> Iterator[pa.RecordBatch]:
        solid = ~_BLANK[data]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        edges = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]  # a text that begins where another ends begins a token
        first[edges], last[edges - 1] = solid[edges], solid[edges - 1]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(begin):
            return
        doc = np.searchsorted(off, begin, "right") - 1
        tail = np.flatnonzero((data & 0xC0) == 0x80)  # bytes that are no character of their own
        chars = lambda at: at - np.searchsorted(tail, at)
        base = chars(off[:-1])[doc]
        idx = np.arange(len(begin)) - np.searchsorted(doc, doc)
        token = pa.StringArray.from_buffers(len(begin), pa.py_buffer(np.r_[0, np.cumsum(end - begin)].astype(np.int32)), pa.py_buffer(data[solid]))
        cols = {"idx": idx.astype(np.int32), "start": (chars(begin) - base).astype(np.int32), "end": (chars(end) - base).astype(np.int32)}
        for lo in range(0, len(begin), _ROWS):
            at = np.arange(lo, min(lo + _ROWS, len(begin)))

            def near(step: int, of: pa.Array, at: np.ndarray = at) -> pa.Array:
                other = np.clip(at + step, 0, len(begin) - 1)
                return of.take(pa.array(other, mask=(other != at + step) | (doc[other] != doc[at])))

            out = [docs.take(pa.array(doc[at])), *(pa.array(c[at]) for c in cols.values()), token.slice(lo, len(at))]
            if around:
                out += [*(near(k, token) for k in (-2, -1, 1, 2)), near(1, pa.array(cols["end"]))]
            yield pa.RecordBatch.from_arrays(out, _TOKEN + _AROUND * around)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.string())
            if not len(texts):
                continue
            off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + _PIECE, "right")) - 1)
                yield from rows(batch.column(0).slice(lo, hi - lo), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                lo = hi

    return run


_TOKEN, _AROUND = ["doc", "idx", "start", "end", "token"], ["prev2", "prev", "next", "next2", "next_end"]


def _rows_of(docs: DataFrame, doc: str, text: str, around: bool) -> DataFrame:
    kinds = {"doc": docs.schema[doc].dataType, "token": A.StringType()} | dict.fromkeys(_AROUND[:-1], A.StringType())
    names = _TOKEN + _AROUND * around
    rows = docs.select(doc, F.coalesce(F.col(text), F.lit(""))).mapInArrow(_found(around), A.StructType([A.StructField(n, kinds.get(n, A.IntegerType())) for n in names]))
    return rows.withColumnRenamed("doc", doc)


def tokens(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, idx, start, end, token) of what stands between white space; places from 0 in code points."""
    return _rows_of(docs, doc, text, False)


def near_tokens(docs: DataFrame, doc: str, text: str, lower: bool = False) -> DataFrame:
    """``tokens`` with the columns of ``with_neighbours``; neighbours come from the row's own text, so nothing is shuffled. ``lower``: tokens in small letters, at the places they had."""
    rows = _rows_of(docs, doc, text, True)
    return rows.withColumns({c: F.lower(c) for c in ("token", *_AROUND[:-1])}) if lower else rows


def with_neighbours(toks: DataFrame, doc: str) -> DataFrame:
    """Neighbours of tokens that are rows already; where the texts are there, ``near_tokens`` needs no shuffle."""
    w = Window.partitionBy(doc).orderBy("idx")
    return toks.withColumns({"prev2": F.lag("token", 2).over(w), "prev": F.lag("token").over(w), "next": F.lead("token").over(w), "next2": F.lead("token", 2).over(w), "next_end": F.lead("end").over(w)})


def _error(doc: str, kind: str, fix: Column, confidence: Column, priority: int, end: str = "end", text: Column | None = None) -> list[Column]:
    return [F.col(doc), F.lit(kind).alias("error_type"), F.col("start"), F.col(end).alias("end"), (F.col("token") if text is None else text).alias("text"), fix.alias("fix"), confidence.alias("confidence"), F.lit(priority).alias("priority")]


def unknown_syllables(toks: DataFrame, doc: str, known: DataFrame, priority: int = 5) -> DataFrame:
    """Syllables that break a rule or that the dictionary (syllable) doesn't have; judged once for each distinct one."""
    parts = toks.select(doc, "start", "end", F.explode(T.syllables(F.col("token"))).alias("token"))
    judged = parts.select("token").distinct().withColumn("broken", F.size(violations(F.col("token"))) > 0)
    judged = judged.join(known.select(F.col("syllable").alias("token")).distinct().withColumn("known", F.lit(True)), "token", "left").filter("broken or known is null")
    return parts.join(judged, "token").select(*_error(doc, "invalid_syllable", F.lit(None).cast("string"), F.when(F.col("broken"), 0.95).otherwise(0.7), priority))


def unknown_words(toks: DataFrame, doc: str, words: DataFrame, suggestions: DataFrame, min_frequency: int = 1, priority: int = 8, unknown: DataFrame | None = None) -> DataFrame:
    """Tokens that aren't frequent enough words, with the best suggestion (query, term) there is. ``unknown`` (token): the distinct ones of such tokens, where they are counted already."""
    if unknown is None:
        known = words.filter(F.col("frequency") >= min_frequency).select(F.col("word").alias("token"))
        unknown = toks.select("token").distinct().join(known, "token", "left_anti")
    # most tokens are known words: a bitmap of the others spares them, so neither join shuffles all tokens
    fixes = kept(unknown.join(suggestions.select(F.col("query").alias("token"), "term"), "token", "left"))
    x = toks.filter(may_be_in(fixes, ["token"], "token")).join(fixes, "token")
    return x.select(*_error(doc, "invalid_word", F.col("term"), F.when(F.col("term").isNull(), 0.6).otherwise(0.8), priority))


def by_table(near: DataFrame, doc: str, rules: DataFrame, kind: str, priority: int) -> DataFrame:
    """Rules (token, left, right, fix, confidence): a token that stands between these neighbours; a null neighbour fits all. Particles, suffixes, homophones, collocations, tense, registers and classifiers are tables of this form."""
    r = rules.select(F.col("token").alias("r_token"), F.col("left").alias("r_left"), F.col("right").alias("r_right"), "fix", F.col("confidence").alias("r_conf"))
    # else Spark, which can't tell the size of a table from the driver, shuffles all tokens
    near, r = (near, F.broadcast(r)) if small(r) else (near.filter(may_be_in(r, ["r_token"], "token")), r)
    x = near.join(r, (F.col("token") == F.col("r_token")) & (F.col("r_left").isNull() | F.col("r_left").eqNullSafe(F.col("prev"))) & (F.col("r_right").isNull() | F.col("r_right").eqNullSafe(F.col("next"))))
    return x.select(*_error(doc, kind, F.col("fix"), F.col("r_conf"), priority))


def broken_compounds(near: DataFrame, doc: str, compounds: DataFrame, priority: int = 25) -> DataFrame:
    """Neighbours that together are a known compound (part1, part2, compound, pmi)."""
    c = compounds.select(F.col("part1").alias("token"), F.col("part2").alias("next"), "compound", "pmi")
    x = near.filter(may_be_in(c, ["token", "next"], "token", "next")).join(c, ["token", "next"])
    return x.select(*_error(doc, "broken_compound", F.col("compound"), F.least(0.5 + F.col("pmi") / 20, F.lit(0.95)), priority, "next_end", F.concat_ws(" ", "token", "next")))


def hidden_compounds(near: DataFrame, doc: str, words: DataFrame, min_ratio: float = 50.0, priority: int = 23) -> DataFrame:
    """Neighbours whose concatenation is far more frequent a word than the rarer of the two."""
    f = words.select("word", "frequency")
    common = f.filter(F.col("frequency") >= min_ratio).toDF("joined", "fj")
    x = near.withColumn("joined", F.concat("token", "next")).filter(may_be_in(common, ["joined"], "joined")).join(common, "joined")
    x = x.join(f.toDF("token", "f1"), "token", "left").join(f.toDF("next", "f2"), "next", "left").na.fill(0, ["f1", "f2"])
    return x.filter(F.col("fj") >= min_ratio * (F.least("f1", "f2") + 1)).select(*_error(doc, "hidden_compound", F.col("joined"), F.lit(0.7), priority, "next_end", F.concat_ws(" ", "token", "next")))


def homophones(near: DataFrame, doc: str, sets: DataFrame, bigrams: DataFrame, min_ratio: float = 5.0, priority: int = 45) -> DataFrame:
    """Alternatives (token, other) that fit both neighbours better, by the product of the bigram probabilities; the best one of each token."""
    p = bigrams.select("w1", "w2", "probability")
    x = near.join(sets, "token")
    for name, a, b in (("pl", "prev", "token"), ("pr", "token", "next"), ("ql", "prev", "other"), ("qr", "other", "next")):
        x = x.join(p.select(F.col("w1").alias(a), F.col("w2").alias(b), F.col("probability").alias(name)), [a, b], "left")
    score = lambda l, r: F.coalesce(l, F.lit(1e-6)) * F.coalesce(r, F.lit(1e-6))
    x = x.withColumn("ratio", ratio_of(score(F.col("ql"), F.col("qr")), score(F.col("pl"), F.col("pr")))).filter(F.col("ratio") >= min_ratio)
    best = F.row_number().over(Window.partitionBy(doc, "idx").orderBy(F.desc("ratio"), "other"))
    x = x.withColumn("n", best).filter("n = 1")
    return x.select(*_error(doc, "homophone", F.col("other"), 0.5 + 0.45 * F.least(F.log10("ratio") / 6, F.lit(1.0)), priority))


def unlikely(near: DataFrame, doc: str, bigrams: DataFrame, threshold: float = 0.001, priority: int = 50) -> DataFrame:
    """Tokens whose bigrams are below the threshold, on each side on which there is a neighbour; a token alone is none."""
    p = bigrams.select("w1", "w2", "probability")
    x = near.join(p.toDF("prev", "token", "pl"), ["prev", "token"], "left").join(p.toDF("token", "next", "pr"), ["token", "next"], "left")
    low = lambda side, p: F.col(side).isNull() | (F.coalesce(p, F.lit(0.0)) < threshold)
    x = x.filter((F.col("prev").isNotNull() | F.col("next").isNotNull()) & low("prev", "pl") & low("next", "pr"))
    return x.select(*_error(doc, "context_probability", F.lit(None).cast("string"), F.lit(0.4), priority))


def invalid_tags(tagged: DataFrame, doc: str, pairs: DataFrame, priority: int = 30) -> DataFrame:
    """Tokens whose tag may not follow the one before; pairs (tag1, tag2, severity)."""
    before = F.lag("tag").over(Window.partitionBy(doc).orderBy("idx"))
    x = tagged.withColumn("tag1", before).withColumn("tag2", F.col("tag")).join(pairs, ["tag1", "tag2"])
    return x.select(*_error(doc, "pos_sequence", F.lit(None).cast("string"), F.col("severity"), priority))


def question_ends(toks: DataFrame, doc: str, words: tuple[str, ...], particles: tuple[str, ...], priority: int = 40) -> DataFrame:
    """Sentences with a question word whose last token has none of the ends."""
    near = toks if "next" in toks.columns else with_neighbours(toks, doc)
    # the rows that are shuffled are one of a document, not its tokens
    asks = near.filter(F.col("token").isin(*words)).select(F.col(doc).alias("_asks")).distinct()
    x = near.filter("next is null").join(asks, F.col(doc).eqNullSafe(F.col("_asks")), "left_semi")
    ends = F.lit(False)
    for p in particles:
        ends = ends | F.col("token").endswith(p)
    return x.filter(~ends).select(*_error(doc, "question_structure", F.concat("token", F.lit(particles[0])), F.lit(0.6), priority))


def tone_probes(toks: DataFrame, doc: str, words: DataFrame, min_ratio: float = 100.0, priority: int = 22) -> DataFrame:
    """Tokens that with another final tone are far more frequent words; the most frequent one."""
    f = words.select("word", "frequency")
    bare = F.when(F.substring("token", -1, 1).isin("့", "း"), F.expr("substring(token, 1, length(token) - 1)")).otherwise(F.col("token"))
    forms = [bare, F.concat(bare, F.lit("့")), F.concat(bare, F.lit("း"))]
    common = f.filter(F.col("frequency") >= min_ratio).toDF("variant", "fv")
    known = members(common, ["variant"])
    hit = F.lit(False)
    for v in forms:
        hit = hit | ((v != F.col("token")) & known(v))
    # each distinct token that may have a common form is judged once, and only tokens that may have a fix are joined
    x = toks.select("token").filter(hit).distinct().withColumn("variant", F.explode(F.array(*forms))).filter("variant <> token and variant <> ''")
    x = x.join(common, "variant").join(f.toDF("token", "ft"), "token", "left").na.fill(0, ["ft"]).filter(F.col("fv") >= min_ratio * (F.col("ft") + 1))
    best = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("fv"), "variant"))
    fixes = x.withColumn("n", best).filter("n = 1").select("token", "variant")
    return toks.filter(may_be_in(fixes, ["token"], "token")).join(fixes, "token").select(*_error(doc, "tone", F.col("variant"), F.lit(0.75), priority))


# Suppression


def drop_entities(errors: DataFrame, entities: DataFrame) -> DataFrame:
    e = entities.select(F.col("entity").alias("text")).distinct()
    return errors.join(F.broadcast(e) if small(e) else e, "text", "left_anti")


def drop_inside(errors: DataFrame, doc: str, spans: DataFrame) -> DataFrame:
    """Errors inside a span (doc, s_start, s_end) that something better explains, such as a valid word, go."""
    inside = (F.col("start") >= F.col("s_start")) & (F.col("end") <= F.col("s_end"))
    return errors.alias("e").join(spans.alias("s"), (F.col(f"e.{doc}") == F.col(f"s.{doc}")) & inside, "left_anti")


def drop_cascades(errors: DataFrame, doc: str, kind: str = "invalid_syllable", gap: int = 1) -> DataFrame:
    """Of errors of one kind that follow one another within ``gap`` characters the first stays."""
    before = F.lag("end").over(Window.partitionBy(doc, "error_type").orderBy("start"))
    x = errors.withColumn("before", before)
    return x.filter((F.col("error_type") != kind) | F.col("before").isNull() | (F.col("start") - F.col("before") > gap)).drop("before")


def drop_weak(errors: DataFrame, words: DataFrame, kind: str, min_frequency: int) -> DataFrame:
    """Errors of the kind without a suggestion on frequent words go."""
    f = words.filter(F.col("frequency") >= min_frequency).select(F.col("word").alias("text")).withColumn("frequent", F.lit(True))
    x = errors.join(f, "text", "left")
    return x.filter(~((F.col("error_type") == kind) & F.col("fix").isNull() & F.coalesce("frequent", F.lit(False)))).drop("frequent")


def drop_splittable(errors: DataFrame, words: DataFrame, kind: str = "invalid_word") -> DataFrame:
    """Unknown words that split into two known ones go."""
    known = words.select("word")
    odd = errors.filter(F.col("error_type") == kind).select("text").distinct().filter("length(text) > 3")
    parts = odd.select("text", F.explode(F.sequence(F.lit(2), F.length("text") - 2)).alias("i")).select("text", F.expr("substring(text, 1, i)").alias("a"), F.expr("substring(text, i + 1)").alias("b"))
    good = parts.join(known.toDF("a"), "a", "left_semi").join(known.toDF("b"), "b", "left_semi").select("text").distinct().withColumn("splits", F.lit(True))
    return errors.join(good, "text", "left").filter(~((F.col("error_type") == kind) & F.coalesce("splits", F.lit(False)))).drop("splits")
