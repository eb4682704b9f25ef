"""Words from unspaced text by a language model of the dictionary; splits of compounds; entities.

``model`` is the ``limit`` most frequent words (and bigrams among them), which bounds what is broadcast; ``split_by_table`` takes a table of any size.
Splits are made for distinct strings.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as A

from ..functions import text as T

LATIN = "<ENG>"


def model(words: DataFrame, bigrams: DataFrame | None = None, limit: int = 200_000):
    """Broadcast (log probability of words, of bigrams, longest word)."""
    rows = words.select("word", "frequency").orderBy(F.desc("frequency"), "word").limit(limit).collect()
    total = sum(r[1] for r in rows) or 1
    uni = {r[0]: math.log(r[1] / total) for r in rows}
    bi: dict[tuple[str, str], float] = {}
    if bigrams is not None:
        top = bigrams.orderBy(F.desc("cnt"), "w1", "w2").limit(limit).select("w1", "w2", "probability").collect()
        bi = {(a, b): math.log(max(p, 1e-10)) for a, b, p in top if a in uni and b in uni}
    return words.sparkSession.sparkContext.broadcast((uni, bi, max(map(len, uni), default=1)))


def best_path(s: str, lm, longest: int = 20, unknown: float = -12.0) -> list[str]:
    """Likeliest split of s; a character outside of the model is a word of its own. Of equal paths the one with fewer words, then the first by text."""
    uni, bi, most = lm
    most = min(most, longest)
    # best[i]: by last word, (score, words, path) of the first i characters
    best: list[dict[str, tuple[float, int, list[str]]]] = [{"": (0.0, 0, [])}] + [{} for _ in s]
    for i in range(1, len(s) + 1):
        for j in range(max(0, i - most), i):
            w = s[j:i]
            if w not in uni and i - j > 1:
                continue
            for last, (score, n, path) in best[j].items():
                step = bi.get((last, w), uni.get(w, unknown))
                old = best[i].get(w)
                new = (score + step, n + 1, [*path, w])
                if old is None or (-new[0], new[1], new[2]) < (-old[0], old[1], old[2]):
                    best[i][w] = new
        if len(best[i]) > 25:
            best[i] = dict(sorted(best[i].items(), key=lambda x: (-x[1][0], x[1][1], x[0]))[:25])
    return min(best[-1].values(), key=lambda x: (-x[0], x[1], x[2]))[2] if s else []


def split_words(column: Column, shared) -> Column:
    """Words of a text: white space splits first, then the model."""

    @F.pandas_udf(A.ArrayType(A.StringType()))
    def split(s: pd.Series) -> pd.Series:
        lm = shared.value
        return s.map(lambda x: None if x is None else [w for part in x.split() for w in best_path(part, lm)])

    return split(column)


def split_by_table(strings: DataFrame, words: DataFrame, longest: int = 20) -> DataFrame:
    """(string, parts) of the distinct strings, split by a table of words (word, frequency) of any size.

    The table is joined by the strings' own substrings of up to ``longest`` characters, so each string meets the words that it can have and no other.
    """
    known = words.filter((F.length("word") <= longest) & (F.col("frequency") > 0)).select("word", "frequency")
    total = known.agg(F.coalesce(F.sum("frequency"), F.lit(1)).alias("total"))
    asked = strings.select("string").filter("string is not null").distinct()
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.length("string")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("string") - i + 1)), lambda n: F.substring(F.col("string"), i, n))))
    found = asked.filter("string <> ''").select("string", F.explode(F.array_distinct(pieces)).alias("word")).join(known, "word").crossJoin(F.broadcast(total))
    models = found.groupBy("string").agg(F.map_from_entries(F.collect_list(F.struct("word", F.log(F.col("frequency") / F.col("total"))))).alias("uni"))

    @F.pandas_udf(A.ArrayType(A.StringType()))
    def split(s: pd.Series, uni: pd.Series) -> pd.Series:
        return pd.Series([best_path(x, (dict(m or {}), {}, max(map(len, dict(m or {})), default=1))) for x, m in zip(s, uni, strict=True)])

    return asked.join(models, "string", "left").select("string", split("string", "uni").alias("parts"))


def parts_of(s: str, known: dict[str, float], least: int = 2, most: int = 4) -> list[str] | None:
    """Fewest known words (of ``least`` characters, at most ``most`` of them) that together are s; the likeliest of equal numbers."""
    best: list[tuple[int, float, list[str]] | None] = [(0, 0.0, [])] + [None] * len(s)
    for i in range(1, len(s) + 1):
        for j in range(i - least, -1, -1):
            w = s[j:i]
            if best[j] is not None and w in known and w != s and best[j][0] < most:
                new = (best[j][0] + 1, best[j][1] - known[w], [*best[j][2], w])
                if best[i] is None or new < best[i]:
                    best[i] = new
    return best[-1][2] if best[-1] and best[-1][0] > 1 else None


def compounds(tokens: DataFrame, shared, column: str = "word") -> DataFrame:
    """(word, parts) of the distinct words that split into known ones."""

    @F.pandas_udf(A.ArrayType(A.StringType()))
    def split(s: pd.Series) -> pd.Series:
        known = shared.value[0]
        return s.map(lambda x: None if x is None else parts_of(x, known))

    return tokens.select(F.col(column).alias("word")).distinct().withColumn("parts", split("word")).filter("parts is not null")


def mixed_script(column: Column) -> Column:
    """Runs of the script and, between them, one token for what isn't of it."""
    marked = F.regexp_replace(column, r"[^က-၏\s]+", f" {LATIN} ")
    return F.filter(F.split(marked, r"\s+"), lambda x: x != "")


def merge_fragments(words: Column) -> Column:
    """A fragment that can't begin a word (a mark, or a killed consonant) joins the word before."""
    odd = f"^[ါ-ှ]|^[က-အ]{T.ASAT}"
    return F.aggregate(
        words,
        F.array().cast("array<string>"),
        lambda out, x: F.when((F.size(out) > 0) & x.rlike(odd), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.concat(F.element_at(out, -1), x)))).otherwise(F.concat(out, F.array(x))),
    )


def is_segmented(words: Column, valid, ratio: float = 0.7) -> Column:
    """Whether enough of the tokens are valid words already."""
    return (F.size(words) > 0) & (F.size(F.filter(words, valid)) >= ratio * F.size(words))


def entities(tokens: DataFrame, doc: str, gazetteer: DataFrame, honorifics: tuple[str, ...] = ("ဦး", "ဒေါ်", "ကို", "မ")) -> DataFrame:
    """(doc, idx, token, entity_type, source, confidence): tokens of the gazetteer, else those behind an honorific."""
    before = F.lag("token").over(Window.partitionBy(doc).orderBy("idx"))
    g = gazetteer.select(F.col("entity").alias("token"), "entity_type", F.col("confidence").alias("g_conf"))
    x = tokens.withColumn("before", before).join(g, "token", "left")
    kind = F.coalesce("entity_type", F.when(F.col("before").isin(*honorifics), "PER"))
    x = x.withColumn("kind", kind).filter("kind is not null")
    return x.select(doc, "idx", "token", F.col("kind").alias("entity_type"), F.when(F.col("entity_type").isNotNull(), "gazetteer").otherwise("honorific").alias("source"), F.coalesce("g_conf", F.lit(0.7)).alias("confidence"))


def reduplications(words: DataFrame) -> DataFrame:
    """(word, base) of words that say a known base twice."""
    x = words.select("word").filter(T.is_reduplicated(F.col("word"))).withColumn("base", F.expr("substring(word, 1, CAST(length(word) / 2 AS INT))"))
    return x.join(words.select(F.col("word").alias("base")), "base", "left_semi").select("word", "base")


def marginals(sentences: DataFrame, transitions: dict[tuple[str, str], float], emissions: dict[str, dict[str, float]], tags: list[str], floor: float = 1e-10) -> DataFrame:
    """Add ``marginals``: for each word the probability of each tag (in order of ``tags``), by forward and backward sums."""
    shared = sentences.sparkSession.sparkContext.broadcast((transitions, emissions, tags))

    def both(words) -> list[list[float]]:
        trans, emit, every = shared.value
        e = [[max((emit.get(w) or dict.fromkeys(every, 1.0)).get(t, 0.0), floor) for t in every] for w in words]
        step = [[max(trans.get((a, b), 0.0), floor) for b in every] for a in every]
        n, k = len(words), range(len(every))
        fwd: list[list[float]] = []
        for i in range(n):
            row = [e[i][t] * (max(trans.get(("", every[t]), 0.0), floor) if i == 0 else sum(fwd[-1][u] * step[u][t] for u in k)) for t in k]
            fwd.append([x / sum(row) for x in row])
        back = [[1.0] * len(every)] if n else []
        for i in range(n - 1, 0, -1):
            row = [sum(step[t][u] * e[i][u] * back[0][u] for u in k) for t in k]
            back.insert(0, [x / sum(row) for x in row])
        out = [[f * b for f, b in zip(x, y, strict=True)] for x, y in zip(fwd, back, strict=True)]
        return [[x / sum(r) for x in r] for r in out]

    @F.pandas_udf(A.ArrayType(A.ArrayType(A.DoubleType())))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: both(list(x)) if x is not None else None)

    return sentences.withColumn("marginals", run("words"))
