"""Tag sequences under interpolated trigrams, and words and tags of unspaced text found together.

Lexicons are tables of any size: a sentence, or a string, meets only the rows of its own words. The tag model is of the size of the tag set.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as A

MOST_TAG_ROWS = 500_000


class TagModel:
    """P(tag), P(tag | one before), P(tag | two before) mixed with fixed weights; '' stands before the first tag."""

    def __init__(self, uni: dict[str, float], bi: dict[tuple[str, str], float], tri: dict[tuple[str, str, str], float], weights: tuple[float, float, float] = (0.1, 0.3, 0.6), floor: float = 1e-10):
        if len(tri) + len(bi) + len(uni) > MOST_TAG_ROWS:
            raise ValueError(f"a tag model may have {MOST_TAG_ROWS} rows")
        self.uni, self.bi, self.tri, self.floor = uni, bi, tri, floor
        self.weights = tuple(max(w / sum(weights), floor) for w in weights)

    def step(self, a: str, b: str, t: str) -> float:
        one, two, three = self.weights
        return math.log(max(one * self.uni.get(t, self.floor) + two * self.bi.get((b, t), self.floor) + three * self.tri.get((a, b, t), self.floor), self.floor))

    def options(self, known: dict[str, float] | None) -> dict[str, float]:
        """Log scores of the tags of a word: its own P(tag | word), or P(tag) for a word without any."""
        return {t: math.log(max(p, self.floor)) for t, p in (known or self.uni).items()}


def tag_model(uni: DataFrame, bi: DataFrame, tri: DataFrame, **options) -> TagModel:
    """The model of tables (tag, probability), (tag1, tag2, probability), (tag1, tag2, tag3, probability); more rows than a model may have are refused before they are fetched."""
    if sum(x.limit(MOST_TAG_ROWS + 1).count() for x in (uni, bi, tri)) > MOST_TAG_ROWS:
        raise ValueError(f"a tag model may have {MOST_TAG_ROWS} rows")
    rows = lambda df, *cols: df.select(*cols, "probability").collect()
    return TagModel({r[0]: r[1] for r in rows(uni, "tag")}, {(r[0], r[1]): r[2] for r in rows(bi, "tag1", "tag2")}, {(r[0], r[1], r[2]): r[3] for r in rows(tri, "tag1", "tag2", "tag3")}, **options)


def best_tags(words: Iterable[str], lexicon: dict[str, dict[str, float]], model: TagModel, beam: int = 25) -> list[str]:
    """Likeliest tags. States are pairs of tags, the ``beam`` best of which go on; of equal ones the first by their tags. Time and memory follow the number of words."""
    scores: dict[tuple[str, str], float] = {("", ""): 0.0}
    back: list[dict[tuple[str, str], str]] = []
    for w in words:
        out: dict[tuple[str, str], tuple[float, str]] = {}
        for t, e in model.options(lexicon.get(w)).items():
            for (a, b), score in scores.items():
                new = (-(score + model.step(a, b, t) + e), a)
                if (b, t) not in out or new < out[b, t]:
                    out[b, t] = new
        kept = sorted(out, key=lambda x: (out[x][0], x))[:beam]
        scores = {x: -out[x][0] for x in kept}
        back.append({x: out[x][1] for x in kept})
    if not back or not scores:
        return []
    b, t = min(scores, key=lambda x: (-scores[x], x))
    tags: list[str] = []
    for step in reversed(back):
        tags.append(t)
        b, t = step[b, t], b
    return tags[::-1]


def _lexicon(rows) -> dict[str, dict[str, float]]:
    out: dict[str, dict[str, float]] = {}
    for r in () if rows is None else rows:
        out.setdefault(r["word"], {})[r["tag"]] = r["p"]
    return out


def tag(sentences: DataFrame, key: str, emissions: DataFrame, model: TagModel, beam: int = 25) -> DataFrame:
    """(key, words, tags) of rows (key, words) by emissions (word, tag, p = P(tag | word)). Null words have null tags, none none."""
    own = sentences.filter("words is not null").select(key, F.explode(F.array_distinct("words")).alias("word")).join(emissions.select("word", "tag", "p"), "word")
    rows = own.groupBy(key).agg(F.collect_list(F.struct("word", "tag", "p")).alias("_lexicon"))
    shared = sentences.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(A.ArrayType(A.StringType()))
    def run(words: pd.Series, lexicon: pd.Series) -> pd.Series:
        return pd.Series([None if w is None else best_tags(w, _lexicon(x), shared.value, beam) for w, x in zip(words, lexicon, strict=True)], dtype=object)

    return sentences.select(key, "words").join(rows, key, "left").select(key, "words", run("words", "_lexicon").alias("tags"))


def best_words(s: str, uses: dict[str, float], lexicon: dict[str, dict[str, float]], model: TagModel, beam: int = 25, unknown: float = -12.0) -> tuple[list[str], list[str]]:
    """Likeliest words and tags of s at once; ``uses`` has log P(word). A character that is no word is one at ``unknown``.

    Of equal answers the one with fewer words, then with the longer last word, then with the first tags by text.
    """
    most = max(map(len, uses), default=1)
    # at[i]: by the last two tags, (less the score, number of words, start of the last word, tag before these two) of the first i characters
    at: list[dict[tuple[str, str], tuple[float, int, int, str]]] = [{("", ""): (0.0, 0, 0, "")}] + [{} for _ in s]
    for i in range(1, len(s) + 1):
        for j in range(max(0, i - most), i):
            w = s[j:i]
            if w not in uses and i - j > 1:
                continue
            options = model.options(lexicon.get(w))
            for (a, b), (cost, n, _, _) in at[j].items():
                for t, e in options.items():
                    new = (cost - uses.get(w, unknown) - model.step(a, b, t) - e, n + 1, j, a)
                    if (b, t) not in at[i] or new < at[i][b, t]:
                        at[i][b, t] = new
        at[i] = dict(sorted(at[i].items(), key=lambda x: (x[1], x[0]))[:beam])
    words: list[str] = []
    tags: list[str] = []
    i, state = len(s), min(at[-1], key=lambda x: (at[-1][x], x), default=("", ""))
    while i > 0 and state in at[i]:
        _, _, j, a = at[i][state]
        words.append(s[j:i])
        tags.append(state[1])
        i, state = j, (a, state[0])
    return words[::-1], tags[::-1]


def segment_and_tag(strings: DataFrame, words: DataFrame, emissions: DataFrame, model: TagModel, longest: int = 20, beam: int = 25) -> DataFrame:
    """(string, words, tags) of the distinct strings by words (word, frequency) and emissions (word, tag, p); the words of a string are its substrings of up to ``longest`` characters."""
    total = words.filter("frequency > 0").agg(F.coalesce(F.sum("frequency"), F.lit(1)).alias("total"))
    known = words.filter((F.length("word").between(1, longest)) & (F.col("frequency") > 0)).select("word", "frequency")
    asked = strings.select("string").filter("string is not null").distinct()
    n = F.length("string")
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), n - i + 1)), lambda m: F.substring(F.col("string"), i, m))))
    found = asked.filter("string <> ''").select("string", F.explode(F.array_distinct(pieces)).alias("word")).join(known, "word").crossJoin(F.broadcast(total))
    found = found.withColumn("p", F.log(F.col("frequency") / F.col("total")))
    uses = found.groupBy("string").agg(F.map_from_entries(F.collect_list(F.struct("word", "p"))).alias("uses"))
    own = found.select("string", "word").join(emissions.select("word", "tag", "p"), "word").groupBy("string").agg(F.collect_list(F.struct("word", "tag", "p")).alias("lexicon"))
    shared = strings.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(A.StructType([A.StructField("words", A.ArrayType(A.StringType())), A.StructField("tags", A.ArrayType(A.StringType()))]))
    def run(s: pd.Series, u: pd.Series, x: pd.Series) -> pd.DataFrame:
        rows = [best_words(a, dict(b or {}), _lexicon(c), shared.value, beam) for a, b, c in zip(s, u, x, strict=True)]
        return pd.DataFrame(rows, columns=["words", "tags"])

    return asked.join(uses, "string", "left").join(own, "string", "left").select("string", run("string", "uses", "lexicon").alias("r")).select("string", "r.*")
