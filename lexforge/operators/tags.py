"""Tag sequences: histograms, smoothed transitions, dominant tags, disambiguation, Viterbi."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sequences(rows: DataFrame, key: str, order: list[str], tag: str) -> DataFrame:
    """(key, tag, tag2, tag3): each tag and the two that follow it in its sequence."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.select(key, F.col(tag).alias("tag1"), F.lead(tag, 1).over(w).alias("tag2"), F.lead(tag, 2).over(w).alias("tag3"))


def unigram(seq: DataFrame) -> DataFrame:
    c = seq.groupBy(F.col("tag1").alias("tag")).agg(F.count("*").alias("cnt"))
    return c.withColumn("probability", F.col("cnt") / F.sum("cnt").over(Window.partitionBy()))


def bigram_laplace(seq: DataFrame) -> DataFrame:
    """(tag1, tag2, cnt, probability) for all pairs of tags: (c + 1) / (predecessors + V). Tags are few; words never go through here."""
    tags = seq.select(F.col("tag1").alias("tag")).distinct()
    pairs = seq.filter("tag2 is not null").groupBy("tag1", "tag2").agg(F.count("*").alias("cnt"))
    before = pairs.groupBy("tag1").agg(F.sum("cnt").alias("pred"))
    grid = tags.toDF("tag1").crossJoin(tags.toDF("tag2")).crossJoin(F.broadcast(tags.agg(F.count("*").alias("v"))))
    out = grid.join(pairs, ["tag1", "tag2"], "left").join(before, "tag1", "left").na.fill(0, ["cnt", "pred"])
    return out.select("tag1", "tag2", "cnt", ((F.col("cnt") + 1) / (F.col("pred") + F.col("v"))).alias("probability"))


def trigram_laplace(seq: DataFrame) -> DataFrame:
    """(tag1, tag2, tag3, cnt, probability) for the prefixes that a third tag follows, with all tags."""
    tags = seq.select(F.col("tag1").alias("tag")).distinct()
    triples = seq.filter("tag2 is not null and tag3 is not null").groupBy("tag1", "tag2", "tag3").agg(F.count("*").alias("cnt"))
    prefix = triples.groupBy("tag1", "tag2").agg(F.sum("cnt").alias("pred"))
    grid = prefix.crossJoin(tags.toDF("tag3")).crossJoin(F.broadcast(tags.agg(F.count("*").alias("v"))))
    out = grid.join(triples, ["tag1", "tag2", "tag3"], "left").na.fill(0, ["cnt"])
    return out.select("tag1", "tag2", "tag3", "cnt", ((F.col("cnt") + 1) / (F.col("pred") + F.col("v"))).alias("probability"))


def histogram(rows: DataFrame, word: str, tag: str, share: float = 0.05, unknown: str = "UNK") -> DataFrame:
    """(word, tag, cnt) without unknown tags and those below max(1, int(total * share)) of the word."""
    c = rows.filter(F.col(tag) != unknown).groupBy(F.col(word).alias("word"), F.col(tag).alias("tag")).agg(F.count("*").alias("cnt"))
    total = F.sum("cnt").over(Window.partitionBy("word"))
    return c.withColumn("least", F.greatest(F.lit(1), F.floor(total * share))).filter("cnt >= least").drop("least")


def dominant(hist: DataFrame, share: float = 0.95, least: int = 50) -> DataFrame:
    """(word, tag, share, total) of words with one tag in at least ``share`` of at least ``least`` uses; ties by tag."""
    best = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("cnt"), "tag"))
    total = F.sum("cnt").over(Window.partitionBy("word"))
    x = hist.withColumn("n", best).withColumn("total", total).filter("n = 1").withColumn("share", F.col("cnt") / F.col("total"))
    return x.filter((F.col("share") >= share) & (F.col("total") >= least)).select("word", "tag", "share", "total")


def coverage(words: DataFrame) -> DataFrame:
    """Counts of words with a tag, with an inferred tag only, and with neither."""
    tagged, inferred = F.col("pos_tag").isNotNull(), F.col("inferred_pos").isNotNull()
    return words.agg(F.count("*").alias("words"), F.count_if(tagged).alias("tagged"), F.count_if(~tagged & inferred).alias("inferred"), F.count_if(~tagged & ~inferred).alias("untagged"))


def resolve(words: DataFrame, roots: DataFrame, guess: Column) -> DataFrame:
    """Add ``resolved``: the tag, else the inferred one, else that of the root (word, root_tag), else the guess."""
    return words.join(roots, "word", "left").withColumn("resolved", F.coalesce("pos_tag", "inferred_pos", "root_tag", guess)).drop("root_tag")


def infer(words: DataFrame, rules: list[tuple[str, str, str, float]]) -> DataFrame:
    """Add inferred_pos, inferred_confidence, inferred_source by the first of the (kind, text, tag, confidence) rules that fits; kinds: prefix, suffix, numeral."""
    out: dict[str, Column | None] = {"pos": None, "conf": None, "src": None}
    chain = {"pos": F.when(F.lit(False), ""), "conf": F.when(F.lit(False), F.lit(0.0)), "src": F.when(F.lit(False), "")}
    for kind, text, tag, conf in rules:
        fits = {"prefix": F.col("word").startswith(text), "suffix": F.col("word").endswith(text), "numeral": F.col("word").rlike(r"^\p{Nd}+$")}[kind]
        chain = {"pos": chain["pos"].when(fits, tag), "conf": chain["conf"].when(fits, F.lit(conf)), "src": chain["src"].when(fits, kind)}
    del out
    return words.withColumns({"inferred_pos": chain["pos"], "inferred_confidence": chain["conf"], "inferred_source": chain["src"]})


def disambiguate(tokens: DataFrame, key: str, at: str) -> DataFrame:
    """Choose ``tag`` of ``tags`` (array) by the neighbours' single tags: a noun before a particle, a verb before a verb particle or at the end, an adverb before a verb; else the first."""
    w = Window.partitionBy(key).orderBy(at)
    only = F.when(F.size("tags") == 1, F.element_at("tags", 1))
    x = tokens.withColumn("only", only).withColumn("next", F.lead("only").over(w)).withColumn("last", F.lead(at).over(w).isNull())
    has = lambda t: F.array_contains("tags", t)
    tag = (
        F.when(F.size("tags") == 1, F.element_at("tags", 1))
        .when(has("N") & F.col("next").isin("PPM", "PART"), "N")
        .when(has("V") & (F.col("next") == "VPART"), "V")
        .when(has("ADV") & (F.col("next") == "V"), "ADV")
        .when(has("V") & F.col("last"), "V")
        .otherwise(F.get("tags", F.lit(0)))
    )
    return x.withColumn("tag", tag).drop("only", "next", "last")


def viterbi(sentences: DataFrame, transitions: dict[tuple[str, str], float], emissions: dict[str, dict[str, float]], tags: list[str], floor: float = 1e-10, beam: int = 25) -> DataFrame:
    """Add ``tags`` to rows with ``words``: the likeliest tag sequence under bigram transitions ('' begins) and emissions P(tag | word).

    The two tables are model parameters of the size of the tag set and the lexicon; a word that isn't there takes any tag.
    """
    shared = sentences.sparkSession.sparkContext.broadcast((transitions, emissions, tags))

    def best(words) -> list[str]:
        trans, emit, every = shared.value
        paths: dict[str, tuple[float, list[str]]] = {"": (0.0, [])}
        for word in words:
            options = emit.get(word) or dict.fromkeys(every, 1.0 / len(every))
            step: dict[str, tuple[float, list[str]]] = {}
            for t, p in sorted(options.items()):
                score, path = max(((s + math.log(max(trans.get((u, t), 0.0), floor)) + math.log(max(p, floor)), h) for u, (s, h) in paths.items()), key=lambda x: (x[0], x[1]))
                step[t] = (score, [*path, t])
            paths = dict(sorted(step.items(), key=lambda x: (-x[1][0], x[0]))[:beam])
        return max(paths.values(), key=lambda x: (x[0], x[1]))[1]

    @F.pandas_udf("array<string>")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda x: best(x) if x is not None else None)

    return sentences.withColumn("tags", decode("words"))
