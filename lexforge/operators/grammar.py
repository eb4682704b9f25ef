"""Grammar checks over tokens with their neighbours in the sentence; all rules are tables, and each check is a join or a window.

Checks return (doc, idx, error_type, text, fix, confidence, priority). Rule tables are joined without a hint: small ones are broadcast by their size, large ones shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sentences(docs: DataFrame, doc: str, words: Column, ends: str = "[.!?]$", marks: str = "[.,!?;:]+$") -> DataFrame:
    """(doc, idx, sent, token, prev2, prev, next): tokens without the marks behind them; a token that ends a sentence is its last. Neighbours are those of the sentence."""
    rows = docs.select(doc, F.posexplode(words).alias("idx", "raw"))
    before = Window.partitionBy(doc).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("sent", F.coalesce(F.sum(F.col("raw").rlike(ends).cast("long")).over(before), F.lit(0).cast("long"))).withColumn("token", F.regexp_replace("raw", marks, ""))
    w = Window.partitionBy(doc, "sent").orderBy("idx")
    return rows.select(doc, "idx", "sent", "token", F.lag("token", 2).over(w).alias("prev2"), F.lag("token").over(w).alias("prev"), F.lead("token").over(w).alias("next"))


def _error(x: DataFrame, doc: str, kind: str, fix: Column, confidence: Column, priority: int) -> DataFrame:
    return x.select(doc, "idx", F.lit(kind).alias("error_type"), F.col("token").alias("text"), fix.cast("string").alias("fix"), confidence.cast("double").alias("confidence"), F.lit(priority).alias("priority"))


def _named(table: DataFrame, **names: str) -> DataFrame:
    return table.select(*[F.col(old).alias(new) for new, old in names.items()])


def word_rules(near: DataFrame, doc: str, rules: DataFrame, kind: str, priority: int) -> DataFrame:
    """Tokens that a rule (token, left, right, fix, confidence) names between its neighbours; a null neighbour fits all. Of several rules the most confident one, then the first by fix."""
    r = _named(rules, token="token", r_left="left", r_right="right", fix="fix", r_confidence="confidence")
    x = near.join(r, "token").filter((F.col("r_left").isNull() | (F.col("r_left") == F.col("prev"))) & (F.col("r_right").isNull() | (F.col("r_right") == F.col("next"))))
    best = F.row_number().over(Window.partitionBy(doc, "idx").orderBy(F.desc("r_confidence"), "fix"))
    return _error(x.withColumn("n", best).filter("n = 1"), doc, kind, F.col("fix"), F.col("r_confidence"), priority)


def agreement(near: DataFrame, doc: str, frames: DataFrame, priority: int = 14, confidence: float = 0.7) -> DataFrame:
    """Particles behind a verb whose frames (verb, particle) don't have it; the fix is the verb's first particle."""
    particles = frames.select(F.col("particle").alias("token")).distinct()
    first = frames.groupBy(F.col("verb").alias("prev")).agg(F.min("particle").alias("fix"))
    x = near.join(particles, "token").join(first, "prev").join(_named(frames, prev="verb", token="particle"), ["prev", "token"], "left_anti")
    return _error(x, doc, "verb_particle", F.col("fix"), F.lit(confidence), priority)


def chains(near: DataFrame, doc: str, pairs: DataFrame, priority: int = 16) -> DataFrame:
    """Tokens that may not follow the one before; pairs (left, right, confidence)."""
    return _error(near.join(_named(pairs, prev="left", token="right", c="confidence"), ["prev", "token"]), doc, "particle_chain", F.lit(None), F.col("c"), priority)


def constraints(near: DataFrame, doc: str, needs: DataFrame, classes: DataFrame, priority: int = 13, confidence: float = 0.65) -> DataFrame:
    """Tokens (token, class) that must stand behind a word of the class (word, class) and don't; at the start of a sentence nothing stands before."""
    x = near.join(_named(needs, token="token", need="class"), "token").join(_named(classes, prev="word", has="class"), "prev", "left")
    return _error(x.filter(F.col("has").isNull() | (F.col("has") != F.col("need"))), doc, "particle_constraint", F.lit(None), F.lit(confidence), priority)


def classifiers(near: DataFrame, doc: str, nouns: DataFrame, counters: DataFrame, numerals: tuple[str, ...], priority: int = 18, confidence: float = 0.8) -> DataFrame:
    """Counters behind a noun and a numeral that are of another class than the noun; (word, class) each. The fix is the first counter of the noun's class."""
    first = counters.groupBy(F.col("class").alias("want")).agg(F.min("word").alias("fix"))
    x = near.filter(F.col("prev").isin(*numerals)).join(_named(nouns, prev2="word", want="class"), "prev2").join(_named(counters, token="word", own="class"), "token")
    return _error(x.filter("own <> want").join(first, "want", "left"), doc, "classifier", F.col("fix"), F.lit(confidence), priority)


def negation(near: DataFrame, doc: str, prefix: str, endings: DataFrame, priority: int = 19, confidence: float = 0.75) -> DataFrame:
    """Last tokens of sentences with an affirmative ending (affirmative, negative) although a token before begins with the prefix of negation."""
    before = Window.partitionBy(doc, "sent").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    denied = F.max((F.col("token").startswith(prefix) & (F.length("token") > len(prefix))).cast("int")).over(before)
    x = near.withColumn("denied", denied).filter((F.col("denied") == 1) & F.col("next").isNull()).join(_named(endings, token="affirmative", fix="negative"), "token")
    return _error(x, doc, "negation", F.col("fix"), F.lit(confidence), priority)


def tense(near: DataFrame, doc: str, adverbs: DataFrame, markers: DataFrame, priority: int = 20, confidence: float = 0.7) -> DataFrame:
    """Markers (word, tense) in sentences whose adverbs (word, tense) are all of other tenses."""
    said = near.join(_named(adverbs, token="word", tense="tense"), "token").groupBy(doc, "sent").agg(F.collect_set("tense").alias("said"))
    x = near.join(_named(markers, token="word", own="tense"), "token").join(said, [doc, "sent"]).filter(~F.array_contains(F.col("said"), F.col("own")))
    return _error(x, doc, "tense", F.lit(None), F.lit(confidence), priority)


def registers(near: DataFrame, doc: str, marks: DataFrame, priority: int = 21) -> DataFrame:
    """Marks (word, register, other) of a register that the document has less of than of the others; the fix is their counterpart, the confidence the share of the others."""
    x = near.join(_named(marks, token="word", register="register", other="other"), "token")
    mine, every = F.count("*").over(Window.partitionBy(doc, "register")), F.count("*").over(Window.partitionBy(doc))
    x = x.withColumns({"mine": mine, "every": every}).filter("2 * mine < every")
    return _error(x, doc, "register", F.col("other"), 1 - F.col("mine") / F.col("every"), priority)


def aspect(near: DataFrame, doc: str, ranks: DataFrame, priority: int = 17, confidence: float = 0.6) -> DataFrame:
    """Markers (word, rank) behind a marker of the same or a higher rank."""
    x = near.join(_named(ranks, token="word", own="rank"), "token").join(_named(ranks, prev="word", before="rank"), "prev").filter("before >= own")
    return _error(x, doc, "aspect", F.lit(None), F.lit(confidence), priority)


def boundaries(near: DataFrame, doc: str, no_start: tuple[str, ...], no_end: tuple[str, ...], priority: int = 12, confidence: float = 0.55) -> DataFrame:
    """Tokens that begin a sentence (of two tokens or more) and must not, or end one and must not."""
    start = F.col("prev").isNull() & F.col("next").isNotNull() & F.col("token").isin(*no_start)
    end = F.col("next").isNull() & F.col("prev").isNotNull() & F.col("token").isin(*no_end)
    return _error(near.filter(start | end), doc, "boundary", F.lit(""), F.lit(confidence), priority)


def structure(near: DataFrame, doc: str, ends: tuple[str, ...], least: int = 5, priority: int = 11, confidence: float = 0.5) -> DataFrame:
    """Last tokens of sentences of ``least`` tokens or more that have none of the endings."""
    n = F.count("*").over(Window.partitionBy(doc, "sent"))
    ok = reduce(lambda a, b: a | b, [F.col("token").endswith(e) for e in ends])
    return _error(near.withColumn("n", n).filter((F.col("n") >= least) & F.col("next").isNull() & ~ok), doc, "structure", F.lit(None), F.lit(confidence), priority)


def merged(near: DataFrame, doc: str, words: DataFrame, bigrams: DataFrame, rare: int = 2, least: int = 5, priority: int = 15, confidence: float = 0.7) -> DataFrame:
    """Tokens that are no words, or no commoner than ``rare``, and spell a pair of words that stands side by side ``least`` times; the commonest pair, then the first."""
    w = Window.partitionBy("token").orderBy(F.desc("cnt"), "w1")
    pairs = bigrams.filter(F.col("cnt") >= least).select(F.concat("w1", "w2").alias("token"), "w1", "w2", "cnt").withColumn("n", F.row_number().over(w)).filter("n = 1")
    x = near.join(pairs.select("token", F.concat_ws(" ", "w1", "w2").alias("fix")), "token").join(words.select(F.col("word").alias("token"), "frequency"), "token", "left")
    return _error(x.filter(F.coalesce("frequency", F.lit(0)) <= rare), doc, "merged", F.col("fix"), F.lit(confidence), priority)


def split(near: DataFrame, doc: str, words: DataFrame, rare: int = 5, least: int = 10, priority: int = 22, confidence: float = 0.7) -> DataFrame:
    """Tokens that with the next one spell a word of ``least`` uses while one of the two is rarer than ``rare``."""
    f = words.select("word", "frequency")
    x = near.filter("next is not null").withColumn("joined", F.concat("token", "next")).join(f.filter(F.col("frequency") >= least).toDF("joined", "fj"), "joined")
    x = x.join(f.toDF("token", "ft"), "token", "left").join(f.toDF("next", "fn"), "next", "left").filter(F.least(F.coalesce("ft", F.lit(0)), F.coalesce("fn", F.lit(0))) < rare)
    return _error(x, doc, "split", F.col("joined"), F.lit(confidence), priority)


def repeated(near: DataFrame, doc: str, allowed: tuple[str, ...] = (), priority: int = 10, confidence: float = 0.6) -> DataFrame:
    """Tokens of two or more characters that say the one before again."""
    x = near.filter((F.col("token") == F.col("prev")) & (F.length("token") > 1))
    return _error(x.filter(~F.col("token").isin(*allowed)) if allowed else x, doc, "repeated", F.lit(""), F.lit(confidence), priority)


def linkage(near: DataFrame, doc: str, pairs: DataFrame, priority: int = 9, confidence: float = 0.5) -> DataFrame:
    """Linkers (linker, partner) whose partner doesn't follow in the sentence."""
    last = near.groupBy(doc, "sent", F.col("token").alias("partner")).agg(F.max("idx").alias("at"))
    x = near.join(_named(pairs, token="linker", partner="partner"), "token").join(last, [doc, "sent", "partner"], "left").filter("at is null or at <= idx")
    return _error(x, doc, "linkage", F.col("partner"), F.lit(confidence), priority)


def resolve(parts: list[DataFrame], doc: str) -> DataFrame:
    """The error of the highest priority of each place, then the most confident one, then the first by type."""
    every = reduce(DataFrame.unionByName, parts)
    best = F.row_number().over(Window.partitionBy(doc, "idx").orderBy(F.desc("priority"), F.desc("confidence"), "error_type"))
    return every.withColumn("n", best).filter("n = 1").drop("n")


def dominant(words: DataFrame, variants, ratio: float = 10.0) -> DataFrame:
    """(word, variant, type, ratio): the variant of each word that is at least ``ratio`` times as frequent; the most frequent one, then the first."""
    f = words.select("word", "frequency")
    x = f.select("word", "frequency", F.inline(variants(F.col("word")))).join(f.toDF("variant", "other"), "variant").filter(F.col("other") >= ratio * F.col("frequency"))
    best = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("other"), "variant", "type"))
    return x.withColumn("n", best).filter("n = 1").select("word", "variant", "type", (F.col("other") / F.col("frequency")).alias("ratio"))


def windows_of(parts: Column, n: int) -> Column:
    """Array of what n parts in a row spell."""
    return F.when(F.size(parts) >= n, F.transform(F.sequence(F.lit(1), F.size(parts) - (n - 1)), lambda i: F.array_join(F.slice(parts, i, F.lit(n)), ""))).otherwise(F.array().cast("array<string>"))
