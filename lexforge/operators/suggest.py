"""Suggestions: a deletion index, candidates, ranking; smoothing and context scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import deletes, osa


def index(words: DataFrame, distance: int = 2, prefix: int = 10, min_count: int = 1) -> DataFrame:
    """(key, term, frequency): each term under its prefix and what deletions leave of it."""
    return words.filter(F.col("frequency") >= min_count).select(F.explode(deletes(F.col("word"), distance, prefix)).alias("key"), F.col("word").alias("term"), "frequency")


def lookup(queries: DataFrame, words: DataFrame, distance: int = 2, prefix: int = 10, min_count: int = 1) -> DataFrame:
    """(query, term, frequency, distance) of terms within ``distance`` of each query that isn't a known term itself."""
    known = words.filter(F.col("frequency") >= min_count).select(F.col("word").alias("query"))
    asked = queries.select("query").filter("query is not null").distinct().join(known, "query", "left_anti")
    keyed = asked.select("query", F.explode(deletes(F.col("query"), distance, prefix)).alias("key"))
    found = keyed.join(index(words, distance, prefix, min_count), "key").select("query", "term", "frequency")
    # pairs that are too far apart go before they are shuffled
    near = found.filter(F.abs(F.length("query") - F.length("term")) <= distance).filter(F.levenshtein("query", "term") <= 2 * distance).distinct()
    return near.withColumn("distance", osa("query", "term")).filter(F.col("distance") <= distance)


def rank(candidates: DataFrame, k: int = 5, w_distance: float = 1.0, w_frequency: float = 0.1) -> DataFrame:
    """Add score (lower is better) and rank; ties by frequency, then term."""
    score = w_distance * F.col("distance") - w_frequency * F.log10(F.col("frequency") + 1)
    w = Window.partitionBy("query").orderBy("score", F.desc("frequency"), "term")
    return candidates.withColumn("score", score).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Orders of the other rankers: frequency first, edits only, sound first.
ORDERS = {
    "frequency": lambda: [F.desc("frequency"), F.col("distance"), F.col("term")],
    "edits": lambda: [F.col("distance"), F.col("term")],
    "sound": lambda: [F.desc("sound"), F.col("distance"), F.col("term")],
}


def rank_by(candidates: DataFrame, order: str, k: int = 5) -> DataFrame:
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*ORDERS[order]()))).filter(F.col("rank") <= k)


def merge_sources(parts: list[DataFrame]) -> DataFrame:
    """Union of candidates (query, term, score, source): the best source of each term, ties by source."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = F.row_number().over(Window.partitionBy("query", "term").orderBy(F.desc("score"), "source"))
    return every.withColumn("n", best).filter("n = 1").drop("n")


def diverse(candidates: Column, most_alike: float, alike) -> Column:
    """Greedy filter of a ranked array: an element stays unless it is too much like one that stayed."""
    empty = F.array().cast("array<string>")
    return F.aggregate(candidates, empty, lambda out, x: F.when(F.exists(out, lambda y: alike(x, y) > most_alike), out).otherwise(F.concat(out, F.array(x))))


def unified_score(base: Column, source: Column, confidence: Column, weights: dict[str, float], blend: float = 0.3, floor: float = -0.5) -> Column:
    """Sigmoid of a score, less bonuses of source and confidence, blended with the source's own score, at least ``floor``."""
    bonus = F.lit(0.0)
    for name, w in weights.items():
        bonus = F.when(source == name, F.lit(w)).otherwise(bonus)
    own = 1 / (1 + F.exp(-base))
    return F.greatest((1 - blend) * (own - bonus) + blend * (1 - confidence), F.lit(floor))


def backoff_bigram(pairs: DataFrame, bigrams: DataFrame, words: DataFrame, alpha: float = 0.4, cap: float = 0.1, denominator: float = 5e8) -> DataFrame:
    """Add ``p``: the bigram's probability, else alpha times the word's, capped; 0 for unknown words."""
    b = bigrams.select("w1", "w2", "probability")
    f = words.select(F.col("word").alias("w2"), "frequency")
    single = F.least(alpha * F.col("frequency") / F.lit(denominator), F.lit(cap))
    return pairs.join(b, ["w1", "w2"], "left").join(f, "w2", "left").withColumn("p", F.coalesce("probability", single, F.lit(0.0))).drop("probability", "frequency")


def backoff_trigram(triples: DataFrame, trigrams: DataFrame, bigrams: DataFrame, words: DataFrame, alpha: float = 0.4, cap: float = 0.1, denominator: float = 5e8) -> DataFrame:
    """Add ``p``: the trigram's probability, else alpha times the bigram's, else alpha squared times the word's, capped."""
    x = triples.join(trigrams.select("w1", "w2", "w3", F.col("probability").alias("p3")), ["w1", "w2", "w3"], "left")
    x = x.join(bigrams.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("probability").alias("p2")), ["w2", "w3"], "left")
    x = x.join(words.select(F.col("word").alias("w3"), "frequency"), "w3", "left")
    single = F.least(alpha * alpha * F.col("frequency") / F.lit(denominator), F.lit(cap))
    return x.withColumn("p", F.coalesce("p3", alpha * F.col("p2"), single, F.lit(0.0))).drop("p3", "p2", "frequency")


def add_k(cnt: Column, prefix: Column, size: Column, k: float = 1.0) -> Column:
    return (cnt + k) / (prefix + k * size)


def context_score(p: Column, distance: Column, w_p: float = 0.4, w_d: float = 0.6, scale: float = 10.0) -> Column:
    """Weight of the log probability less that of the edit distance."""
    return w_p * F.log(F.greatest(p, F.lit(1e-10))) - w_d * distance * scale


def ratio_of(a: Column, b: Column) -> Column:
    """a / b as SQL's doubles have it: probabilities to six places may be 0, over which a / b is infinite, or NaN (above all) if a is 0 as well."""
    return F.when(b == 0, F.when(a == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(a / b)


def ratio_confidence(ratio: Column) -> Column:
    return 0.5 + 0.45 * F.least(F.log10(ratio) / 6, F.lit(1.0))


def statistical_confusables(tokens: DataFrame, pairs: DataFrame, bigrams: DataFrame, min_ratio: float = 10.0, unseen: float = 1e6) -> DataFrame:
    """(left, word, variant, ratio, confidence): variants of a confusable pair that fit the word before much better; the best one of each."""
    both = pairs.select(F.col("w1").alias("word"), F.col("w2").alias("variant")).unionByName(pairs.select(F.col("w2").alias("word"), F.col("w1").alias("variant")))
    p = bigrams.select("w1", "w2", "probability")
    x = tokens.join(both, "word").join(p.toDF("left", "word", "p"), ["left", "word"], "left").join(p.toDF("left", "variant", "q"), ["left", "variant"], "left")
    ratio = F.when(F.col("q").isNull(), F.lit(0.0)).when(F.col("p").isNull(), F.lit(unseen)).otherwise(ratio_of(F.col("q"), F.col("p")))
    x = x.withColumn("ratio", ratio).filter(F.col("ratio") >= min_ratio)
    w = Window.partitionBy("left", "word").orderBy(F.desc("ratio"), "variant")
    return x.withColumn("n", F.row_number().over(w)).filter("n = 1").select("left", "word", "variant", "ratio", ratio_confidence(F.col("ratio")).alias("confidence"))


def split_in_two(words: DataFrame, rare: int = 2, least: int = 20, shortest: int = 2) -> DataFrame:
    """(word, part1, part2, uses) of rare words that two commoner ones spell: the pair with the largest product of uses, then the first."""
    f = words.filter(F.col("frequency") >= least).select("word", "frequency")
    odd = words.filter((F.col("frequency") <= rare) & (F.length("word") >= 2 * shortest)).select("word", F.explode(F.sequence(F.lit(shortest), F.length("word") - shortest)).alias("i"))
    parts = odd.select("word", F.expr("substring(word, 1, i)").alias("part1"), F.expr("substring(word, i + 1)").alias("part2"))
    x = parts.join(f.toDF("part1", "f1"), "part1").join(f.toDF("part2", "f2"), "part2")
    best = F.row_number().over(Window.partitionBy("word").orderBy(F.desc(F.col("f1") * F.col("f2")), "part1"))
    return x.withColumn("n", best).filter("n = 1").select("word", "part1", "part2", (F.col("f1") * F.col("f2")).alias("uses"))
