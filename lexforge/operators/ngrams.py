"""Token and n-gram counts, conditional probabilities, continuations.

N-grams come from arrays inside a row, so tokens aren't shuffled: only partially summed counts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def token_counts(docs: DataFrame, tokens: Column, min_count: int = 1, blacklist: tuple[str, ...] = (), curated: DataFrame | None = None) -> DataFrame:
    """(word, frequency) of tokens at least ``min_count`` times there; words of ``curated`` (word) stay at any count."""
    words = docs.select(F.explode(tokens).alias("word"))
    if blacklist:
        words = words.filter(~F.col("word").isin(*blacklist))
    counts = words.groupBy("word").agg(F.count("*").alias("frequency"))
    if curated is None:
        return counts.filter(F.col("frequency") >= min_count)
    marked = counts.join(curated.select("word").distinct().withColumn("_curated", F.lit(True)), "word", "left")
    return marked.filter((F.col("frequency") >= min_count) | F.col("_curated").isNotNull()).drop("_curated")


def is_quality(word: Column) -> Column:
    """Letters only, at least two, at most 40, and no letter four times in a row."""
    return word.rlike(r"^\p{L}+$") & (F.length(word) >= 2) & (F.length(word) <= 40) & ~word.rlike(r"(\p{L})\1\1\1")


def windows(docs: DataFrame, tokens: Column, n: int = 3, blacklist: tuple[str, ...] = ()) -> DataFrame:
    """(w1, ..., wn) from every token on; what lies behind the end is null.

    Blanks are gone before neighbours are found. A window with a blacklisted word goes, and with it
    the shorter n-grams that begin there.
    """
    names = [f"w{i + 1}" for i in range(n)]
    arrays = docs.select(tokens.alias("t")).filter(F.size("t") > 0)
    zipped = F.arrays_zip(*[(F.col("t") if i == 0 else F.slice("t", F.lit(i + 1), F.size("t"))).alias(names[i]) for i in range(n)])
    rows = arrays.select(F.inline(zipped)).toDF(*names)
    if blacklist:
        for c in names:
            rows = rows.filter(F.col(c).isNull() | ~F.col(c).isin(*blacklist))
    return rows


def ngram_counts(rows: DataFrame, n: int, min_count: int = 1, vocabulary: DataFrame | None = None) -> DataFrame:
    """(w1, ..., wn, cnt) of whole n-grams; with ``vocabulary`` (word) all members must be in it."""
    names = [f"w{i + 1}" for i in range(n)]
    counts = rows.select(*names).na.drop().groupBy(*names).agg(F.count("*").alias("cnt")).filter(F.col("cnt") >= min_count)
    if vocabulary is not None:
        known = vocabulary.select("word")
        for c in names:
            counts = counts.join(known.withColumnRenamed("word", c), c, "left_semi")
    return counts.select(*names, "cnt")


def conditional(counts: DataFrame) -> DataFrame:
    """Add ``probability``: cnt over the sum of cnt of the same prefix, as far as it was kept, to six places."""
    prefix = [c for c in counts.columns if c != "cnt"][:-1]
    # sums are combined before they are shuffled, and a join can split what follows a very common word; a window could not
    total = counts.groupBy(*prefix).agg(F.sum("cnt").alias("_total"))
    out = counts.join(total, prefix).withColumn("probability", F.round(F.col("cnt") / F.col("_total"), 6))
    return out.select(*counts.columns, "probability")


def top_continuations(bigrams: DataFrame, k: int) -> DataFrame:
    """The k likeliest followers of each word, ties by word."""
    rank = F.row_number().over(Window.partitionBy("w1").orderBy(F.desc("probability"), F.desc("cnt"), "w2"))
    return bigrams.withColumn("rank", rank).filter(F.col("rank") <= k)


def load_limit(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent rows."""
    keys = [c for c in counts.columns if c not in ("cnt", "probability")]
    return counts.orderBy(F.desc("cnt"), *keys).limit(n)


def table_stats(counts: DataFrame, column: str = "cnt") -> DataFrame:
    return counts.agg(F.count("*").alias("entries"), F.coalesce(F.sum(column), F.lit(0)).alias("total"))


def quality_report(docs: DataFrame, tokens: Column, empty_limit: float = 20.0, least: float = 3.0, most: float = 30.0) -> DataFrame:
    """Share of empty rows (percent), mean words a row, and whether both are within limits."""
    n = F.size(tokens)
    out = docs.select(n.alias("n")).agg(F.count("*").alias("rows"), F.sum((F.col("n") == 0).cast("long")).alias("empty"), F.avg(F.when(F.col("n") > 0, F.col("n"))).alias("avg_words"))
    pct = 100.0 * F.col("empty") / F.col("rows")
    return out.withColumn("empty_pct", pct).withColumn("ok", (pct <= empty_limit) & F.col("avg_words").between(least, most))


def frequency_denominator(words: DataFrame, share: float = 0.95, factor: int = 10) -> DataFrame:
    """factor * the frequency at place int(n * share) of the ascending list.

    The place is found through the histogram of frequencies, whose values are few against the words.
    """
    histogram = words.groupBy("frequency").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("frequency").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("n").over(Window.partitionBy())
    at = F.least(F.floor(total * F.lit(share)), total - 1)
    placed = histogram.withColumn("upto", upto).withColumn("at", at)
    return placed.filter((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n"))).select((F.col("frequency") * factor).alias("denominator"))
