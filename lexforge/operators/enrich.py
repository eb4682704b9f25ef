"""Enrichment of a dictionary: collocations, broken compounds, confusable pairs, registers, contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import may_be_in
from ..functions.distance import deletes, deletion_hashes


def _with_frequency(bigrams: DataFrame, words: DataFrame) -> DataFrame:
    f = words.select("word", "frequency")
    out = bigrams.join(f.toDF("w1", "f1"), "w1").join(f.toDF("w2", "f2"), "w2")
    return out.crossJoin(F.broadcast(words.agg(F.sum("frequency").alias("total"))))


def collocations(bigrams: DataFrame, words: DataFrame, min_count: int = 10, min_pmi: float = 0.0, min_npmi: float = -1.0) -> DataFrame:
    """(w1, w2, cnt, pmi, npmi); both probabilities over the sum of all word frequencies. Certain pairs (cnt = total) have npmi 0."""
    x = _with_frequency(bigrams, words).filter((F.col("cnt") >= min_count) & (F.col("f1") > 0) & (F.col("f2") > 0))
    pxy = F.col("cnt") / F.col("total")
    pmi = F.log2(pxy / ((F.col("f1") / F.col("total")) * (F.col("f2") / F.col("total"))))
    npmi = F.when(F.col("cnt") >= F.col("total"), F.lit(0.0)).otherwise(pmi / -F.log2(pxy))
    out = x.select("w1", "w2", "cnt", pmi.alias("pmi"), npmi.alias("npmi"))
    return out.filter((F.col("pmi") >= min_pmi) & (F.col("npmi") >= min_npmi))


def broken_compounds(bigrams: DataFrame, words: DataFrame, min_compound: int = 100, min_split: int = 10, min_pmi: float = 2.0) -> DataFrame:
    """Pairs that together spell a word: (compound, part1, part2, compound_freq, split_freq, pmi); one a compound, the commonest split, ties by part1."""
    # most pairs spell no word: a bitmap of the words spares them, before they are counted where ``bigrams`` is an aggregation
    joined = words.filter(F.col("frequency") >= min_compound).select(F.col("word").alias("compound"), F.col("frequency").alias("compound_freq"))
    x = bigrams.filter(may_be_in(joined, ["compound"], F.concat("w1", "w2"))).filter(F.col("cnt") >= min_split)
    x = _with_frequency(x.withColumn("compound", F.concat("w1", "w2")).join(joined, "compound"), words)
    pmi = F.log2((F.col("cnt") / F.col("total")) / ((F.col("f1") / F.col("total")) * (F.col("f2") / F.col("total"))))
    x = x.withColumn("pmi", pmi).filter(F.col("pmi") >= min_pmi)
    first = F.row_number().over(Window.partitionBy("compound").orderBy(F.desc("cnt"), "w1"))
    return x.withColumn("n", first).filter("n = 1").select("compound", F.col("w1").alias("part1"), F.col("w2").alias("part2"), "compound_freq", F.col("cnt").alias("split_freq"), "pmi")


def register_tags(bigrams: DataFrame, formal: tuple[str, ...], informal: tuple[str, ...], min_total: int = 50, cut: float = 0.3) -> DataFrame:
    """(word, register, confidence, formal_count, informal_count) from the markers that stand beside each word, on either side."""
    kind = lambda c: F.when(F.col(c).isin(*formal), 1).when(F.col(c).isin(*informal), 0)
    near = bigrams.select(F.col("w1").alias("word"), kind("w2").alias("kind"), "cnt").unionByName(bigrams.select(F.col("w2").alias("word"), kind("w1").alias("kind"), "cnt"))
    near = near.filter(F.col("kind").isNotNull() & ~F.col("word").isin(*formal, *informal))
    n = near.groupBy("word").agg(F.sum(F.when(F.col("kind") == 1, F.col("cnt")).otherwise(0)).alias("formal_count"), F.sum(F.when(F.col("kind") == 0, F.col("cnt")).otherwise(0)).alias("informal_count"))
    total = F.col("formal_count") + F.col("informal_count")
    lean = (F.col("formal_count") - F.col("informal_count")) / (total + 1)
    register = F.when(lean >= cut, "formal").when(lean <= -cut, "informal").otherwise("neutral")
    return n.filter(total >= min_total).select("word", register.alias("register"), F.abs(lean).alias("confidence"), "formal_count", "informal_count")


def confusable_pairs(words: DataFrame, min_frequency: int = 50, max_ratio: float = 1000.0, max_length: int | None = 10) -> DataFrame:
    """(w1, w2, f1, f2, freq_ratio) of words one edit or swap apart, found through shared deletions; w1 < w2. Without ``max_length`` words of any length, by hashes of the deletions: those of a word take as long as the word."""
    keyed = words.filter(F.col("frequency") >= min_frequency)
    if max_length is not None:
        keyed = keyed.filter(F.length("word") <= max_length)
    keyed = keyed.select("word", "frequency", F.explode(deletion_hashes("word") if max_length is None else deletes(F.col("word"), 1, max_length)).alias("key"))
    a, b = keyed.toDF("w1", "f1", "key"), keyed.toDF("w2", "f2", "key")
    pairs = a.join(b, "key").filter("w1 < w2").select("w1", "w2", "f1", "f2").distinct()
    swapped = (F.length("w1") == F.length("w2")) & (F.array_sort(F.split("w1", "")) == F.array_sort(F.split("w2", "")))
    ratio = F.greatest("f1", "f2") / F.least("f1", "f2")
    edits = F.levenshtein("w1", "w2", 2)  # -1 above 2
    return pairs.filter(edits.between(0, 1) | (swapped & (edits == 2))).withColumn("freq_ratio", ratio).filter(ratio <= max_ratio)


def typed_confusables(words: DataFrame, variants, min_frequency: int = 50, max_ratio: float = 1000.0) -> DataFrame:
    """(w1, w2, type, freq_ratio) of words that a typed variant turns into one another; w1 <= w2."""
    known = words.filter(F.col("frequency") >= min_frequency)
    out = known.select("word", "frequency", F.inline(variants(F.col("word")))).join(known.toDF("variant", "variant_frequency"), "variant")
    ratio = F.greatest("frequency", "variant_frequency") / F.least("frequency", "variant_frequency")
    return out.filter(ratio <= max_ratio).select(F.least("word", "variant").alias("w1"), F.greatest("word", "variant").alias("w2"), "type", ratio.alias("freq_ratio")).distinct()


def left_context_cosine(pairs: DataFrame, bigrams: DataFrame) -> DataFrame:
    """(w1, w2, overlap): cosine of the counts of the words before each of the two; 0 without shared contexts."""
    left = bigrams.select(F.col("w2").alias("word"), F.col("w1").alias("left"), "cnt")
    norms = left.groupBy("word").agg(F.sqrt(F.sum(F.col("cnt") * F.col("cnt"))).alias("norm"))
    p = pairs.select("w1", "w2").distinct()
    x = p.join(left.toDF("w1", "left", "c1"), "w1").join(left.toDF("w2", "left", "c2"), ["w2", "left"]).groupBy("w1", "w2").agg(F.sum(F.col("c1") * F.col("c2")).alias("dot"))
    x = x.join(norms.toDF("w1", "n1"), "w1").join(norms.toDF("w2", "n2"), "w2")
    return p.join(x.select("w1", "w2", (F.col("dot") / (F.col("n1") * F.col("n2"))).alias("overlap")), ["w1", "w2"], "left").select("w1", "w2", F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both by key; columns in ``sums`` are added up, other columns of ``new`` win where they aren't null."""
    rest = [c for c in old.columns if c not in keys]
    joined = old.alias("o").join(new.alias("n"), keys, "full_outer")
    merged = [(F.coalesce(F.col(f"o.{c}"), F.lit(0)) + F.coalesce(F.col(f"n.{c}"), F.lit(0))).alias(c) if c in sums else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in rest]
    return joined.select(*keys, *merged)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` and those of ``new`` whose key it lacks."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))
