"""Building a dictionary: corpus rows to the tables of ``schema.DICTIONARY``, each a pure function of DataFrames, written stage by stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import enrich, ngrams

#: Minimum counts of syllables, words, bigrams and trigrams.
ENRICHED = ("collocations", "compound_confusions", "register_tags")
LEAST = {"syllables": 1, "words": 50, "bigrams": 10, "trigrams": 20}


def segment(corpus: DataFrame, words: Column, syllables: Column) -> DataFrame:
    """(text, source, syllables, words, syllable_count, word_count)."""
    x = corpus.select("text", "source", syllables.alias("syllables"), words.alias("words"))
    return x.withColumn("syllable_count", F.size("syllables")).withColumn("word_count", F.size("words"))


def tables(segmented: DataFrame, quality: Column | None = None, blacklist: tuple[str, ...] = (), curated: DataFrame | None = None, least: dict[str, int] = LEAST) -> dict[str, DataFrame]:
    """Tables syllables, words, bigrams and trigrams. ``quality``: predicate on ``word``; n-grams hold quality words only, before the minimum count of words."""
    counted = ngrams.token_counts(segmented, F.col("words"), 1, blacklist)
    good = counted.filter(quality) if quality is not None else counted
    words = ngrams.token_counts(segmented, F.col("words"), least["words"], blacklist, curated)
    if quality is not None:
        words = words.filter(quality)
    windows = ngrams.windows(segmented, F.col("words"), 3, blacklist)
    vocabulary = good if quality is not None else None
    return {
        "syllables": ngrams.token_counts(segmented, F.col("syllables"), least["syllables"]).withColumnRenamed("word", "syllable"),
        "words": words,
        "bigrams": ngrams.conditional(ngrams.ngram_counts(windows, 2, least["bigrams"], vocabulary)),
        "trigrams": ngrams.conditional(ngrams.ngram_counts(windows, 3, least["trigrams"], vocabulary)),
    }


def package(made: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """N-grams whose words are all in the dictionary; probabilities stay as they are."""
    known = made["words"].select("word")
    out = dict(made)
    for name, n in (("bigrams", 2), ("trigrams", 3)):
        x = made[name]
        for i in range(1, n + 1):
            x = x.join(known.withColumnRenamed("word", f"w{i}"), f"w{i}", "left_semi")
        out[name] = x.select(*made[name].columns)
    return out


def enrichment(made: dict[str, DataFrame], formal: tuple[str, ...] = (), informal: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    out = {"collocations": enrich.collocations(made["bigrams"], made["words"]), "compound_confusions": enrich.broken_compounds(made["bigrams"], made["words"])}
    if formal and informal:
        out["register_tags"] = enrich.register_tags(made["bigrams"], formal, informal)
    return out


def build(spark: SparkSession, segmented: DataFrame, path: str, **options) -> dict[str, DataFrame]:
    """Write each table under ``path`` unless it is there whole already, and return what was written; a build that stopped goes on at the first missing table."""
    made = package(tables(segmented, **options))
    done: dict[str, DataFrame] = {}
    for name, df in made.items():
        done[name] = _once(spark, df, f"{path}/{name}")
    for name, df in enrichment(done).items():
        done[name] = _once(spark, df, f"{path}/{name}")
    return done


def _once(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merge(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Counts of the tables of both builds (those of ``new``) added up; probabilities are taken anew over the sums, and enrichment from the merged words and bigrams."""
    out = {}
    for name in new:
        value = next((c for c in ("cnt", "frequency") if c in old[name].columns), None)
        if value is None or name in ENRICHED:
            continue
        key = [c for c in old[name].columns if c not in ("cnt", "probability", "frequency")]
        summed = enrich.upsert(old[name].select(*key, value), new[name].select(*key, value), key, (value,))
        out[name] = ngrams.conditional(summed) if "probability" in old[name].columns else summed
    if any(name in ENRICHED for name in new) and {"words", "bigrams"} <= set(out):
        out |= {name: df for name, df in enrichment(out).items() if name in new}
    return out
