"""Check of documents against a dictionary: layers of error rows, fusion, and one response row a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import detect, fusion, suggest


def errors(docs: DataFrame, words: DataFrame, bigrams: DataFrame, doc: str = "doc_id", text: str = "text", compounds: DataFrame | None = None, homophones: DataFrame | None = None, level: str = "word", min_frequency: int = 1, distance: int = 1) -> DataFrame:
    """All error rows (doc, error_type, start, end, text, fix, confidence, priority) of the raw, word and context layers."""
    toks = detect.tokens(docs, doc, text).withColumn("token", F.lower("token"))
    out = detect.by_patterns(docs, doc, text).withColumn("priority", F.lit(1))
    asked = toks.select(F.col("token").alias("query")).distinct()
    best = suggest.rank(suggest.lookup(asked, words, distance, min_count=min_frequency), 1)
    out = out.unionByName(detect.unknown_words(toks, doc, words, best, min_frequency))
    near = detect.near_tokens(docs, doc, text, lower=True)
    if compounds is not None:
        out = out.unionByName(detect.broken_compounds(near, doc, compounds))
    if level == "context":
        out = out.unionByName(detect.unlikely(near, doc, bigrams))
        if homophones is not None:
            out = out.unionByName(detect.homophones(near, doc, homophones, bigrams))
    return out


def respond(docs: DataFrame, found: DataFrame, doc: str = "doc_id", text: str = "text", level: str = "word") -> DataFrame:
    """One row a document: (doc, text, corrected_text, has_errors, level, errors, metadata). Of overlapping errors the containing one stays, of equal spans that of the lowest priority."""
    kept = fusion.drop_contained(found, doc)
    act = fusion.action(F.col("error_type"), F.col("confidence"), ("context_probability",))
    one = kept.withColumn("action", act).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("start", "end", "fix", "action", "text", "error_type", "confidence"))).alias("errors"))
    x = docs.select(doc, text).join(one, doc, "left")
    empty = F.coalesce("errors", F.array().cast(x.schema["errors"].dataType))
    return x.withColumn("errors", empty).select(
        doc, F.col(text).alias("text"), fusion.corrected(F.coalesce(text, F.lit("")), F.col("errors")).alias("corrected_text"), (F.size("errors") > 0).alias("has_errors"), F.lit(level).alias("level"), "errors",
        F.create_map(F.lit("errors"), F.size("errors").cast("string")).alias("metadata"),
    )
