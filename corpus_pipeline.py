"""Corpus pipeline: toxicity, line dedup, near-duplicates, benchmark decontamination, mixing.

Each stage takes the rows that its predecessor kept, with the columns of ``documents``; the last adds what the mix takes of each document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import fresh, same, shared_dir, store, table
from lexforge.llm.op1_decontaminate import judged
from lexforge.llm.op4_mix import mixed_rows
from lexforge.llm.op6_minhash import near_duplicates
from lexforge.llm.op8_lines import recurring_lines, recurring_long_lines, without_lines
from lexforge.llm.op10_toxicity import learn


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is predicted to be toxic go, each judged by its own text; null and empty texts stay."""
    score = fresh("score", docs)
    return learn(docs, table(spark, sf_dir, "labels")).scored(docs, score).filter(F.col(score) < 0.5).drop(score)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all but the first document; a document that loses all its words goes too. Others stay, also without words."""
    return _rest(docs, recurring_lines(docs))


def _rest(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The columns of ``docs`` without the lines ``gone``, and without documents that lost all their words."""
    rest, lines, dropped = names = tuple(fresh(x, docs) for x in ("kept_text", "n_lines", "n_dropped"))
    out = without_lines(docs, gone, names)
    kept = out.filter(~((F.col(dropped) > 0) & (F.col(dropped) >= F.col(lines))))
    new = {"text": F.col(rest)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(dropped) > 0, F.length(F.col(rest)).cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumns(new).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words, similarity 0.8): that with the least doc_id. Rows that share a doc_id are one document; rows without one stay.

    Near-duplicate search needs whole texts; of what it leaves, long lines that two documents share stay in the first only.
    """
    keep = fresh("keep", docs)
    verdict = near_duplicates(docs).groupBy("doc_id").agg(F.min("kept").alias(keep))
    left = store(same(docs, verdict, "doc_id").filter(F.col(keep)).select(*docs.columns))
    return _rest(left, recurring_long_lines(left))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold much of the benchmark go, each judged by its own text; texts without words stay."""
    mine, bad = fresh("id", docs), fresh("contaminated", docs)
    found = judged(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select(F.col("id").alias(mine)).distinct().withColumn(bad, F.lit(True))
    rows = docs.withColumn(mine, F.struct("doc_id", F.xxhash64("text").alias("hash")))
    return same(rows, found, mine).filter(F.col(bad).isNull()).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with the words that the mix takes of them: columns of documents, size, target (of the source) and taken; columns of these names give way to them."""
    return mixed_rows(docs, names=("size", "target", "taken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_recurring_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Levenshtein automata, a fitted model and MinHash can't be told in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
