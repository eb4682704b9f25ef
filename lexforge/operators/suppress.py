"""Suppression, merging and boosting of error spans (doc, error_type, start, end, confidence, priority), by windows inside a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a bin in which spans meet.
_BIN = 64


def _order(doc: str) -> Window:
    return Window.partitionBy(doc).orderBy("start", "end", "error_type")


def near_others(errors: DataFrame, doc: str, kinds: tuple[str, ...], others: tuple[str, ...], gap: int = 1) -> DataFrame:
    """Errors of ``kinds`` within ``gap`` characters of an error of ``others`` go: fragments beside what they come from."""
    other = F.col("error_type").isin(*others)
    before = F.max(F.when(other, F.col("end"))).over(_order(doc).rowsBetween(Window.unboundedPreceding, -1))
    behind = F.min(F.when(other, F.col("start"))).over(_order(doc).rowsBetween(1, Window.unboundedFollowing))
    x = errors.withColumns({"_before": before, "_behind": behind})
    close = (F.coalesce(F.col("start") - F.col("_before") <= gap, F.lit(False))) | (F.coalesce(F.col("_behind") - F.col("end") <= gap, F.lit(False)))
    return x.filter(~(F.col("error_type").isin(*kinds) & close)).drop("_before", "_behind")


def placeholders(errors: DataFrame, doc: str, kinds: tuple[str, ...]) -> DataFrame:
    """Errors of general ``kinds`` go where one of another kind begins at the same place."""
    other = F.max((~F.col("error_type").isin(*kinds)).cast("int")).over(Window.partitionBy(doc, "start"))
    return errors.withColumn("_other", other).filter(~(F.col("error_type").isin(*kinds) & (F.col("_other") == 1))).drop("_other")


def low_value(errors: DataFrame, words: DataFrame, rules: DataFrame) -> DataFrame:
    """Errors go that a rule (kind, min_frequency, max_confidence, without_fix) calls of low value: on a word that frequent, no more confident than that and, if asked, without a fix."""
    r = rules.select(F.col("kind").alias("error_type"), "min_frequency", "max_confidence", "without_fix")
    f = words.select(F.col("word").alias("text"), "frequency")
    x = errors.join(r, "error_type", "left").join(f, "text", "left")
    low = (F.coalesce("frequency", F.lit(0)) >= F.col("min_frequency")) & (F.col("confidence") <= F.col("max_confidence")) & (~F.col("without_fix") | F.col("fix").isNull())
    return x.filter(~F.coalesce(low, F.lit(False))).select(*errors.columns)


def boost(errors: DataFrame, doc: str, kinds: tuple[str, ...], around: tuple[str, ...], by: float = 0.05) -> DataFrame:
    """Errors of ``kinds`` inside a span of ``around`` become more confident."""
    upto = Window.partitionBy(doc).orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("error_type").isin(*around), F.col("end"))).over(upto)
    inside = F.col("error_type").isin(*kinds) & (F.col("_reach") >= F.col("end"))
    return errors.withColumn("_reach", reach).withColumn("confidence", F.when(inside, F.least(F.col("confidence") + by, F.lit(1.0))).otherwise(F.col("confidence"))).drop("_reach")


def overlaps(errors: DataFrame, doc: str, better: tuple[Column, ...] | None = None) -> DataFrame:
    """Errors that share a character with a better one go: a lower priority, then a longer span, then the first by place and type. Spans meet in bins, so a long document is no product of its errors."""
    rank = [F.col("priority"), F.col("start") - F.col("end"), F.col("start"), F.col("error_type")]
    x = errors.withColumn("_rank", F.struct(*rank))
    bins = F.explode(F.sequence(F.floor(F.col("start") / _BIN), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / _BIN)))
    mine = x.select(doc, "start", "end", "_rank", bins.alias("_bin"))
    other = mine.select(F.col(doc).alias("_d"), F.col("_bin").alias("_b"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("_rank").alias("_r"))
    hit = mine.join(other, (F.col(doc) == F.col("_d")) & (F.col("_bin") == F.col("_b")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")) & (F.col("_r") < F.col("_rank")), "left_semi")
    return x.join(hit.select(doc, "_rank").distinct(), [doc, "_rank"], "left_anti").select(*errors.columns)


def merge_spans(errors: DataFrame, doc: str) -> DataFrame:
    """(doc, error_type, start, end, n): errors of one kind that overlap or touch are one."""
    w = Window.partitionBy(doc, "error_type").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = errors.withColumn("_new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    x = x.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(doc, "error_type", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_run")


def place_features(errors: DataFrame, doc: str) -> DataFrame:
    """Add ``gap``: characters since the end of the error before (null for the first), and ``share``: the error's number over all of the document."""
    w = _order(doc)
    n, every = F.row_number().over(w), F.count("*").over(Window.partitionBy(doc))
    return errors.withColumns({"gap": F.col("start") - F.lag("end").over(w), "share": n / every})
