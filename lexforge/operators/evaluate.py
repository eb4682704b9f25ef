"""Metrics of detection and suggestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def detection(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, fpr over rows with booleans ``gold`` and ``found``."""
    g, f = F.col("gold"), F.col("found")
    out = rows.groupBy(*(by or [])).agg(F.count_if(g & f).alias("tp"), F.count_if(~g & f).alias("fp"), F.count_if(g & ~f).alias("fn"), F.count_if(~g & ~f).alias("tn"))
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = out.withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("fpr", _ratio(F.col("fp"), F.col("fp") + F.col("tn")))


def ranking(rows: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Mean reciprocal rank and top-k rates over ``rank`` (null: not suggested)."""
    return rows.agg(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), *[F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(f"top{k}") for k in ks])


def composite(f1, mrr, fpr, top1):
    return 0.35 * f1 + 0.30 * mrr + 0.20 * (1 - fpr) + 0.15 * top1


def percentile_at(rows: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(share, value): the value at place int(n * share) of the ascending list; found through the histogram of distinct values in ranges, not by one global sort."""
    h = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    lo_hi = h.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("total"))
    h = h.crossJoin(F.broadcast(lo_hi))
    width = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300))
    h = h.withColumn("bin", F.least(F.floor((F.col("v") - F.col("lo")) / width * 4096), F.lit(4095)))
    bins = h.groupBy("bin").agg(F.sum("n").alias("bin_n"))
    bins = bins.withColumn("before", F.coalesce(F.sum("bin_n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    h = h.join(F.broadcast(bins), "bin").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("bin").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    want = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    h = h.withColumn("share", want).withColumn("at", F.least(F.floor(F.col("total") * F.col("share")), F.col("total") - 1))
    return h.filter((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n"))).select("share", F.col("v").alias("value"))


def overlaps(gold: DataFrame, system: DataFrame) -> DataFrame:
    """(doc_id, gold_id, sys_id, overlap) of spans of a document that share a character."""
    x = gold.join(system, "doc_id").filter("gold_start < sys_end and sys_start < gold_end")
    return x.withColumn("overlap", F.least("gold_end", "sys_end") - F.greatest("gold_start", "sys_start"))


def greedy_match(pairs: DataFrame) -> DataFrame:
    """One system span at most for each gold span, in gold order; the largest overlap wins, the first of equal ones. Spans of one document go through one fold."""
    p = pairs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("gold_id", (-F.col("overlap")).alias("o"), "sys_id"))).alias("p"))
    taken = F.aggregate(
        "p",
        F.array().cast("array<struct<gold_id:bigint,sys_id:bigint>>"),
        lambda out, x: F.when(F.exists(out, lambda y: (y["gold_id"] == x["gold_id"]) | (y["sys_id"] == x["sys_id"])), out).otherwise(
            F.concat(out, F.array(F.struct(x["gold_id"].cast("bigint").alias("gold_id"), x["sys_id"].cast("bigint").alias("sys_id"))))
        ),
    )
    return p.select("doc_id", F.inline(taken))


def auroc(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, auroc, positives, negatives): the chance that a positive scores above a negative, ties half; null without both. Rows are counted by score first."""
    r = rows.groupBy(*by, "score").agg(F.count_if("gold").alias("p"), F.count_if(~F.col("gold")).alias("q"))
    below = F.sum("q").over(Window.partitionBy(*by).orderBy("score")) - F.col("q")
    r = r.withColumn("won", F.col("p") * (below + F.col("q") / 2.0))
    n = F.sum("p") * F.sum("q")
    return r.groupBy(*by).agg((F.sum("won") / F.when(n > 0, n)).alias("auroc"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))


def standard(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, mean, deviation, n): what a z-score needs."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.count("*").alias("n"))


def compare(old: DataFrame, new: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Metrics of two runs side by side, with their change."""
    a = old.select(*by, *[F.col(m).cast("double").alias(f"{m}_old") for m in metrics])
    b = new.select(*by, *[F.col(m).cast("double").alias(f"{m}_new") for m in metrics])
    x = a.join(b, by)
    return x.select(*by, *[c for m in metrics for c in (F.col(f"{m}_old"), F.col(f"{m}_new"), (F.col(f"{m}_new") - F.col(f"{m}_old")).alias(f"{m}_change"))])
