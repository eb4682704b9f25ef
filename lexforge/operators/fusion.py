"""Fusion, gates, suppression and correction of error rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def calibrate(x: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear map through the points, constant outside of them."""
    points = sorted(points)
    out = F.when(x <= points[0][0], F.lit(points[0][1]))
    for (a, ya), (b, yb) in zip(points, points[1:], strict=False):
        out = out.when(x <= b, ya + (x - a) * ((yb - ya) / (b - a)))
    return out.otherwise(F.lit(points[-1][1]))


def noisy_or(errors: DataFrame, keys: list[str], cluster: str = "cluster", confidence: str = "confidence") -> DataFrame:
    """(keys, fused, clusters): 1 - product of (1 - best of each cluster)."""
    best = errors.groupBy(*keys, cluster).agg(F.max(confidence).alias("best"))
    rest = F.aggregate(F.array_sort(F.collect_list("best")), F.lit(1.0), lambda s, x: s * (1 - x))
    return best.groupBy(*keys).agg((1 - rest).alias("fused"), F.count("*").alias("clusters"))


def arbiter(errors: DataFrame, keys: list[str]) -> DataFrame:
    """The winner of each place: highest tier, then confidence, then the first (``idx``)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("tier"), F.desc("confidence"), "idx")
    return errors.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def first_by_priority(errors: DataFrame, keys: list[str]) -> DataFrame:
    """The error of the lowest priority at each place, with the suggestions of all."""
    w = Window.partitionBy(*keys)
    every = F.array_distinct(F.flatten(F.collect_list("suggestions").over(w.orderBy("priority", "idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    rank = F.row_number().over(w.orderBy("priority", "idx"))
    return errors.withColumn("all_suggestions", every).withColumn("n", rank).filter("n = 1").withColumn("suggestions", F.col("all_suggestions")).drop("n", "all_suggestions")


def logistic(features: Column, coefficients: list[float], intercept: float) -> Column:
    """Sigmoid of the dot product; 0.5 if the number of features is wrong."""
    coef = F.array(*[F.lit(float(c)) for c in coefficients])
    dot = F.aggregate(F.zip_with(features, coef, lambda a, b: a * b), F.lit(float(intercept)), lambda s, x: s + x)
    return F.when(F.size(features) == len(coefficients), 1 / (1 + F.exp(-dot))).otherwise(F.lit(0.5))


def gate(errors: DataFrame, doc: str, thresholds: dict[str, float], default: float = 0.5, second: dict[str, float] | None = None) -> DataFrame:
    """Errors at or above their type's threshold, and at or above a second one where another type of the document is more confident."""
    bar = F.lit(default)
    for kind, t in thresholds.items():
        bar = F.when(F.col("error_type") == kind, F.lit(t)).otherwise(bar)
    passed = errors.filter(F.col("confidence") >= bar)
    best = passed.groupBy(doc, "error_type").agg(F.max("confidence").alias("m"))
    top = Window.partitionBy(doc).orderBy(F.desc("m"), "error_type")
    two = best.withColumn("r", F.row_number().over(top)).filter("r <= 2").groupBy(doc).agg(F.max(F.when(F.col("r") == 1, F.struct("error_type", "m"))).alias("a"), F.max(F.when(F.col("r") == 2, F.col("m"))).alias("b"))
    other = F.when(F.col("a.error_type") != F.col("error_type"), F.col("a.m")).otherwise(F.col("b"))
    bar2 = F.lit(0.0)
    for kind, t in (second or {}).items():
        bar2 = F.when(F.col("error_type") == kind, F.lit(t)).otherwise(bar2)
    return passed.join(two, doc).filter(~(F.coalesce(other > F.col("confidence"), F.lit(False)) & (F.col("confidence") < bar2))).drop("a", "b")


def action(kind: Column, confidence: Column, inform: tuple[str, ...] = (), fix: float = 0.9) -> Column:
    return F.when(kind.isin(*inform) if inform else F.lit(False), "INFORM").when(confidence >= fix, "AUTO_FIX").otherwise("SUGGEST")


def drop_contained(errors: DataFrame, doc: str) -> DataFrame:
    """Errors whose span another, longer one of the document contains go; of equal spans the one of the lowest priority stays."""
    # spans sorted by start, longest first: a span is contained if one before it ends at or behind its end
    w = Window.partitionBy(doc).orderBy("start", F.desc("end"), "priority").rowsBetween(Window.unboundedPreceding, -1)
    return errors.withColumn("reach", F.max("end").over(w)).filter("reach is null or reach < end").drop("reach")


def corrected(text: Column, errors: Column) -> Column:
    """Text with the suggestion (``fix``) of each of the errors (start, end, fix, action) put in, from left to right; overlapping, informing and empty ones are skipped."""
    ordered = F.array_sort(F.filter(errors, lambda e: e["fix"].isNotNull() & (e["action"] != "INFORM")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda s, e: F.when(
        e["start"] >= s["at"],
        F.struct(F.concat(s["out"], F.substring(text, s["at"] + 1, e["start"] - s["at"]), e["fix"]).alias("out"), e["end"].alias("at")),
    ).otherwise(s)
    return F.aggregate(ordered, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def previous_context(rows: DataFrame, key: str, order: str, text: str, n: int = 100) -> DataFrame:
    """Add ``context``: the last n characters of the text before, in the same sequence, and ``shift``: how far positions move."""
    before = F.coalesce(F.lag(text).over(Window.partitionBy(key).orderBy(order)), F.lit(""))
    return rows.withColumn("context", F.right(before, F.lit(n))).withColumn("shift", F.length("context"))
