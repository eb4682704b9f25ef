"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key (md5 of seed and doc_id). Within a
source the keys are cut into ``buckets`` ranges; sizes are summed by (source, range), prefix
sums of those sums run over the ranges, and prefix sums inside each range complete a distributed
prefix sum, so that no task sorts a whole source. The document at
which the prefix sum passes the budget is taken in part, which makes each
source's taken words equal its target rounded down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import same, table

#: Relative weights by the rank of the source, repeating.
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Add ``target`` to (source, source_size): water-filling of share * all sizes by weight, stopped at most * source_size.

    The level at which the sources that have room stand is found by one
    prefix sum over the sources in order of most * size / weight. Rows: one a source.
    """
    known = F.array(*[F.lit(float(w)) for w in weights])
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    cap = F.col("source_size") * F.lit(most)
    ranked = sizes.withColumn("rank", rank).withColumn("weight", F.element_at(known, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("cap", cap)
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    filled = (
        ranked.withColumn("room", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("left_weight", F.sum("weight").over(every) - F.sum("weight").over(by_fill) + F.col("weight"))
        .withColumn("level", (F.col("room") - F.sum("cap").over(by_fill) + F.col("cap")) / F.col("left_weight"))
        .withColumn("stopped", F.col("level") * F.col("weight") >= F.col("cap"))
    )
    level = F.min(F.when(~F.col("stopped"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(every)["level"]
    return filled.withColumn("target", F.when(F.col("stopped"), F.col("cap")).otherwise(level * F.col("weight")).cast("double")).select("source", "source_size", "target")


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, buckets: int = 4096, seed: str = "mix", names: tuple[str, ...] = ("size", "source_size", "target", "taken")) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, source and any others) with those of ``names``, which take the place of columns of these names. See ``mix``."""
    every = [c for c in docs.columns if c.lower() not in names]
    # a row travels as one struct, so no name of its own can clash with a name of this plan
    sized = docs.select(F.struct(*every).alias("row"), F.col("source"), word_count(F.col("text")).alias("size"), _key(F.col("doc_id"), F.col("text"), seed).alias("key"))
    out = _placed(sized, weights, share, most, buckets)
    return out.select(*[F.col("row").getField(c).alias(c) for c in every], *names)


def _key(doc_id: Column, text: Column, seed: str) -> Column:
    """Hash-random key of a document: md5 of seed and doc_id; without a doc_id its text stands for it, so that rows without one don't meet in one place."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))))


def _placed(sized: DataFrame, weights: tuple[int, ...], share: float, most: float, buckets: int) -> DataFrame:
    """Rows of (row, source, size, key) with source_size, target and taken."""
    sized = sized.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("int"))
    ranges = sized.groupBy("source", "bucket").agg(F.sum("size").alias("range_size"))
    by_range = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("range_size").over(by_range), F.lit(0)))
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    offsets = same(ranges, goal, "source", "inner").select(F.col("source").alias("s"), F.col("bucket").alias("k"), "before", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("until", F.sum("size").over(inside))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("k")), "left")
    whole = F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0)).cast("long")
    rest = F.floor(F.col("target")).cast("long") - whole * F.col("source_size")
    part = F.least(F.greatest(rest - (F.col("before") + F.col("until") - F.col("size")), F.lit(0)), F.col("size"))
    return placed.select("row", "source", "size", "source_size", "target", (whole * F.col("size") + part).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, buckets: int = 4096, seed: str = "mix") -> DataFrame:
    """Return (doc_id, source, size, source_size, target, taken) for each row of ``docs`` (doc_id, text, source; other columns are ignored).

    Null text has size 0, null source is a source of its own (last), a null doc_id is placed by its text.
    Rows with equal doc_id are placed one after the other, by size. A document
    of size 0 takes 0. Without documents there are no rows. Takes no more than
    ``most`` times a document's size if ``most`` is whole.
    """
    sized = docs.select(F.struct("doc_id").alias("row"), "source", word_count(F.col("text")).alias("size"), _key(F.col("doc_id"), F.col("text"), seed).alias("key"))
    return _placed(sized, weights, share, most, buckets).select("row.doc_id", "source", "size", "source_size", "target", "taken")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS key
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM sizes),
weighted AS (
  SELECT *, CAST([3, 1, 2][1 + rank % 3] AS DOUBLE) AS weight, source_size * CAST(2.0 AS DOUBLE) AS cap FROM ranked),
filled AS (
  SELECT *, (1.5 * sum(source_size) OVER () - sum(cap) OVER f + cap) / (sum(weight) OVER () - sum(weight) OVER f + weight) AS level
  FROM weighted WINDOW f AS (ORDER BY cap / weight, rank ROWS UNBOUNDED PRECEDING)),
goal AS (
  SELECT source, source_size,
         CASE WHEN level * weight >= cap THEN cap
              ELSE weight * first_value(level) OVER (ORDER BY level * weight >= cap, cap / weight, rank) END AS target
  FROM filled),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, CAST(g.target AS DOUBLE) AS target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.size ROWS UNBOUNDED PRECEDING) - s.size AS before,
         CASE WHEN g.source_size > 0 THEN CAST(floor(g.target / g.source_size) AS BIGINT) ELSE 0 END AS whole
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(whole * size + least(greatest(floor(target) - whole * source_size - before, 0), size) AS BIGINT) AS taken
FROM placed
"""
