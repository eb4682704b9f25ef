"""Bitmaps of hashed keys: what spares rows that can't match from a shuffle, at a fixed size whatever the tables are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap (8 MB); longs of one that a task puts in order.
_BITS, _RUN = 1 << 26, 1024


def small(table: DataFrame, rows: int = 100_000) -> bool:
    return table.limit(rows + 1).count() <= rows


def members(table: DataFrame, keys: list[str], bits: int = _BITS):
    """A function of columns: true where they may be equal to a row of the keys of ``table``, and for each that is; else null or false. An exact join has to follow.

    The bitmap is one row of ``bits`` bits, so the condition is an expression that Spark can move below an aggregation or a join.
    """
    at = lambda cs: F.xxhash64(*cs).bitwiseAND(F.lit(bits - 1))
    h = at([F.col(k) for k in keys])
    words = table.select(F.shiftright(h, 6).alias("i"), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")).alias("b")).groupBy("i").agg(F.bit_or("b").alias("b"))
    every = table.sparkSession.range(bits // 64).toDF("i").join(words, "i", "left").na.fill(0, ["b"])
    runs = every.groupBy(F.floor(F.col("i") / _RUN).alias("r")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "b"))), lambda x: x["b"]).alias("b"))
    bitmap = runs.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("r", "b"))), lambda x: x["b"])).alias("b")).scalar()

    def has(*columns: Column | str) -> Column:
        own = at(columns)
        return F.call_function("shiftright", F.get(bitmap, F.shiftright(own, 6).cast("int")), own.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1

    return has


def may_be_in(table: DataFrame, keys: list[str], *columns: Column | str, bits: int = _BITS) -> Column:
    """``members`` for one set of columns."""
    return members(table, keys, bits)(*columns)
