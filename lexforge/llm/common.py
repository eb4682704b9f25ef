"""Session helpers: the shared folder, materialised steps, bounded bitmaps, null-safe joins, components."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import batches_of as batches_of
from .kernels import U64, as_long, bits_set, mix


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where that is unset (tests), a temporary one of this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexforge-"))
    return sc.getCheckpointDir().rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def store(df: DataFrame) -> DataFrame:
    """Write a step to the shared folder and read it again: later uses don't compute it twice, and a lost executor costs only a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/steps/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint(), with its folder set."""
    shared_dir(df.sparkSession)
    return df.checkpoint(True)


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with as many underscores behind it as it takes to be no column of the frames."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def same(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Equi-join in which null equals null; the right key goes."""
    k = fresh("_key", left, right)
    r = right.withColumnRenamed(key, k)
    out = left.join(r, left[key].eqNullSafe(r[k]), how)
    return out if how in ("left_semi", "left_anti") else out.drop(k)


def salted(big: DataFrame, small: DataFrame, keys: list[str], salts: int = 8) -> DataFrame:
    """Inner equi-join with a side of few rows a key; a key that much of ``big`` has is spread over ``salts`` tasks."""
    n = fresh("_salt", big, small)
    left = big.withColumn(n, F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    right = small.withColumn(n, F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [*keys, n]).drop(n)


def _mixed(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(as_long(mix(b.column(0).to_numpy().view(U64))))], ["at"])


#: A missing doc_id counts as the largest.
LAST = int(np.iinfo(np.int64).max)


def ids_bitmap(ids: DataFrame, most: int = 27):
    """Broadcast bitmap of a column of doc_ids; None without any."""
    ids = ids.select(F.coalesce(F.col(ids.columns[0]).cast("long"), F.lit(LAST)).alias("doc_id"))
    n = ids.count()
    if not n:
        return None
    return ids.sparkSession.sparkContext.broadcast(bitmap(ids.mapInArrow(_mixed, "at bigint"), "at", bitmap_bits(n, most=most)))


def repeated_ids(docs: DataFrame):
    """Broadcast bitmap of the doc_ids that several rows have; None without any. Where a bit is set by chance, rows are told apart that needn't be."""
    many = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    return ids_bitmap(store(many))


def tags_of(ids: np.ndarray, text_hash: np.ndarray, repeated) -> np.ndarray:
    """What tells rows of one doc_id apart: the hash of the text where several rows have the doc_id, else 0."""
    if repeated is None:
        return np.zeros(len(ids), np.int64)
    return np.where(bits_set(repeated.value, mix(ids.view(U64))), text_hash, 0)


def bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bitmap of 2**bits bits with the low bits of the 64-bit hashes in ``column``; what comes to the driver is 2**bits / 8 bytes, whatever the input."""
    at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1)) + 1
    parts = (
        df.select(at.alias("at"))
        .select(F.bitmap_bucket_number("at").alias("bucket"), F.bitmap_bit_position("at").alias("bit"))
        .repartition("bucket")
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    out = np.zeros(max(1 << bits, 32768) // 8, np.uint8)
    # up to 16 MB at once; a larger one partition by partition
    for bucket, part in parts.collect() if bits <= 27 else parts.toLocalIterator():
        lo = (bucket - 1) * 4096
        out[lo : lo + 4096] = np.frombuffer(bytes(part), np.uint8)
    return out[: max(1, (1 << bits) // 8)]


def bitmap_bits(rows: int, least: int = 18, most: int = 30) -> int:
    """Bits for a bitmap with about 16 bits a row, between bounds (2**30 bits are 128 MB)."""
    return min(most, max(least, math.ceil(math.log2(16 * max(rows, 1)))))


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component) of an undirected graph of distinct edges (a, b) of longs: component is the smallest node reachable.

    Alternating large-star and small-star steps; every step is one aggregation
    and one join on nodes, and every round is checkpointed. Isolated nodes have no row.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    seen = None
    for _ in range(most_rounds):
        # large star: neighbours greater than a node point to its least neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        # small star: smaller neighbours and the node point to its least neighbour
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = cut(
            small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = now
    raise RuntimeError("components did not settle")
