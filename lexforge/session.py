"""Session settings for analytics on text."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "lexforge", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution; ``master`` and ``shuffle_partitions`` only where the cluster doesn't set them."""
    b = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def kept(df: DataFrame) -> DataFrame:
    """Write a step to the folder that all executors share (``spark.checkpoint.dir``; where that is unset, on one machine, a temporary one) and read it again."""
    spark = df.sparkSession
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lexforge-")
    path = f"{path.rstrip('/')}/steps/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for what is run inside, so that neither side holds tens of MB of texts at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
