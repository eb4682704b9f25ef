"""Checks over streams of lines. The batch functions of DataFrames to DataFrames run unchanged on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T


def lines(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Streaming (text, source) of the text files that arrive in a folder; the number of files at a time bounds the memory."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return rows.select(F.trim("value").alias("text"), F.col("_metadata.file_name").alias("source")).filter("text <> ''")


def check(stream: DataFrame, check_lines: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, kind: str = "parquet") -> StreamingQuery:
    """Write what ``check_lines`` makes of each micro-batch to ``sink``, all that has arrived, then stop. A batch that runs again replaces its own folder."""

    def batch(rows: DataFrame, epoch: int) -> None:
        check_lines(rows).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").format(kind).save(f"{sink}/epoch={epoch:08d}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sentences(stream: DataFrame, text: str = "text") -> DataFrame:
    """Each line as its sentences (n from 0, sentence); the other columns stay."""
    return stream.select(*[c for c in stream.columns if c != text], F.posexplode(T.sentences(F.col(text))).alias("n", "sentence"))


def isolated(check_one: Callable[[str], object], kind: str) -> Callable[[Column | str], Column]:
    """A check of one text as a column of (value, error): a text whose check fails has the failure there and stops neither its batch nor the stream; null has neither."""

    @F.pandas_udf(f"value {kind}, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows: list[tuple[object, str | None]] = []
        for x in texts:
            try:
                rows.append((None if x is None else check_one(x), None))
            except Exception as e:  # noqa: BLE001 - any failure is the result of its row
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame({"value": pd.Series([v for v, _ in rows], dtype=object), "error": [e for _, e in rows]})

    return run


def with_context(stream: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text", n: int = 100) -> DataFrame:
    """Streaming (key, order, text, context): the last n characters of the line before in the same sequence, kept as state between batches.

    Lines of a sequence must arrive in order; a line without one before has an empty context.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else ""
        rows = pd.concat(list(frames)).sort_values(order)
        before = [last, *rows[text].fillna("").str[-n:].tolist()]
        state.update((before[-1],))
        yield pd.DataFrame({key: k[0], order: rows[order].values, text: rows[text].values, "context": before[:-1]})

    kinds = dict(stream.dtypes)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {text} string, context string"
    return stream.select(key, order, text).groupBy(key).applyInPandasWithState(step, schema, "last string", "append", GroupStateTimeout.NoTimeout)


def progress(query: StreamingQuery) -> dict[str, float]:
    """Batches and lines so far, and lines a second of the last batch."""
    seen = query.recentProgress
    return {"batches": len(seen), "lines": sum(p["numInputRows"] for p in seen), "lines_per_second": (seen[-1].get("processedRowsPerSecond") or 0.0) if seen else 0.0}
