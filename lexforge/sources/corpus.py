"""Corpus files to (text, source), and back to files."""

from __future__ import annotations

import contextlib
import itertools
import os
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import for_ingestion, script_ratio

SUFFIXES = {"txt": "text", "csv": "csv", "tsv": "csv", "json": "json", "jsonl": "jsonl", "parquet": "parquet"}

#: A few sentences to try things with.
SAMPLE = ("မြန်မာစာသည် မြန်မာနိုင်ငံ၏ ဘာသာစကားဖြစ်သည်။", "ကျောင်းသားများ စာဖတ်ကြသည်။", "သူသည် ဈေးသို့ သွားသည်။")


#: Column types of SQLite; all others are text, structured ones as JSON.
SQLITE_TYPES = {"long": "INTEGER", "integer": "INTEGER", "short": "INTEGER", "byte": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}


def sample(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x, "sample") for x in SAMPLE], "text string, source string")


def read(spark: SparkSession, path: str, kind: str | None = None, column: str | int = "text", key: str = "text", recursive: bool = False, max_json_bytes: int = 500 << 20) -> DataFrame:
    """(text, source) of a file or folder; empty texts go, lines are stripped.

    ``column``: name or place of the column of CSV, TSV and Parquet; ``key``: of JSON objects. In JSON lines, lines that don't parse are skipped, values that
    aren't objects count as text, and an object without the key ends the read with an error. A whole JSON file may hold an array or one object; each file is one row, so larger ones than
    ``max_json_bytes`` are refused.
    """
    kind = kind or SUFFIXES.get(path.rstrip("/").rpartition(".")[2].lower(), "text")
    kind = SUFFIXES.get(kind, kind)
    tab = "\t" if path.lower().endswith(".tsv") or kind == "tsv" else ","
    r = spark.read.option("recursiveFileLookup", str(recursive).lower())
    source = F.col("_metadata.file_name").alias("source")
    if kind == "text":
        rows = r.text(path).select(F.col("value").alias("text"), source)
    elif kind == "parquet":
        frame = r.parquet(path)
        rows = frame.select(F.col(frame.columns[column] if isinstance(column, int) else column).cast("string").alias("text"), source)
    elif kind == "csv":
        named = not isinstance(column, int)
        frame = r.option("sep", tab).option("header", str(named).lower()).option("quote", '"').option("escape", '"').option("multiLine", "true").csv(path)
        rows = frame.select(F.col(f"`{column}`" if named else f"_c{column}").alias("text"), source)
    elif kind == "jsonl":
        lines = r.text(path).select(F.trim("value").alias("v"), source).filter("v <> ''")
        parsed = F.try_parse_json("v")
        value = F.try_variant_get(parsed, f"$.{key}", "string")
        is_object = F.schema_of_variant(parsed).startswith("OBJECT")
        text = F.when(is_object, F.coalesce(value, F.raise_error(F.concat(F.lit(f"no key {key} in: "), F.substring("v", 1, 80))))).otherwise(F.try_variant_get(parsed, "$", "string"))
        rows = lines.filter(parsed.isNotNull()).select(text.alias("text"), "source")
    elif kind == "json":
        files = r.format("binaryFile").load(path).select(F.col("content").cast("string").alias("v"), F.col("length"), F.element_at(F.split("path", "/"), -1).alias("source"))
        checked = F.when(F.col("length") > max_json_bytes, F.raise_error(F.lit("JSON file is too large; use JSON lines"))).otherwise(F.parse_json("v"))
        items = F.when(F.schema_of_variant(checked).startswith("ARRAY"), F.variant_get(checked, "$", "array<variant>")).otherwise(F.array(checked))
        one = files.select(F.explode(items).alias("x"), "source")
        is_object = F.schema_of_variant("x").startswith("OBJECT")
        rows = one.select(F.when(is_object, F.try_variant_get("x", f"$.{key}", "string")).otherwise(F.try_variant_get("x", "$", "string")).alias("text"), "source")
    else:
        raise ValueError(f"unknown kind {kind}")
    return rows.select(F.trim("text").alias("text"), "source").filter("text is not null and text <> ''")


def ingest(rows: DataFrame, min_ratio: float = 0.1, valid_word: Column | None = None) -> DataFrame:
    """Normal form, enough of the script, at least one valid word, first of equal texts by source."""
    out = rows.withColumn("text", for_ingestion(F.col("text"))).filter(script_ratio(F.col("text")) >= min_ratio)
    if valid_word is not None:
        out = out.withColumn("text", valid_word).filter("text <> ''")
    return out.groupBy("text").agg(F.min("source").alias("source"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """Ledger rows (path, mtime, size) of the files of a folder, contents unread."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def changed(now: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that are new or differ from the ledger in time or size."""
    return now.join(ledger, ["path", "mtime", "size"], "left_anti")


def removed(now: DataFrame, ledger: DataFrame) -> DataFrame:
    return ledger.join(now, "path", "left_anti")


def write_shards(rows: DataFrame, path: str, shards: int = 20) -> None:
    rows.repartition(shards).write.mode("overwrite").parquet(path)


def write_table(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet, or tab-separated with a header, or JSON lines."""
    w = rows.write.mode("overwrite")
    if kind == "parquet":
        w.parquet(path)
    elif kind == "tsv":
        w.option("sep", "\t").option("header", "true").csv(path)
    elif kind in ("json", "jsonl"):
        w.json(path)
    elif kind == "csv":
        w.option("header", "true").csv(path)
    elif kind == "text":
        rows.select(F.to_json(F.struct("*"))).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown kind {kind}")


def read_table(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """A dictionary table in any of the forms it is written in."""
    r = spark.read.schema(schema)
    if kind == "tsv":
        return r.option("sep", "\t").option("header", "true").csv(path)
    if kind == "csv":
        return r.option("header", "true").csv(path)
    return r.json(path) if kind in ("json", "jsonl") else r.parquet(path)


def write_sqlite(tables: dict[str, DataFrame], path: str, keys: dict[str, list[str]] | None = None, batch: int = 10_000) -> None:
    """One SQLite file of the tables, with an index on the keys of each; it replaces a file there.

    A file has one writer, the driver, which takes the rows partition by partition and never holds more than the largest one.
    The file is complete or not there: it is written under another name first.
    """
    part = f"{path}.part"
    if os.path.exists(part):
        os.remove(part)
    with contextlib.closing(sqlite3.connect(part)) as con:
        for name, rows in tables.items():
            cols = ", ".join(f"{_quoted(f.name)} {SQLITE_TYPES.get(f.dataType.typeName(), 'TEXT')}" for f in rows.schema)
            con.execute(f"CREATE TABLE {_quoted(name)} ({cols})")
            into = f"INSERT INTO {_quoted(name)} VALUES ({', '.join('?' * len(rows.columns))})"
            values = (tuple(r) for r in _flat(rows).toLocalIterator())
            while some := list(itertools.islice(values, batch)):
                con.executemany(into, some)
            if keys and keys.get(name):
                con.execute(f"CREATE INDEX {_quoted('by_' + name)} ON {_quoted(name)} ({', '.join(map(_quoted, keys[name]))})")
            con.commit()
    os.replace(part, path)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, batch: int = 100_000) -> DataFrame:
    """Rows of a table of a SQLite file that all executors see, read in ranges of row ids."""
    with contextlib.closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as con:
        least, most = con.execute(f"SELECT coalesce(min(rowid), 1), coalesce(max(rowid), 0) FROM {_quoted(table)}").fetchone()
    kind = spark.createDataFrame([], schema).schema
    ask = f"SELECT {', '.join(_quoted(c) for c in kind.names)} FROM {_quoted(table)} WHERE rowid BETWEEN ? AND ?"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = to_arrow_schema(kind)
        with contextlib.closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as con:
            for b in batches:
                for first in b.column(0).to_pylist():
                    got = con.execute(ask, (first, first + batch - 1)).fetchall()
                    cols = zip(*got, strict=True) if got else [[] for _ in form]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, form, strict=True)], schema=form)

    starts = spark.range(least, most + 1, batch, max(1, min(1000, (most - least) // batch + 1)))
    return starts.mapInArrow(rows, kind)


def _flat(rows: DataFrame) -> DataFrame:
    """Columns that SQLite has no type for as strings."""
    text = lambda c, kind: F.to_json(c) if kind in ("array", "map", "struct") else c.cast("string")
    cols = [(f.name, f.dataType.typeName(), F.col("`" + f.name.replace("`", "``") + "`")) for f in rows.schema]
    return rows.select(*[(c if kind in SQLITE_TYPES or kind == "string" else text(c, kind)).alias(name) for name, kind, c in cols])


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'
