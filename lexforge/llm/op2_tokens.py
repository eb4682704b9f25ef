"""Token counts with a digest cache.

The cache is a table (tokenizer, digest, n_tokens). A document's key is the SHA-256 of its normalised
content and the SHA-256 of the tokenizer's file. Known keys are joined; of the others one document each is
encoded, and the new counts are appended to the cache.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, shared_dir, store, table

#: White space around a space: where a text must not be cut before that space.
_BLURRED = re.compile(r"\s \s|\s \Z")
#: Distinct pieces that a worker remembers.
_PIECES = 100_000
#: Texts, and new pieces, that are encoded at a time.
_TEXTS, _NEW = 64, 1024
_workers: dict[str, object] = {}


class _Counter:
    """Counts tokens of texts with the tokenizer's own library, remembering pieces.

    A byte-level vocabulary that splits off words with a space in front (and so never joins across
    "non-space, space") lets a text be cut before such spaces and its pieces be counted one by one; texts in which
    white space touches a space, or that hold a special token's string, and all other tokenizers go to the library whole.
    """

    def __init__(self, path: str) -> None:
        self.known: dict[str, int] = {}
        self.specials: list[str] = []
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.cuts, self.encode = False, lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            # a task has one core; the library's threads would each keep freed memory of their own
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer, pre_tokenizers

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            self.specials = [x.content for x in t.get_added_tokens_decoder().values()]
            self.cuts = t.normalizer is None and isinstance(t.pre_tokenizer, pre_tokenizers.ByteLevel) and not t.pre_tokenizer.add_prefix_space and t.pre_tokenizer.use_regex
            self.encode = lambda texts: [len(x.ids) for x in t.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.cuts:
            return [self.encode([x])[0] for x in texts]
        out = [0] * len(texts)
        odd = {i for i, x in enumerate(texts) if _BLURRED.search(x) or any(s in x for s in self.specials)}
        for i in odd:  # one at a time: an encoding is much larger than its text
            out[i] = self.encode([texts[i]])[0]
        for lo in range(0, len(texts), _TEXTS):
            cut = {i: texts[i].split(" ") for i in range(lo, min(lo + _TEXTS, len(texts))) if i not in odd}
            firsts = {i: parts.pop(0) for i, parts in cut.items()}
            new = list(set().union(*cut.values()).difference(self.known))
            if len(self.known) + len(new) > _PIECES:
                self.known.clear()
                new = list(set().union(*cut.values()))
            for at in range(0, len(new), _NEW):
                part = new[at : at + _NEW]
                self.known.update(zip(part, self.encode([" " + x for x in part]), strict=True))
            for (i, parts), n in zip(cut.items(), self.encode(list(firsts.values())), strict=True):
                out[i] = n + sum(map(self.known.__getitem__, parts))
        return out


def _encode(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if version not in _workers:
            _workers[version] = _Counter(path)
        counter = _workers[version]
        for b in batches:
            counts: list[int] = []
            for lo in range(0, b.num_rows, 8 * _TEXTS):
                counts += counter.count([x or "" for x in b.column(1).slice(lo, 8 * _TEXTS).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def tokenizer_version(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 512) -> DataFrame:
    """Return (doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs`` (doc_id, text).

    ``tokenizer``: a file that every executor has, .json (tokenizers) or .model (sentencepiece). ``cache``:
    folder of the table of counts, made if missing; without one a new one in the shared folder is used. The normal form of a text is
    the text itself (null is empty), as any change could change its count. Equal texts are encoded once; rows with equal or null doc_id
    are rows of their own. Other columns are ignored.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    cache = cache or f"{shared_dir(spark)}/token_counts/{uuid.uuid4().hex}"
    schema = "tokenizer string, digest binary, n_tokens bigint"
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = store(keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"))
    spark.createDataFrame([], schema).write.mode("append").parquet(cache)
    known = spark.read.schema(schema).parquet(cache).filter(F.col("tokenizer") == version).select("digest", "n_tokens")
    missing = rows.join(known, "digest", "left_anti").groupBy("digest").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(0)))).alias("x")).select("digest", F.col("x.col1").alias("one"))
    chosen = keyed.withColumn("one", F.coalesce("doc_id", F.lit(0))).join(missing, ["digest", "one"]).select("digest", "text")
    counted = chosen.mapInArrow(_encode(tokenizer, version), "digest binary, n_tokens bigint").groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    with batches_of(spark, 500):
        counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    known = spark.read.schema(schema).parquet(cache).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    return rows.join(known, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
