"""Judgements by packed pairs against the joins that they stand for."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import detect, exchange, ngrams
from lexforge.plans.myanmar import QUERIES

from .compare import SF


def rows_of(n, seed=3):
    random.seed(seed)
    words = ["the", "The", "of", "İx", "ß", "ΑΣ", "😀", "é", *map(str, range(40))]
    weights = [200, 20, 100, 3, 3, 3, 3, 3, *[2] * 40]
    return [(None if i % 50 == 7 else i % 90, None if i % 31 == 5 else "".join(w + random.choice([" ", "\n", "  ", " \t"]) for w in random.choices(words, weights, k=random.choice([0, 1, 2, 30, 90])))) for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"flush": 500, "bucket_bytes": 700}, {"flush": 2000, "bucket_bytes": 3000, "hot_share": 1e-9}])
def test_unlikely(spark, how, monkeypatch):
    docs = spark.createDataFrame(rows_of(150), "doc_id bigint, text string").coalesce(2)
    if "hot_share" in how:  # all words are common ones
        monkeypatch.setattr(exchange, "_common", lambda rows, share: exchange.np.unique(exchange.Part(pa.RecordBatch.from_pandas(rows.toPandas()), 1, exchange.np.zeros(0, exchange.U64)).hash))
    near = detect.near_tokens(docs, "doc_id", "text", lower=True)
    bigrams = ngrams.conditional(ngrams.ngram_counts(ngrams.windows(docs, T.words(F.col("text")), 2), 2, 2))
    want = detect.unlikely(near, "doc_id", bigrams, 0.02).select("doc_id", "start", "end", "text")
    got = exchange.unlikely(docs, "doc_id", "text", 2, 0.02, **how)
    have = sorted(map(tuple, got.collect()), key=repr)
    assert have == sorted(map(tuple, want.collect()), key=repr) and len(have) > 100


def test_query_shuffles_no_tokens(spark):
    plan = QUERIES["context_probability_errors"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_other_order_is_an_error():
    part = exchange.Part(pa.RecordBatch.from_pydict({"d": [1, 2], "low": ["a b", "b c"], "raw": pa.nulls(2, pa.string())}), 3, exchange.np.zeros(0, exchange.U64))
    with pytest.raises(ValueError, match="another order"):
        part.met(exchange.np.zeros(2, "<i4"), part.check + 1)
