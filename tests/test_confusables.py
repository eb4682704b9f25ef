"""Confusable words in context against the joins that they stand for, and against SQL where it has no cut of its own."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.functions.distance import deletes
from lexforge.operators import confusables, detect, enrich, exchange, ngrams, suggest
from lexforge.plans import checks

from .compare import plain, same

WORDS = ["the", "The", "of", "cat", "cot", "cut", "cart", "act", "é", "éé", "İx", "ΑΣ", "ΑΣΣ", "😀", "a" * 40, "a" * 39 + "b", *map(str, range(20))]


def rows_of(n, seed=3):
    random.seed(seed)
    return [(None if i == 7 else i, None if i % 31 == 5 else "".join(w + random.choice([" ", "\n", "  ", " \t"]) for w in random.choices(WORDS, [50, 20, 30, 9, 5, 3, 3, 2, *[2] * 28], k=random.choice([0, 1, 2, 30, 90])))) for i in range(n)]


def tables(docs):
    words = ngrams.token_counts(docs, T.words(F.col("text")))
    bigrams = ngrams.conditional(ngrams.ngram_counts(ngrams.windows(docs, T.words(F.col("text")), 2), 2))
    return words, enrich.confusable_pairs(words, 5, float("inf"), None), bigrams


def rows(df):
    return sorted((tuple(plain(x) for x in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("how", [{}, {"flush": 500, "bucket_bytes": 700}])
def test_as_joins(spark, how):
    docs = spark.createDataFrame(rows_of(120), "doc_id bigint, text string").coalesce(2)
    words, pairs, bigrams = tables(docs)
    sets = pairs.select(F.col("w1").alias("token"), F.col("w2").alias("other")).unionByName(pairs.select(F.col("w2").alias("token"), F.col("w1").alias("other")))
    near = detect.near_tokens(docs, "doc_id", "text", lower=True)
    want = rows(detect.homophones(near, "doc_id", sets, bigrams, 1.5).select("doc_id", "start", "end", "text", "fix", "confidence"))
    assert rows(confusables.homophones(docs, "doc_id", "text", pairs, 1.5, **how)) == want and len(want) > 100
    want = rows(suggest.statistical_confusables(bigrams.select(F.col("w1").alias("left"), F.col("w2").alias("word")), pairs, bigrams, 2.0))
    assert rows(confusables.statistical(docs, "text", words, pairs, 2.0, **how)) == want and len(want) > 20


def test_no_pairs(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    words, pairs, _ = tables(docs)
    assert confusables.homophones(docs, "doc_id", "text", pairs).count() == 0 and confusables.statistical(docs, "text", words, pairs).count() == 0


def test_probabilities_of_zero(spark):
    """Over 0 to six places a ratio is infinite, and above all NaN where both are 0; a partner that isn't there has its share of a millionth."""
    docs = spark.createDataFrame([(1, "the cat " + "the dog " * 2_100_000 + "the cut the cot the cot the cot")], "doc_id bigint, text string")
    words = ngrams.token_counts(docs, T.words(F.col("text")))
    pairs = enrich.confusable_pairs(words, 1, float("inf"), None).filter("w1 like 'c%' and w2 like 'c%'")
    got = {(r["left"], r["word"]): (str(r["ratio"]), r["variant"], r["confidence"]) for r in confusables.statistical(docs, "text", words, pairs).collect()}
    assert got["the", "cat"] == ("nan", "cut", 0.95) and got["the", "cut"] == ("nan", "cat", 0.95) and ("the", "cot") not in got


def test_statistical_confusables_of_any_length_and_ratio(spark, tmp_path):
    import duckdb

    text = "left abcdefghijkl " * 600 + "left abcdefghijkm " * 40 + "right abce " * 44_000 + "right abcf " * 40 + "wrong abcf wrong abce " + "wrong abce " * 30
    spark.createDataFrame([(1, text)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = checks.QUERIES["statistical_confusables"](spark, str(tmp_path))
    assert {(r["left"], r["word"], r["variant"]) for r in got.collect()} == {("left", "abcdefghijkm", "abcdefghijkl"), ("right", "abcf", "abce"), ("wrong", "abcf", "abce")}
    same(got, con, checks.SQL["statistical_confusables"])


def test_deletion_hashes_meet_where_deletions_do(spark):
    words = spark.createDataFrame([(w,) for w in ("a", "b", "ab", "ba", "abc", "bca", "aab", "éa", "é", "😀é", "aé", "ac")], "word string")
    pairs = enrich.confusable_pairs(words.withColumn("frequency", F.lit(9)), 1, 10.0, None).select("w1", "w2")
    k = words.select("word", F.explode(deletes(F.col("word"), 1, 10)).alias("key"))
    keyed = k.toDF("w1", "key").join(k.toDF("w2", "key"), "key").filter("w1 < w2").select("w1", "w2").distinct()
    anagram = (F.levenshtein("w1", "w2") == 2) & (F.array_sort(F.split("w1", "")) == F.array_sort(F.split("w2", "")))
    assert rows(pairs) == rows(keyed.filter((F.levenshtein("w1", "w2") <= 1) | anagram))


def test_other_order_is_an_error():
    words = pa.array(["b", "c"])
    sets = confusables.Sets(words, confusables.np.array([0]), confusables.np.array([1]), confusables.np.array([2, 2]))
    part = confusables._Part(pa.RecordBatch.from_pydict({"d": [1, 2], "low": ["a b", "b c"], "raw": pa.nulls(2, pa.string())}), sets, 1, True)
    answer = confusables._pack(*(confusables.np.array(x, kind) for x, kind in (([1, 1], "<u4"), ([1, 1], "<u4"), ([0, 0], "u1"), ([], "<i4"), ([], "<i4"), ([], "<u4"))))
    assert confusables._Told(part.left, [answer], part.left.check, sets, False).p.tolist() == [1_000_000, 1_000_000]
    with pytest.raises(ValueError, match="another order"):
        confusables._Told(part.left, [answer], part.left.check + 1, sets, False)


def test_tokens_in_pieces(monkeypatch):
    data, off = exchange._texts(pa.array(["a b", "", "c", "d  e"]))
    whole = exchange.tokens_in(data, off)
    monkeypatch.setattr(exchange, "_AT_ONCE", 1)
    assert all((x == y).all() for x, y in zip(whole, exchange.tokens_in(data, off), strict=True)) and len(whole[0]) == 5
