"""Probabilities that are 0 to six places, as pairs behind a word of some million uses have them."""

import math

from lexforge.operators import detect, suggest

P = [("the", "cat", 0.0), ("the", "cut", 0.0), ("the", "cot", 0.001), ("a", "cat", 0.1)]


def test_statistical_confusables(spark):
    bigrams = spark.createDataFrame(P, "w1 string, w2 string, probability double")
    pairs = spark.createDataFrame([("cat", "cot"), ("cat", "cut")], "w1 string, w2 string")
    got = suggest.statistical_confusables(spark.createDataFrame([("the", "cat"), ("the", "cot"), ("a", "cat")], "left string, word string"), pairs, bigrams).collect()
    # 0 over 0 is NaN, which SQL puts above all
    assert [(r["left"], r["word"], r["variant"], r["confidence"]) for r in got] == [("the", "cat", "cut", 0.95)] and math.isnan(got[0]["ratio"])


def test_homophones(spark):
    near = detect.near_tokens(spark.createDataFrame([(1, "the cat")], "doc_id bigint, text string"), "doc_id", "text")
    sets = spark.createDataFrame([("cat", "cot")], "token string, other string")
    got = detect.homophones(near, "doc_id", sets, spark.createDataFrame(P, "w1 string, w2 string, probability double")).collect()
    assert [(r["text"], r["fix"], r["confidence"]) for r in got] == [("cat", "cot", 0.95)]
