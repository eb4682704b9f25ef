"""Bitmaps of keys: no row that matches is lost, and few others stay."""

from pyspark.sql import functions as F

from lexforge.functions.bits import may_be_in
from lexforge.operators import detect, enrich, ngrams


def test_may_be_in(spark):
    table = spark.range(3000).select((F.col("id") * 7).cast("string").alias("k"), F.col("id").alias("n"))
    rows = spark.range(30_000).select(F.col("id").cast("string").alias("x"))
    got = {int(r[0]) for r in rows.filter(may_be_in(table, ["k"], "x")).collect()}
    assert set(range(0, 21_000, 7)) <= got and len(got) < 3100
    assert rows.filter(may_be_in(table.filter("n < 0"), ["k"], "x")).count() == 0
    # a bitmap with hardly a free bit keeps everything that matches, too
    assert {int(r[0]) for r in rows.filter(may_be_in(table, ["k"], "x", bits=1 << 16)).collect()} >= set(range(0, 21_000, 7))
    assert spark.createDataFrame([(None,)], "x string").filter(may_be_in(table, ["k"], "x")).count() <= 1


def test_pairs_are_spared_before_they_are_counted(spark):
    docs = spark.createDataFrame([("a b ab c",), ("a b c ab",)], "text string").select(F.split("text", " ").alias("t"))
    words = ngrams.token_counts(docs, F.col("t"))
    pairs = ngrams.ngram_counts(ngrams.windows(docs, F.col("t"), 2), 2)
    got = enrich.broken_compounds(pairs, words, 2, 1, -9.0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate [w1") :]
    assert "xxhash64" in below and [tuple(r[:5]) for r in got.collect()] == [("ab", "a", "b", 2, 2)]


def test_hidden_compounds_spare_tokens(spark):
    near = detect.near_tokens(spark.createDataFrame([(1, "a b c"), (2, "b a")], "doc_id bigint, text string"), "doc_id", "text")
    words = spark.createDataFrame([("ab", 9), ("a", 2), ("b", 9), ("bc", 1)], "word string, frequency bigint")
    got = detect.hidden_compounds(near, "doc_id", words, 2.0)
    assert "xxhash64" in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["doc_id"], r["start"], r["end"], r["fix"]) for r in got.collect()] == [(1, 0, 3, "ab")]


def test_rule_tables_shuffle_no_tokens(spark):
    near = detect.near_tokens(spark.createDataFrame([(1, "the and the"), (2, "and")], "doc_id bigint, text string"), "doc_id", "text")
    rules = spark.createDataFrame([("the", None, "and", "x", 0.5), ("and", "the", None, "y", 0.5)], "token string, left string, right string, fix string, confidence double")
    got = detect.by_table(near, "doc_id", rules, "rule", 1)
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["doc_id"], r["start"], r["fix"]) for r in got.collect()) == [(1, 0, "x"), (1, 4, "y")]


def test_entities_shuffle_no_errors(spark):
    errors = spark.range(3).select(F.concat(F.lit("t"), "id").alias("text"), "id")
    got = detect.drop_entities(errors, spark.createDataFrame([("t1",)], "entity string"))
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString() and sorted(r["id"] for r in got.collect()) == [0, 2]


def test_questions_and_tones_without_windows_over_tokens(spark):
    docs = spark.createDataFrame([(1, "who goes"), (2, "he goe"), (None, "who run"), (3, "run who"), (4, None)], "doc_id bigint, text string")
    near = detect.near_tokens(docs, "doc_id", "text")
    for toks in (near, detect.tokens(docs, "doc_id", "text")):
        got = detect.question_ends(toks, "doc_id", ("who",), ("e", "s"))
        assert sorted((str(r["doc_id"]), r["text"], r["fix"]) for r in got.collect()) == [("3", "who", "whoe"), ("None", "run", "rune")]
    assert "Window" not in detect.question_ends(near, "doc_id", ("who",), ("e", "s"))._jdf.queryExecution().optimizedPlan().toString()
    words = spark.createDataFrame([("ကား", 100), ("က", 1), ("က့", 50)], "word string, frequency bigint")
    toks = detect.tokens(spark.createDataFrame([(1, "ကား က က့ က"), (2, "က")], "doc_id bigint, text string"), "doc_id", "text")
    got = detect.tone_probes(toks, "doc_id", words, 20.0)
    assert sorted((r["doc_id"], r["start"], r["fix"]) for r in got.collect()) == [(1, 4, "က့"), (1, 9, "က့"), (2, 0, "က့")]
    assert "_w0" not in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "windowspecdefinition(doc_id" not in plan


def test_unknown_words_spare_known_tokens(spark):
    toks = detect.tokens(spark.createDataFrame([(1, "a bb a cc"), (None, "bb dd"), (2, None)], "doc_id bigint, text string"), "doc_id", "text")
    words = spark.createDataFrame([("a", 9), ("cc", 1)], "word string, frequency bigint")
    best = spark.createDataFrame([("bb", "b"), ("zz", "z")], "query string, term string")
    want = [("1", 2, "bb", "b"), ("1", 7, "cc", None), ("None", 0, "bb", "b"), ("None", 3, "dd", None)]
    for more in ({}, {"unknown": spark.createDataFrame([("bb",), ("cc",), ("dd",)], "token string")}):
        got = detect.unknown_words(toks, "doc_id", words, best, 2, **more)
        assert "xxhash64" in got._jdf.queryExecution().optimizedPlan().toString()
        assert sorted((str(r["doc_id"]), r["start"], r["text"], r["fix"]) for r in got.collect()) == want
