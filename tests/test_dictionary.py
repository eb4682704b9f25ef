from pyspark.sql import functions as F

from lexforge.functions import text
from lexforge.operators import check, detect, dictionary, enrich, fusion, ngrams

LEAST = {"syllables": 1, "words": 2, "bigrams": 2, "trigrams": 1}


def corpus(spark, rows):
    return spark.createDataFrame([(r, "s") for r in rows], "text string, source string")


def test_build_resume_and_merge(spark, tmp_path):
    seg = lambda rows: dictionary.segment(corpus(spark, rows), text.words(F.col("text")), text.syllables(F.col("text")))
    rows = ["a b c", "a b d", "a c b", "", "x"]
    made = dictionary.build(spark, seg(rows), str(tmp_path / "d"), least=LEAST)
    assert {tuple(r) for r in made["words"].collect()} == {("a", 3), ("b", 3), ("c", 2)}
    assert {tuple(r) for r in made["bigrams"].collect()} == {("a", "b", 2, 1.0)}
    again = dictionary.build(spark, seg(["z z"]), str(tmp_path / "d"), least=LEAST)
    assert again["words"].count() == 3  # what is there whole isn't built again
    both = dictionary.merge(made, dictionary.package(dictionary.tables(seg(["a b", "a b", "a c", "a c"]), least=LEAST)))
    assert {tuple(r) for r in both["bigrams"].collect()} == {("a", "b", 4, round(4 / 6, 6)), ("a", "c", 2, round(2 / 6, 6))}
    assert {r["word"]: r["frequency"] for r in both["words"].collect()} == {"a": 7, "b": 5, "c": 4}
    # two whole builds, with collocations and broken compounds: these are taken anew from the merged counts
    other = dictionary.build(spark, seg(["a b", "a b", "ab", "ab"]), str(tmp_path / "e"), least=LEAST)
    whole = dictionary.merge(made, other)
    want = dictionary.enrichment({"words": whole["words"], "bigrams": whole["bigrams"]})
    for name in ("collocations", "compound_confusions"):
        assert {tuple(r) for r in whole[name].collect()} == {tuple(r) for r in want[name].collect()}
    assert {r["word"]: r["frequency"] for r in whole["words"].collect()} == {"a": 5, "b": 5, "c": 2, "ab": 2}


def test_windows_drop_with_the_third_word(spark):
    df = corpus(spark, ["a b bad c", "one", ""])
    got = {tuple(r) for r in ngrams.windows(df, text.words(F.col("text")), 3, ("bad",)).collect()}
    assert got == {("c", None, None), ("one", None, None)}
    curated = spark.createDataFrame([("one",)], "word string")
    assert {r["word"] for r in ngrams.token_counts(df, text.words(F.col("text")), 2, curated=curated).collect()} == {"one"}


def test_check_end_to_end(spark):
    words = spark.createDataFrame([("the", 100), ("house", 50), ("is", 90), ("green", 40), ("greenhouse", 60), ("their", 30), ("there", 30)], "word string, frequency bigint")
    bigrams = spark.createDataFrame([("the", "house", 40, 0.4), ("house", "is", 30, 0.6), ("is", "green", 30, 0.5), ("over", "there", 9, 0.9)], "w1 string, w2 string, cnt bigint, probability double")
    compounds = spark.createDataFrame([("green", "house", "greenhouse", 3.0)], "part1 string, part2 string, compound string, pmi double")
    docs = spark.createDataFrame([(1, "the hause is green"), (2, "the green house"), (3, ""), (4, None), (5, "the house")], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in check.respond(docs, check.errors(docs, words, bigrams, compounds=compounds)).collect()}
    assert rows[1]["corrected_text"] == "the house is green" and rows[1]["errors"][0]["error_type"] == "invalid_word"
    assert rows[2]["corrected_text"] == "the greenhouse"
    assert [rows[i]["has_errors"] for i in (3, 4, 5)] == [False, False, False]


def test_detectors_and_suppression(spark):
    docs = spark.createDataFrame([(1, "က​ခ ကာာ"), (2, "plain")], "id bigint, text string")
    got = {(r["id"], r["error_type"], r["start"], r["end"]) for r in detect.by_patterns(docs, "id", "text").collect()}
    assert got == {(1, "zero_width", 1, 2), (1, "duplicate_mark", 5, 7)}
    e = spark.createDataFrame([(1, "invalid_word", 0, 10, "aaabbb", None, 0.6, 1), (1, "invalid_syllable", 2, 4, "x", None, 0.6, 2), (1, "invalid_syllable", 4, 6, "y", None, 0.6, 2)], "id int, error_type string, start int, end int, text string, fix string, confidence double, priority int")
    assert fusion.drop_contained(e, "id").count() == 1
    assert detect.drop_cascades(e, "id").count() == 2
    words = spark.createDataFrame([("aaa", 9), ("bbb", 9)], "word string, frequency bigint")
    assert detect.drop_splittable(e, words).count() == 2
    assert detect.drop_entities(e, spark.createDataFrame([("x",)], "entity string")).count() == 2
    assert detect.drop_inside(e, "id", spark.createDataFrame([(1, 1, 5)], "id int, s_start int, s_end int")).count() == 2


def test_edges(spark):
    assert fusion.noisy_or(spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.5), (2, "a", 0.5), (2, "a", 0.4), (2, "b", 0.5)], "p int, cluster string, confidence double"), ["p"]).orderBy("p").collect() == [(1, 1.0, 2), (2, 0.75, 2)]
    words = spark.createDataFrame([("a", 4), ("b", 0)], "word string, frequency bigint")
    pairs = spark.createDataFrame([("a", "a", 4), ("a", "b", 4)], "w1 string, w2 string, cnt bigint")
    assert [r["npmi"] for r in enrich.collocations(pairs, words, 1, -99.0, -99.0).collect()] == [0.0]
