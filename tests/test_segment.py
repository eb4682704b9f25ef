import itertools
import math

from pyspark.sql import functions as F

from lexforge.operators import segment, tags


def lexicon(spark):
    return spark.createDataFrame([("green", 50), ("house", 40), ("greenhouse", 30), ("a", 90), ("is", 60)], "word string, frequency bigint")


def test_word_split_is_the_likeliest(spark):
    shared = segment.model(lexicon(spark))
    uni, _, _ = shared.value
    rows = spark.createDataFrame([(1, "greenhouseis a"), (2, "xgreen"), (3, ""), (4, None)], "i int, text string")
    got = {r["i"]: r["w"] for r in rows.select("i", segment.split_words(F.col("text"), shared).alias("w")).collect()}
    assert got == {1: ["greenhouse", "is", "a"], 2: ["x", "green"], 3: [], 4: None}
    s = "greenhouseisa"
    ways = [[s[a:b] for a, b in itertools.pairwise([0, *cut, len(s)])] for n in range(len(s)) for cut in itertools.combinations(range(1, len(s)), n)]
    best = max((w for w in ways if all(x in uni for x in w)), key=lambda w: sum(uni[x] for x in w))
    assert segment.best_path(s, shared.value) == best


def test_bigrams_change_the_path(spark):
    b = spark.createDataFrame([("green", "house", 40, 0.99)], "w1 string, w2 string, cnt bigint, probability double")
    assert segment.best_path("greenhouse", segment.model(lexicon(spark), b).value) == ["green", "house"]


def test_compounds_fragments_and_mixed(spark):
    shared = segment.model(lexicon(spark).filter("word <> 'greenhouse'"))
    words = spark.createDataFrame([("greenhouse",), ("green",), ("greenx",)], "word string")
    assert [tuple(r) for r in segment.compounds(words, shared).collect()] == [("greenhouse", ["green", "house"])]
    rows = spark.createDataFrame([("မာ abc မာ",)], "t string")
    assert rows.select(segment.mixed_script(F.col("t"))).first()[0] == ["မာ", "<ENG>", "မာ"]
    frag = spark.createDataFrame([(["ကျော", "င်း", "သား"],)], "w array<string>")
    assert frag.select(segment.merge_fragments(F.col("w"))).first()[0] == ["ကျောင်း", "သား"]


def test_entities_and_reduplication(spark):
    t = spark.createDataFrame([(1, 0, "ဦး"), (1, 1, "ဘ"), (1, 2, "ရန်ကုန်")], "d int, idx int, token string")
    g = spark.createDataFrame([("ရန်ကုန်", "LOC", 0.9)], "entity string, entity_type string, confidence double")
    assert {tuple(r) for r in segment.entities(t, "d", g).collect()} == {(1, 1, "ဘ", "PER", "honorific", 0.7), (1, 2, "ရန်ကုန်", "LOC", "gazetteer", 0.9)}
    w = spark.createDataFrame([("soso",), ("so",), ("nana",)], "word string")
    assert [tuple(r) for r in segment.reduplications(w).collect()] == [("soso", "so")]


def test_viterbi_and_marginals_equal_brute_force(spark):
    every = ["D", "N", "V"]
    trans = {("", "D"): 0.6, ("", "N"): 0.3, ("", "V"): 0.1, ("D", "N"): 0.9, ("D", "V"): 0.1, ("N", "V"): 0.7, ("N", "N"): 0.2, ("V", "D"): 0.5}
    emit = {"the": {"D": 1.0}, "dog": {"N": 0.8, "V": 0.2}, "runs": {"V": 0.7, "N": 0.3}}
    sent = ["the", "dog", "runs"]
    rows = spark.createDataFrame([(sent,), ([],)], "words array<string>")

    def p(path):
        out, last = 1.0, ""
        for w, t in zip(sent, path, strict=True):
            out *= max(trans.get((last, t), 0), 1e-10) * max(emit[w].get(t, 0), 1e-10)
            last = t
        return out

    paths = list(itertools.product(every, repeat=3))
    got = segment.marginals(tags.viterbi(rows, trans, emit, every), trans, emit, every).collect()
    assert got[0]["tags"] == list(max(paths, key=p)) and got[1]["tags"] == []
    total = sum(map(p, paths))
    for i in range(3):
        for k, t in enumerate(every):
            assert math.isclose(got[0]["marginals"][i][k], sum(p(x) for x in paths if x[i] == t) / total, rel_tol=1e-6, abs_tol=1e-12)


def test_split_by_table_equals_the_broadcast_model(spark):
    words = lexicon(spark)
    shared = segment.model(words)
    strings = ["greenhouse", "thegreenhouse", "xxgreen", "", "a", "unknownword", "thegreenhouseisgreen"]
    got = {r["string"]: r["parts"] for r in segment.split_by_table(spark.createDataFrame([(s,) for s in [*strings, "greenhouse", None]], "string string"), words).collect()}
    assert got == {s: segment.best_path(s, shared.value) for s in strings}
