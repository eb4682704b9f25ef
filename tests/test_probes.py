"""Probes against plain Python and fixed answers."""

import itertools
import random
import sqlite3
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexforge.functions.distance import alignment
from lexforge.operators import compounds, probes
from lexforge.plans.probes import QUERIES
from lexforge.sources import corpus

from .compare import SF, connection


def words_of(spark, rows):
    return spark.createDataFrame(rows, "word string, frequency bigint")


def near_of(spark, sentences):
    rows = [(d, i, 0, t, *[s[i + k] if 0 <= i + k < len(s) else None for k in (-2, -1, 1)]) for d, s in enumerate(sentences) for i, t in enumerate(s)]
    return spark.createDataFrame(rows, "doc_id bigint, idx int, sent bigint, token string, prev2 string, prev string, next string")


def test_forms(spark):
    want = {"န်": "consonant_asat", "မး": "consonant_tone", "န့်": "consonant_tone_asat", "တွင်င်း": "double_ending", "ကြ": "medial_end", "န္": "virama_end", "န္တာ": "stacked_start", "ကန္": "virama_end", "ကန္တ": "incomplete_stacking", "မြန": "medial_consonant_end", "ြက": "medial_consonant_end", "ြကာ": "medial_start", "ါက": "dependent_vowel_start", "ဿက": "great_sa_start", "က်ံက": "asat_anusvara", "ဥဥ": "doubled_independent_vowel", "မြန်မာ": None, "": None}
    got = spark.createDataFrame([(w,) for w in want], "word string").select("word", probes.form_of(F.col("word")))
    assert {r[0]: r[1] for r in got.collect()} == want


def test_truncated(spark):
    words = words_of(spark, [("ချိန", 83), ("ချိန်", 179977), ("ဒေသ", 1), ("ဒေသး", 500), ("က", 5), ("ကု", 499), ("ခ", 0), ("ခု", 100), (None, 3)])
    got = {r["word"]: r["complete"] for r in probes.truncated(words, keep=("ဒေသ",)).collect()}
    assert got == {"ချိန": "ချိန်"}


def test_moved(spark):
    text = "a​​b‌c ﻿"
    spans = spark.createDataFrame([(1, 1, 3), (1, 4, 5), (1, 7, 8), (2, 0, 1)], "doc_id bigint, start int, end int")
    rows = spark.createDataFrame([(1, i) for i in range(len(text) + 1)] + [(3, 4)], "doc_id bigint, at int")
    want = {(1, i): sum(c not in "​‌‍﻿" for c in text[:i]) for i in range(len(text) + 1)} | {(3, 4): 4}
    assert {(r["doc_id"], r["at"]): r["new_at"] for r in probes.moved(rows, "doc_id", "at", spans).collect()} == want


def test_moved_shares_a_shuffle(spark):
    """Both ends of matches at once are as one after the other, with one exchange of the rows."""
    random.seed(8)
    spans = spark.createDataFrame([(d, 10 * i + 1, 10 * i + 1 + random.randint(1, 8)) for d in range(4) for i in range(9)], "doc_id bigint, start int, end int")
    rows = spark.createDataFrame([(random.randint(0, 5), a := random.randint(0, 95), a + random.randint(0, 9)) for _ in range(300)], "doc_id bigint, start int, end int")
    once = probes.moved(rows, "doc_id", ["start", "end"], spans)
    twice = probes.moved(probes.moved(rows, "doc_id", "start", spans), "doc_id", "end", spans)
    assert once._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_across_spaces(spark):
    """Against taking runs one after another, wider ones first."""
    random.seed(3)
    parts = ["a", "b", "ab", "c", "ba", "cab"]
    words = {"aab": 9, "ab": 9, "abc": 9, "ba": 9, "aba": 3, "bca": 9, "cc": 9, "abab": 9, "cabc": 9, "a": 1, "b": 30, "c": 2}
    sentences = [[random.choice(parts) for _ in range(random.randint(0, 12))] for _ in range(60)]
    want = set()
    for d, s in enumerate(sentences):
        gone = set()
        for n in (3, 2):
            for i in range(len(s) - n + 1):
                run = s[i : i + n]
                if gone & set(range(i, i + n)) or words.get("".join(run), 0) < 5 or min(words.get(t, 0) for t in run) >= 5:
                    continue
                gone |= set(range(i, i + n))
                want.add((d, i, " ".join(run), "".join(run)))
    got = probes.across_spaces(near_of(spark, sentences), "doc_id", words_of(spark, list(words.items()))).collect()
    assert want and {(r["doc_id"], r["idx"], r["text"], r["fix"]) for r in got} == want and len(got) == len(want)


def test_merges(spark):
    words = [("hello", 50), ("he", 40), ("hell", 2), ("world", 50), ("wor", 1)]
    got = probes.merges(near_of(spark, [["he", "lo"], ["hel", "lp"], ["wor", "dl"], ["he", "he"], ["hel", ""]]), "doc_id", words_of(spark, words)).collect()
    assert {(r["doc_id"], r["text"], r["fix"]) for r in got} == {(0, "he lo", "hello"), (1, "hel lp", "hello"), (2, "wor dl", "world")}


def brute_compound(s, words, least, longest, shortest, most):
    best = None
    if shortest <= len(s) <= longest:
        for n in range(1, most + 1):
            for cuts in itertools.combinations(range(1, len(s)), n - 1):
                pieces = [s[a:b] for a, b in itertools.pairwise((0, *cuts, len(s)))]
                if any(len(p) < shortest for p in pieces):
                    continue
                hits = []
                for p in pieces:
                    near = [(alignment(p, w), -f, w) for w, f in words.items() if f >= least and alignment(p, w) <= 1 and (len(p) > 1 or len(w) > 1)]
                    hits.append(min(near, default=None))
                if all(hits):
                    new = (sum(h[0] for h in hits), n, sum(h[1] for h in hits), [h[2] for h in hits])
                    best = new if best is None or new < best else best
    return ([s], len(s), 0) if best is None else (best[3], int(best[0]), -best[2])


def test_lookup_compound(spark):
    random.seed(5)
    words = {"the": 90, "cat": 40, "sat": 30, "on": 80, "mat": 20, "at": 60, "he": 70, "rare": 1, "cats": 20}
    strings = ["thecat", "thecatsat", "hecta", "thw", "x", "onthemat", "zzzzzz", "thecatsatonthematthecatsat", ""] + ["".join(random.choice("theca son") for _ in range(random.randint(1, 8))) for _ in range(30)]
    rows = spark.createDataFrame([(s,) for s in strings] + [(None,)], "string string")
    got = {r["string"]: (list(r["parts"]), r["distance"], r["frequency"]) for r in probes.lookup_compound(rows, words_of(spark, list(words.items())), 1, 20).collect()}
    assert got == {s: brute_compound(s, words, 20, 24, 2, 5) for s in set(strings) - {""}}


def test_compound_of_fewer_words(spark):
    """Where the fewest edits would take more words than are allowed, fewer words with an edit are found, behind a beginning that has as many without one."""
    words = [(w, 20) for w in ("ab", "cd", "ef", "gh", "ij", "kl")] + [("abcdefghik", 30)]
    rows = spark.createDataFrame([("abcdefghijkl",), ("abcdefghij",), ("xyxyxyxy",)], "string string")
    got = {r["string"]: (r["parts"], r["distance"], r["frequency"]) for r in probes.lookup_compound(rows, words_of(spark, words), 1, 20).collect()}
    assert got == {"abcdefghijkl": (["abcdefghik", "kl"], 1, 50), "abcdefghij": (["ab", "cd", "ef", "gh", "ij"], 0, 100), "xyxyxyxy": (["xyxyxyxy"], 8, 0)}


def test_compounds_without_rows_of_pieces(spark):
    """However many terms a worker holds, the splits are those of brute force; where it holds all there is no row but the strings'."""
    random.seed(12)
    letters = "abé😀"
    words = {"".join(random.choice(letters) for _ in range(random.randint(1, 6))): random.choice([5, 20, 20, 21, 40]) for _ in range(60)}
    strings = {"".join(random.choice(letters) for _ in range(random.randint(1, 8))) for _ in range(150)} | {"ab" * 13}
    rows, table = spark.createDataFrame([(s,) for s in strings], "string string"), words_of(spark, list(words.items()))
    want = {s: brute_compound(s, words, 20, 24, 2, 3) for s in strings}
    assert {d for _, d, _ in want.values()} >= {0, 1, 2}
    for local in (0, 100, 6_000_000):
        found = compounds.lookup(rows, table, 20, most=3, local=local)
        assert {r["string"]: (list(r["parts"]), r["distance"], r["frequency"]) for r in found.collect()} == want
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert probes.lookup_compound(rows, table.limit(0), 1, 20).filter("frequency = 0").count() == len(strings)


def test_compound_lookup_query(spark):
    con = connection()
    words = dict(con.execute("SELECT w, count(*) FROM (SELECT unnest(regexp_extract_all(lower(text), '[^ \\t\\n\\r]+')) AS w FROM documents) GROUP BY w").fetchall())
    got = QUERIES["compound_lookup"](spark, SF).collect()
    assert Counter(r["string"] for r in got) == Counter(w for w, n in words.items() if n == 1)
    common = {w: n for w, n in words.items() if n >= 20}
    for r in sorted(got, key=lambda r: r["string"]):
        if r["frequency"] == 0:
            assert r["parts"] == [r["string"]] and r["distance"] == len(r["string"])
        else:
            assert all(p in common for p in r["parts"]) and r["frequency"] == sum(common[p] for p in r["parts"])
    for r in [r for r in sorted(got, key=lambda r: r["string"]) if len(r["string"]) <= 6][:40]:
        assert (list(r["parts"]), r["distance"], r["frequency"]) == brute_compound(r["string"], common, 20, 24, 2, 5)


def test_joined_syllables(spark):
    """Against cutting pairs from the left."""
    random.seed(9)
    valid, words = {"ab္", "ca္"}, {"bc", "aa"}
    docs = [[(i, random.choice("abc")) for i in range(12) if random.random() < 0.8] for _ in range(40)]
    want = set()
    for d, rows in enumerate(docs):
        i = 0
        while i < len(rows):
            (at, s), nx = rows[i], rows[i + 1] if i + 1 < len(rows) else None
            both = s + nx[1] if nx and nx[0] == at + 1 else None
            if both in words:
                want.add((d, at, both, "word", None))
            elif both and both + "္" in valid:
                want.add((d, at, both, "joined", both + "္"))
            else:
                want.add((d, at, s, None, None))
                i += 1
                continue
            i += 2
    rows = spark.createDataFrame([(d, at, s) for d, x in enumerate(docs) for at, s in x], "doc_id bigint, at int, syllable string")
    known = spark.createDataFrame([(v,) for v in valid], "syllable string")
    got = probes.joined_syllables(rows, "doc_id", known, words_of(spark, [(w, 1) for w in words]), "္").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_rerank(spark):
    cands = spark.createDataFrame([(1, "the", "sat", "cut", 1), (1, "the", "sat", "cat", 2), (2, None, None, "x", 1), (2, None, None, "y", 2)], "id int, prev string, next string, term string, rank int")
    grams = spark.createDataFrame([("the", "cat", 0.4), ("cat", "sat", 0.2), ("the", "cut", 0.1)], "w1 string, w2 string, probability double")
    got = {(r["id"], r["place"]): r["term"] for r in probes.rerank_context(cands, ["id"], grams).collect()}
    assert got == {(1, 1): "cat", (1, 2): "cut", (2, 1): "x", (2, 2): "y"}
    rules = spark.createDataFrame([("q", "c", 2), (None, "b", 1), ("p", None, 9)], "query string, term string, step int")
    rows = spark.createDataFrame([(1, "q", "a", 1), (1, "q", "b", 2), (1, "q", "c", 3)], "id int, query string, term string, rank int")
    assert [r["term"] for r in probes.rerank_rules(rows, ["id"], rules).orderBy("place").collect()] == ["c", "b", "a"]


@pytest.mark.parametrize("n", [0, 1, 2500])
def test_sqlite(spark, tmp_path, n):
    rows = spark.createDataFrame([(f"w{i}", i, i / 2 if i % 3 else None) for i in range(n)], "word string, frequency bigint, p double")
    path = str(tmp_path / "d.sqlite")
    corpus.write_sqlite({"words": rows, "empty": rows.limit(0)}, path, {"words": ["word"]})
    corpus.write_sqlite({"words": rows, "empty": rows.limit(0)}, path, {"words": ["word"]})
    with sqlite3.connect(path) as con:
        assert con.execute("SELECT count(*), count(DISTINCT word) FROM words").fetchone() == (n, n)
        assert con.execute("SELECT count(*) FROM sqlite_master WHERE type = 'index' AND tbl_name = 'words'").fetchone() == (1,)
    got = corpus.read_sqlite(spark, path, "words", "word string, frequency bigint, p double", 700)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, rows.collect()))
    assert corpus.read_sqlite(spark, path, "empty", "word string, frequency bigint, p double").count() == 0
    odd = spark.createDataFrame([(1, ["a"], {"k": 1})], "id int, parts array<string>, m map<string,int>")
    corpus.write_sqlite({'o"d': odd}, path)
    with sqlite3.connect(path) as con:
        assert con.execute('SELECT * FROM "o""d"').fetchall() == [(1, '["a"]', '{"k":1}')]


def test_stream_of_sentences_and_failures(spark, tmp_path):
    from lexforge.streaming import checker

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one. two! three\n\nbad line. four\n")

    def check(text):
        if "bad" in text:
            raise ValueError("cannot read")
        return len(text)

    def judged(rows):
        return rows.select("sentence", checker.isolated(check, "int")(F.col("sentence")).alias("r")).select("sentence", "r.*")

    checker.check(checker.sentences(checker.lines(spark, str(tmp_path / "in"))), judged, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = {r["sentence"]: (r["value"], r["error"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"one.": (4, None), "two!": (4, None), "three": (5, None), "bad line.": (None, "ValueError: cannot read"), "four": (4, None)}
    assert [tuple(r["r"]) for r in spark.createDataFrame([(None,)], "s string").select(checker.isolated(check, "int")("s").alias("r")).collect()] == [(None, None)]
