import random
import re

import pytest
from pyspark.sql import functions as F

from lexforge.functions import distance, syllable_rules, text


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in rows.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_words(spark):
    assert column(spark, ["A b\t\tC\n", "", None, " x "], text.words) == [["a", "b", "c"], [], [], ["x"]]


def plain_syllables(s):
    parts = [p for p in re.sub("((?<!(?<!်)္)[က-အ](?!်)|[ဢ-ဪဿ-၏]|[^က-၏]+)", "￿\\1", s).split("￿") if p]
    out = []
    for p in parts:
        if out and out[-1].endswith("င်္"):
            out[-1] += p
        else:
            out.append(p)
    return out


@pytest.mark.parametrize(
    ("word", "parts"),
    [("မြန်မာ", ["မြန်", "မာ"]), ("ကျောင်းသား", ["ကျောင်း", "သား"]), ("ဗုဒ္ဓ", ["ဗု", "ဒ္ဓ"]), ("သင်္ဘော", ["သင်္ဘော"]), ("၁၂", ["၁", "၂"]), ("hi မာ", ["hi ", "မာ"])],
)
def test_syllables(spark, word, parts):
    assert column(spark, [word], text.syllables) == [parts]


def test_syllables_equal_plain_python(spark):
    rng = random.Random(1)
    values = ["".join(chr(rng.randint(0x1000, 0x104F)) for _ in range(rng.randint(1, 15))) for _ in range(200)]
    values += ["".join(rng.choice("ကခငသဘ်္ောိ ab") for _ in range(12)) for _ in range(200)]
    assert column(spark, values, text.syllables) == [plain_syllables(v) for v in values]


def test_normal_forms(spark):
    assert column(spark, ["ပွါး", "ပော်", "ကေါင်း", "ဥ်", "မ​ြန်", None], text.normalize) == ["ပွား", "ပေါ်", "ကောင်း", "ဉ်", "မြန်", None]
    assert column(spark, ["သူ၀ယ်", "၁၀၀"], lambda c: text.normalize(c, digits=True)) == ["သူဝယ်", "၁၀၀"]
    assert text.reorder_marks("ကှျ") == "ကျှ"
    assert column(spark, ["က_ခ_ဂ", "က ခ", "a_b"], text.drop_segment_marks) == ["ကခဂ", "က ခ", "a_b"]
    assert column(spark, ["က ခ"], lambda c: text.drop_segment_marks(c, spaces=True)) == ["ကခ"]


def test_script_ratio_and_sentences(spark):
    assert column(spark, ["ကa", "", None, "  "], text.script_ratio) == [0.5, 0.0, 0.0, 0.0]
    assert column(spark, ["က။ ခ။ ဂ"], text.sentences) == [["က။", "ခ။", "ဂ"]]


def test_syllable_rules(spark):
    good = ["မြန်", "မာ", "ကျောင်း", "သား", "နေ့", "ဗုဒ္ဓ", "သင်္ဘော", "ပေါ်", "အိမ်"]
    assert column(spark, good, syllable_rules.is_valid) == [True] * len(good)
    bad = {"ေက": "e_position", "ကာာ": "double_mark", "ကိီ": "vowels_upper", "က္": "virama_usage", "ွါက": "tall_a_after_wa", "ကa": "scope", "က့ာ": "dot_below", "ကံ်": "anusvara_asat", "က်ိ": "asat_vowel", "င္က": "strict_kinzi"}
    for got, want in zip(column(spark, list(bad), syllable_rules.violations), bad.values(), strict=True):
        assert want in got


def plain_osa(a, b):
    d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_distances(spark):
    rng = random.Random(2)
    pairs = [("abc", "acb"), ("ca", "abc"), ("", "x"), ("kitten", "sitting"), ("same", "same")]
    pairs += [("".join(rng.choice("abc") for _ in range(rng.randint(0, 6))), "".join(rng.choice("abc") for _ in range(rng.randint(0, 6)))) for _ in range(100)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r["d"] for r in rows.select("i", distance.osa("a", "b").alias("d")).orderBy("i").collect()]
    assert got == [plain_osa(*p) for p in pairs] and got[:5] == [1, 3, 1, 3, 0]
    assert distance.weighted("cat", "cst") == 0.5 and distance.weighted("abc", "acb") == 0.7


def test_deletes_and_dice(spark):
    def plain(w, n):
        out = {w[:10]}
        for _ in range(n):
            out |= {x[:i] + x[i + 1 :] for x in out for i in range(len(x))}
        return {x for x in out if x}

    words = ["a", "ab", "abcd", "abcdefghijklmn", "aab"]
    for n in (1, 2):
        assert [set(x) for x in column(spark, words, lambda c, n=n: distance.deletes(c, n))] == [plain(w, n) for w in words]
    rows = spark.createDataFrame([("night", "nacht"), ("aaa", "aa"), ("a", "b")], "a string, b string")
    assert [r[0] for r in rows.select(distance.dice(F.col("a"), F.col("b"))).collect()] == [0.25, 2 / 3, 0.0]
