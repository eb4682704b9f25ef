"""Queries on all documents, spelled in Myanmar letters: normal forms, syllables, rules, detectors and variants; each with its SQL.

A fixed spelling turns each letter of the tables' invented prose into a character of the script, so that clusters of every kind, right and wrong, occur.
The SQL has no look-around; what a pattern must see beside a match is part of its pattern there and is taken off the place of the match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import syllable_rules as R
from ..functions import text
from ..operators import detect, enrich, ngrams
from .corpus import docs

LATIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.!*%$&-|"
SCRIPT = "ာဗစဒေဖ္ှိြခလမနုပဋျသတူးွံ့်" + "ါဘဆဓဥယဂဲဿအကဟညငီဉ​ရ၀ကဦဠဝဈရဇ" + "၀၁၂၃၄၅၆၇၈၉" + "။။၊်္င_ဿ"
assert len(LATIN) == len(SCRIPT)
V = f"v AS (SELECT doc_id, translate(coalesce(text, ''), '{LATIN}', '{SCRIPT}') AS v FROM documents)"
_WORDS = r"list_filter(regexp_split_to_array(v, '[ \t\n\r]+'), lambda x: x <> '')"
#: Distinct words with their frequency.
W = f"{V}, w AS (SELECT word, count(*) AS frequency FROM (SELECT unnest({_WORDS}) AS word FROM v) GROUP BY word)"


def spelled(spark, d) -> DataFrame:
    """(doc_id, text) of all documents in Myanmar letters."""
    return docs(spark, d).select("doc_id", F.translate(F.coalesce("text", F.lit("")), LATIN, SCRIPT).alias("text"))


def spelled_words(spark, d, min_count: int = 1) -> DataFrame:
    return ngrams.token_counts(spelled(spark, d), F.filter(F.split("text", r"[ \t\n\r]+"), lambda x: x != ""), min_count)


# ---------------------------------------------------------------- normal forms


def normal_forms(spark, d):
    t = F.col("text")
    forms = {
        "bare": text.strip_zero_width(t), "vowels": text.fix_vowels(t), "display": text.for_display(t), "normal": text.normalize(t), "ingestion": text.for_ingestion(t),
        "unmarked": text.drop_segment_marks(t), "plain": text.strip_punctuation(t),
    }
    return spelled(spark, d).select("doc_id", *[F.md5(c).alias(k) for k, c in forms.items()], text.is_spaced(t).alias("spaced"))


def lookup_forms(spark, d):
    """Normal forms of words, in which lone zeros are read as letters."""
    t = F.col("word")
    return spelled_words(spark, d).select("word", text.zero_to_wa(t).alias("letters"), text.for_lookup(t).alias("lookup"), text.for_comparison(t).alias("comparison"))


_RANK = "MAP {" + ", ".join(f"'{c}': {n}" for c, n in text.MARK_ORDER.items()) + "}"
_MARKS = "".join(text.MARK_ORDER)


def _canonical(x: str) -> str:
    run = f"array_to_string(list_transform(list_sort(list_transform(regexp_extract_all(r, '.'), lambda c, i: {{'w': {_RANK}[c], 'i': i, 'c': c}})), lambda s: s.c), '')"
    bare = f"regexp_replace(nfc_normalize({x}), '[{text.ZERO_WIDTH}]', '', 'g')"
    return f"array_to_string(list_transform(regexp_extract_all({bare}, '[{_MARKS}]+|[^{_MARKS}]+'), lambda r: CASE WHEN length(r) > 1 AND regexp_matches(r, '^[{_MARKS}]') THEN {run} ELSE r END), '')"


def _vowels(x: str) -> str:
    x = f"replace({x}, 'ွါ', 'ွာ')"
    x = f"regexp_replace({x}, '([{text.TALL_AA_AFTER}])ော', '\\1ေါ', 'g')"
    # twice, as the one before may have been taken by a match
    for _ in range(2):
        x = f"regexp_replace({x}, '([^{text.TALL_AA_AFTER}])ေါ', '\\1ော', 'g')"
    return f"replace({x}, 'ဥ်', 'ဉ်')"


def _unmarked(x: str) -> str:
    for _ in range(2):
        x = f"regexp_replace({x}, '([က-႟])_+([က-႟])', '\\1\\2', 'g')"
    return x


# ---------------------------------------------------------------- syllables and sentences


def script_syllables(spark, d):
    parts = text.syllables(F.col("text"))
    return spelled(spark, d).select("doc_id", F.size(parts).alias("n"), F.md5(F.array_join(parts, "|")).alias("syllables"))


def script_sentences(spark, d):
    parts = text.sentences(F.col("text"))
    return spelled(spark, d).select("doc_id", F.size(parts).alias("n"), F.md5(F.array_join(parts, "|")).alias("sentences"))


def syllable_counts(spark, d):
    """Syllables of all documents with their frequency."""
    return spelled(spark, d).select(F.explode(text.syllables(F.col("text"))).alias("syllable")).filter("syllable rlike '[က-၏]'").groupBy("syllable").agg(F.count("*").alias("frequency"))


_CHARS = "c AS (SELECT doc_id, unnest(regexp_extract_all(v, '(?s).')) AS c, unnest(range(1, len(regexp_extract_all(v, '(?s).')) + 1)) AS i FROM v)"
_SYL = f"""{_CHARS},
n AS (SELECT *, lag(c, 1, '') OVER o AS p1, lag(c, 2, '') OVER o AS p2, lag(c, 3, '') OVER o AS p3, lead(c, 1, '') OVER o AS x FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT *, p3 || p2 || p1 <> '{text.KINZI}' AND ((regexp_matches(c, '[{text.CONSONANTS}]') AND x <> '{text.ASAT}' AND NOT (p1 = '{text.VIRAMA}' AND p2 <> '{text.ASAT}')) OR regexp_matches(c, '[{text.STARTERS}]')
  OR (regexp_matches(c, '[^က-၏]') AND NOT (p1 <> '' AND regexp_matches(p1, '[^က-၏]')))) AS cut FROM n),
k AS (SELECT *, sum(CAST(cut AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM b),
s AS (SELECT doc_id, k, string_agg(c, '' ORDER BY i) AS s FROM k GROUP BY doc_id, k)"""
_SENT = "list_filter(list_transform(string_split(regexp_replace(v, '(။|[.!?]($|[ \\t\\n\\x0B\\f\\r]))', '\\1￿', 'g'), '￿'), lambda x: trim(x)), lambda x: x <> '')"


# ---------------------------------------------------------------- rules of a syllable


def syllable_rule_breaks(spark, d):
    """Rules that each distinct word breaks as a syllable."""
    return spelled_words(spark, d).select("word", F.array_join(R.violations(F.col("word")), ",").alias("rules"), R.is_valid(F.col("word")).alias("valid"))


def valid_syllables(spark, d):
    """Syllables that break no rule, with their frequency; the filter is on an aggregate, so it isn't moved below it and judges each syllable once."""
    every = spelled(spark, d).select(F.explode(text.syllables(F.col("text"))).alias("s")).filter("s rlike '[က-၏]'")
    return every.groupBy("s").agg(F.count("*").alias("frequency"), F.max("s").alias("syllable")).filter(R.is_valid(F.col("syllable"))).select("syllable", "frequency")


_C, _D, _VI = R.CONS, R.DOT, text.VIRAMA
#: The patterns that look around or back, without that.
_SQL_RULES = R.PATTERNS | {
    "kinzi": f"င{text.ASAT}{_VI}([^{_C}အ]|$)",
    "asat_predecessor": f"(^|[^{_C}အ{R.TALL}ျု]){text.ASAT}",
    "double_mark": "|".join(f"{c}{c}" for c in "ျြွှေိီဲုူါာ" + text.ASAT + _VI + R.ANUSVARA + _D + R.VISARGA),
    "unique_marks": "|".join(f"{c}[^{_VI}]*{c}" for c in "ျြွှိီဲုူေ" + R.ANUSVARA + _D + R.VISARGA),
    "tones": f"{_D}{R.VISARGA}{_D}|{R.VISARGA}[^{R.VISARGA}]*{R.VISARGA}|([^ာါီူိ][ို]|ိိ){R.VISARGA}$",
    "unexpected_consonant": f"^[{_C}အ][{R.MEDIALS}{R.VOWELS}{R.ANUSVARA}{_D}{R.VISARGA}]*[{_C}]([^{text.ASAT}{_D}{_VI}][^{_VI}]*)?$",
    "medials": "|".join(f"(^|[^{takes}ျ-ှ]){m}" for m, takes in R.TAKES.items()),
}
_PAIRS = "|".join(f"[{v}]{_VI}[{v}]" for v in R.VARGA) + "|" + "|".join(f"{x[0]}{_VI}{x[1]}" for x in R.EXTRA_STACKS if len(x) == 2) + f"|{text.ASAT}{_VI}.|[{_C}အ]{_VI}[ယရလဝသဟ]"


def _breaks(x: str) -> str:
    case = lambda n: f"regexp_replace({x}, '{_PAIRS}', '', 'g') LIKE '%{_VI}%'" if n == "stack" else f"regexp_matches({x}, '{_SQL_RULES[n]}')"
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {case(n)} THEN '{n}' END" for g in ("basic", "medials", "vowels_tones", "advanced") for n in R.GROUPS[g]) + ")"


# ---------------------------------------------------------------- detectors


def script_errors(spark, d):
    """What the detectors on raw text find in all documents."""
    return detect.by_patterns(spelled(spark, d), "doc_id", "text").select("doc_id", "error_type", "start", "end", "text")


def script_errors_normal(spark, d):
    """What the detectors on normal text find in all documents."""
    return detect.by_patterns(spelled(spark, d), "doc_id", "text", detect.NORMAL).select("doc_id", "error_type", "start", "end", "text")


def _spans(kind: str, pattern: str, before: int = 0, behind: int = 0) -> str:
    """Matches of the pattern without so many characters before and behind; each text stands behind a mark that no pattern has."""
    return f"""SELECT doc_id, '{kind}' AS error_type, e - l + {before} - 1 AS start, e - {behind} - 1 AS "end", t[1 + {before}:l - {behind}] AS text FROM (
  SELECT doc_id, t, length(t) AS l, CAST(sum(length(g) + length(t)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM (
    SELECT doc_id, unnest(w) AS t, unnest(g[1:len(w)]) AS g, unnest(range(0, len(w))) AS i FROM (SELECT doc_id, regexp_extract_all('#' || v, '{pattern}') AS w, regexp_split_to_array('#' || v, '{pattern}') AS g FROM v)))"""


def _union(parts: list[str]) -> str:
    return f'WITH {V}, f AS ({" UNION ALL ".join(parts)}) SELECT doc_id, error_type, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", text FROM f'


_MED, _VOW = "ျြွှ", f"ေ{R.UPPER}{R.LOWER_V}{R.TALL}"
_raw = {k: p for k, p, _ in detect.RAW}
_stack = f"""SELECT doc_id, 'incomplete_stacking' AS error_type, s AS start, s + 1 AS "end", '{_VI}' AS text FROM (
  SELECT doc_id, unnest(range(start, start + length(text) - CASE WHEN regexp_matches(text, '[က-အ]$') THEN 2 ELSE 0 END)) AS s FROM ({_spans("x", f"{_VI}+[က-အ]?")}))"""
_RAW_SQL = _union([
    _spans("zero_width", _raw["zero_width"]), _spans("broken_virama", f"{_VI}[{_VOW}]", 0, 1), _spans("medial_order", _raw["medial_order"]), _spans("leading_e", "[^က-၏]ေ[က-အ]", 1, 1),
    _spans("vowel_before_medial", _raw["vowel_before_medial"]), _spans("vowel_order", _raw["vowel_order"]), _stack, _spans("duplicate_mark", "|".join(f"{c}{{2,}}" for c in _MED + _VOW + text.ASAT + "့း")), _spans("vowel_after_dot", _raw["vowel_after_dot"]),
])
_norm = {k: p for k, p, _ in detect.NORMAL}
_NORMAL_SQL = _union([
    _spans("broken_stacking", _norm["broken_stacking"]), _spans("vowel_after_asat", _norm["vowel_after_asat"]), _spans("punctuation", _norm["punctuation"]), _spans("latin_stop", "[က-၏][.,]", 1, 0),
    "SELECT doc_id, 'missing_end' AS error_type, length(v) AS start, length(v) AS \"end\", '' AS text FROM v WHERE regexp_matches(right(v, 1), '[က-၊-၏]') AND right(v, 1) <> '။'",
])


# ---------------------------------------------------------------- sounds and variants


def sound_codes(spark, d):
    """Codes of distinct words and their likeness to a fixed word, and to what is left of them without the last letter."""
    w = F.col("word")
    less = F.substring(w, F.lit(1), F.length(w) - 1)
    return spelled_words(spark, d).select("word", text.phonetic_code(w).alias("code"), text.sound_similarity(w, F.lit("တှေ")).alias("fixed"), text.sound_similarity(w, less).alias("shorter"))


def word_variants(spark, d):
    return spelled_words(spark, d).select("word", F.inline(text.confusable_variants(F.col("word"))))


def word_nasal_variants(spark, d):
    return spelled_words(spark, d).select("word", F.explode(text.nasal_variants(F.col("word"))).alias("variant"))


def word_stems(spark, d):
    return spelled_words(spark, d).select("word", text.stem(F.col("word"), STEMS).getField("root").alias("root"), text.stem(F.col("word"), STEMS).getField("suffix").alias("suffix"), text.is_reduplicated(F.col("word")).alias("said_twice"))


STEMS = ("နဒ", "ေ", "ေန", "တ", "်", "ိနဂ")


def typed_confusables(spark, d):
    return enrich.typed_confusables(spelled_words(spark, d), text.confusable_variants, 2)


def _code(x: str) -> str:
    table = "MAP {" + ", ".join(f"'{c}': '{k}'" for k, chars in text.PHONETIC_CLASSES.items() for c in chars) + "}"
    codes = f"list_filter(list_transform(regexp_extract_all({x}, '(?s).'), lambda c: {table}[c]), lambda y: y IS NOT NULL)"
    return f"array_to_string({codes}[1:greatest(10, CAST(ceil(length({x}) / 6.0) AS INTEGER))], '-')"


def _similar(a: str, b: str, ca: str, cb: str) -> str:
    """Of columns a, b and their codes ca, cb."""
    m, least = f"greatest(length({a}), length({b}))", f"least(length({a}), length({b}))"
    classes = "MAP {" + ", ".join(f"'{c}': '{k}'" for k, chars in text.PHONETIC_CLASSES.items() for c in chars) + "}"
    at = f"CASE WHEN {a}[i:i] = {b}[i:i] THEN 1.0::DOUBLE WHEN {classes}[{a}[i:i]] = {classes}[{b}[i:i]] THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END"
    total = f"coalesce(list_sum(list_transform(range(1, {least} + 1), lambda i: {at})), 0.0::DOUBLE)"
    own = f"greatest({total} / {m} - 0.2::DOUBLE * ({m} - {least}) / {m}, 0.0::DOUBLE)"
    code = f"CASE WHEN greatest(length({ca}), length({cb})) > 0 THEN 1 - levenshtein({ca}, {cb})::DOUBLE / greatest(length({ca}), length({cb})) END"
    weight = f"least(0.4::DOUBLE, length({a}) / 20.0::DOUBLE)"
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE WHEN {ca} = {cb} AND {ca} <> '' THEN 0.98::DOUBLE ELSE coalesce((1 - {weight}) * {own} + {weight} * ({code}), {own}) END"


def _variant_list() -> str:
    out = [f"{{'variant': replace(word, '{x}', '{y}'), 'type': '{k}'}}" for k, a, b in text.CONFUSIONS for x, y in ((a, b), (b, a))]
    out += [f"{{'variant': regexp_replace(word, '[{''.join(text.TONES)}]$', '') || '{t}', 'type': 'tone'}}" for t in ("", *text.TONES)]
    return f"list_distinct(list_filter([{', '.join(out)}], lambda x: x.variant <> word AND x.variant <> ''))"


_NASAL = [f"replace(word, '{a}', '{b}')" for a in ("န်", "မ်", "င်", "ံ") for b in ("န်", "မ်", "င်", "ံ") if a != b]
_LONGEST = sorted(STEMS, key=lambda s: (-len(s), s))
_SUFFIX = "CASE " + " ".join(f"WHEN word LIKE '%{s}' AND length(word) > {len(s)} THEN '{s}'" for s in _LONGEST) + " END"

def _letters(cs: str) -> str:
    """A list of characters, joined, with lone zeros beside letters as letters."""
    at = lambda i, c: f"regexp_matches(coalesce({cs}[{i}], ''), '[{c}]')"
    lone = f"({at('i - 1', 'က-ဿ')} AND NOT {at('i + 1', '၀-၉')}) OR (NOT {at('i - 1', '၀-၉')} AND {at('i + 1', 'က-ဿ')})"
    return f"array_to_string(list_transform({cs}, lambda c, i: CASE WHEN c = '၀' AND ({lone}) THEN 'ဝ' ELSE c END), '')"


SQL = {
    "lookup_forms": f"WITH {W}, x AS (SELECT word, {_canonical('word')} AS n FROM w), y AS (SELECT word, regexp_extract_all(word, '(?s).') AS a, regexp_extract_all({_vowels('n')}, '(?s).') AS b FROM x), z AS (SELECT word, {_letters('a')} AS letters, trim({_letters('b')}) AS lookup FROM y) SELECT *, regexp_replace(lookup, '[ \\t\\n\\x0B\\f\\r]+', '', 'g') AS comparison FROM z",
    "normal_forms": f"""WITH {V}, n AS (SELECT doc_id, v, {_canonical('v')} AS c FROM v)
SELECT doc_id, md5(regexp_replace(v, '[{text.ZERO_WIDTH}]', '', 'g')) AS bare, md5({_vowels('v')}) AS vowels, md5(c) AS display, md5({_vowels('c')}) AS normal, md5(trim({_unmarked(_vowels('c'))})) AS ingestion,
  md5({_unmarked('v')}) AS unmarked, md5(regexp_replace(v, '[[:punct:]၊-၏]', '', 'g')) AS plain, regexp_matches(v, '[က-႟] +[က-႟]') AS spaced FROM n""",
    "script_syllables": f"WITH {V}, {_SYL} SELECT v.doc_id, CAST(count(s) AS INTEGER) AS n, md5(coalesce(string_agg(s, '|' ORDER BY k), '')) AS syllables FROM v LEFT JOIN s USING (doc_id) GROUP BY v.doc_id",
    "script_sentences": f"WITH {V} SELECT doc_id, CAST(len({_SENT}) AS INTEGER) AS n, md5(array_to_string({_SENT}, '|')) AS sentences FROM v",
    "syllable_counts": f"WITH {V}, {_SYL} SELECT s AS syllable, count(*) AS frequency FROM s WHERE regexp_matches(s, '[က-၏]') GROUP BY s",
    "valid_syllables": f"WITH {V}, {_SYL}, f AS (SELECT s AS syllable, count(*) AS frequency FROM s WHERE regexp_matches(s, '[က-၏]') GROUP BY s) SELECT * FROM f WHERE {_breaks('syllable')} = ''",
    "syllable_rule_breaks": f"WITH {W}, x AS (SELECT word, {_breaks('word')} AS rules FROM w) SELECT word, rules, rules = '' AS valid FROM x",
    "script_errors": _RAW_SQL,
    "script_errors_normal": _NORMAL_SQL,
    "sound_codes": f"WITH {W}, x AS (SELECT word, {_code('word')} AS code, 'တှေ' AS f, {_code(chr(39) + 'တှေ' + chr(39))} AS cf, word[1:length(word) - 1] AS s, {_code('word[1:length(word) - 1]')} AS cs FROM w) SELECT word, code, {_similar('word', 'f', 'code', 'cf')} AS fixed, {_similar('word', 's', 'code', 'cs')} AS shorter FROM x",
    "word_variants": f"WITH {W}, x AS (SELECT word, unnest({_variant_list()}) AS v FROM w) SELECT word, v.variant AS variant, v.type AS type FROM x",
    "word_nasal_variants": f"WITH {W} SELECT word, unnest(list_distinct(list_filter([{', '.join(_NASAL)}], lambda x: x <> word))) AS variant FROM w",
    "word_stems": f"WITH {W}, x AS (SELECT word, {_SUFFIX} AS suffix FROM w) SELECT word, word[1:length(word) - coalesce(length(suffix), 0)] AS root, suffix, length(word) >= 4 AND length(word) % 2 = 0 AND left(word, length(word) // 2) = right(word, length(word) // 2) AS said_twice FROM x",
    "typed_confusables": f"WITH {W}, k AS (SELECT * FROM w WHERE frequency >= 2), x AS (SELECT word, frequency, unnest({_variant_list()}) AS v FROM k), y AS (SELECT least(x.word, k.word) AS w1, greatest(x.word, k.word) AS w2, v.type AS type, greatest(x.frequency, k.frequency)::DOUBLE / least(x.frequency, k.frequency) AS freq_ratio FROM x JOIN k ON k.word = v.variant) SELECT DISTINCT * FROM y WHERE freq_ratio <= 1000",
}
QUERIES = {name: globals()[name] for name in SQL}
