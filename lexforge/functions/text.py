"""Column functions on text: tokens, normal forms, scripts, syllables, phonetic codes."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the Myanmar script.
CONSONANTS = "က-အ"
STARTERS = "ဢ-ဪဿ-၏"
ASAT, VIRAMA, TALL_AA, AA, E_VOWEL, MEDIAL_WA = "်", "္", "ါ", "ာ", "ေ", "ွ"
KINZI = "င်္"
ZERO_WIDTH = "​‌‍﻿"
SENTENCE_END = "။"
#: Consonants that take the tall AA behind the E vowel.
TALL_AA_AFTER = "ပခဒ"
#: Order of marks in a cluster; the rest keep their places.
MARK_ORDER = {
    "ျ": 100, "ြ": 110, "ွ": 120, "ှ": 130, "ေ": 200, "ိ": 210, "ီ": 210, "ဲ": 210,
    "ါ": 214, "ာ": 214, "်": 215, "ု": 220, "ူ": 220, "ံ": 300, "့": 320, "း": 330,
}


def words(text: Column) -> Column:
    """Lower-cased tokens between blanks, tabs and line ends; null gives none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\r]+"), lambda x: x != "")


def script_ratio(text: Column, script: str = "က-႟ꧠ-꧿ꩠ-ꩿ") -> Column:
    """Share of the code points that aren't white space which are in the character class; 0 without any."""
    solid = F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r]+", "")
    inside = F.length(solid) - F.length(F.regexp_replace(solid, f"[{script}]", ""))
    return F.when(F.length(solid) > 0, inside / F.length(solid)).otherwise(F.lit(0.0))


def strip_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, f"[{ZERO_WIDTH}]", "")


def drop_segment_marks(text: Column, spaces: bool = False) -> Column:
    """Without the underscores (and, if asked, blanks) between Myanmar characters."""
    mark = "[_ ]+" if spaces else "_+"
    return F.regexp_replace(text, f"(?<=[က-႟]){mark}(?=[က-႟])", "")


def fix_vowels(text: Column) -> Column:
    """Tall AA behind medial WA, tall or plain AA behind the E vowel by consonant, and U with asat as NYA with asat."""
    text = F.regexp_replace(text, f"{MEDIAL_WA}{TALL_AA}", f"{MEDIAL_WA}{AA}")
    text = F.regexp_replace(text, f"(?<=[{TALL_AA_AFTER}]){E_VOWEL}{AA}", f"{E_VOWEL}{TALL_AA}")
    text = F.regexp_replace(text, f"(?<=[^{TALL_AA_AFTER}]){E_VOWEL}{TALL_AA}", f"{E_VOWEL}{AA}")
    return F.regexp_replace(text, "ဥ်", "ဉ်")


def zero_to_wa(text: Column) -> Column:
    """The digit zero that touches a letter and no digit is the letter WA."""
    letter = "က-ဿ"
    return F.regexp_replace(text, f"(?<=[{letter}])၀(?![၀-၉])|(?<![၀-၉])၀(?=[{letter}])", "ဝ")


def reorder_marks(text: str) -> str:
    """Marks of each cluster in canonical order."""
    out: list[str] = []
    run: list[str] = []
    for ch in text:
        if ch in MARK_ORDER:
            run.append(ch)
            continue
        out += sorted(run, key=MARK_ORDER.__getitem__)
        run = []
        out.append(ch)
    return "".join(out + sorted(run, key=MARK_ORDER.__getitem__))


@F.pandas_udf(T.StringType())
def canonical(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFC, without zero-width characters, marks in order; Spark has no built-in for NFC."""
    drop = str.maketrans("", "", ZERO_WIDTH)
    for s in batches:
        yield s.map(lambda x: None if x is None else reorder_marks(unicodedata.normalize("NFC", x).translate(drop)))


def normalize(text: Column, digits: bool = False) -> Column:
    """The full chain; ``digits``: also read lone zeros as WA."""
    out = fix_vowels(canonical(text))
    return zero_to_wa(out) if digits else out


def for_display(text: Column) -> Column:
    return canonical(text)


def for_lookup(text: Column) -> Column:
    return F.trim(normalize(text, digits=True))


def for_comparison(text: Column) -> Column:
    return F.regexp_replace(for_lookup(text), r"\s+", "")


def for_ingestion(text: Column) -> Column:
    return F.trim(drop_segment_marks(normalize(text)))


def strip_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"[\p{Punct}၊-၏]", "")


def syllables(text: Column) -> Column:
    """Syllables; runs outside of the script are one part each. Nothing is cut behind a kinzi, so it joins what follows."""
    start = f"(?<!(?<!{ASAT}){VIRAMA})[{CONSONANTS}](?!{ASAT})|[{STARTERS}]|(?<![^က-၏])[^က-၏]+"
    return F.filter(F.split(F.regexp_replace(text, f"(?<!{KINZI})({start})", "￿$1"), "￿"), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Sentences; the mark at the end stays."""
    parts = F.split(F.regexp_replace(text, f"({SENTENCE_END}|[.!?](?=\\s|$))", "$1￿"), "￿")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def is_spaced(text: Column) -> Column:
    """Whether the text has a Myanmar character, a blank and a Myanmar character in a row."""
    return F.coalesce(text.rlike("[က-႟] +[က-႟]"), F.lit(False))


# Characters that sound alike. Each class is named by its first letter in Latin.
PHONETIC_CLASSES = {
    "k": "ကခဂဃ", "ng": "င", "s": "စဆသ", "z": "ဇဈ", "ny": "ဉည",
    "t": "ဋဌဍဎတထဒဓ", "n": "ဏန", "p": "ပဖဗဘ", "m": "မ", "y": "ယရျြ",
    "l": "လဠ", "w": "ဝွ", "h": "ဟှ", "a": "အါာ", "i": "ိီဣဤ", "u": "ုူဥဦ", "e": "ေဲဧ",
}


def phonetic_code(text: Column, length: int = 10, per_unit: int = 6) -> Column:
    """Codes of sound classes joined by -, tones and killers dropped; long words may have more codes."""
    table = F.create_map(*[F.lit(x) for code, chars in PHONETIC_CLASSES.items() for ch in chars for x in (ch, code)])
    codes = F.filter(F.transform(F.split(text, ""), lambda ch: F.element_at(table, ch)), lambda x: x.isNotNull())
    limit = F.greatest(F.lit(length), F.ceil(F.length(text) / per_unit).cast("int"))
    return F.array_join(F.slice(codes, F.lit(1), limit), "-")


def phonetic_similarity(a: Column, b: Column) -> Column:
    """Of two codes: 1 for equal ones, else 1 - edits / the longer code (0 if either is empty)."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def sound_similarity(a: Column, b: Column, same_code: float = 0.98, same_class: float = 0.85, gap: float = 0.2, most: float = 0.4, per: float = 20.0) -> Column:
    """Likeness of two words by place: equal characters count 1, those of one class ``same_class``, over the longer word, less ``gap`` for the share that only one has;
    blended with the likeness of their codes, the more (up to ``most``) the longer the first word is. Equal codes give ``same_code``; an empty word gives 0."""
    table = F.create_map(*[F.lit(x) for code, chars in PHONETIC_CLASSES.items() for ch in chars for x in (ch, code)])
    ca, cb = phonetic_code(a), phonetic_code(b)
    longer, shorter = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    hit = lambda x, y: F.when(x == y, F.lit(1.0)).when(F.element_at(table, x) == F.element_at(table, y), F.lit(same_class)).otherwise(F.lit(0.0))
    total = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), hit), F.lit(0.0), lambda s, x: s + x)
    own = F.greatest(total / longer - gap * (longer - shorter) / longer, F.lit(0.0))
    weight = F.least(F.lit(most), F.length(a) / per)
    code = 1 - F.levenshtein(ca, cb) / F.greatest(F.length(ca), F.length(cb))
    mixed = F.when((ca == "") & (cb == ""), own).otherwise((1 - weight) * own + weight * code)
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).when((ca == cb) & (ca != ""), F.lit(same_code)).otherwise(mixed)


# Families of confusable spellings, (type, from, to).
CONFUSIONS = (
    ("aspiration", "က", "ခ"), ("aspiration", "စ", "ဆ"), ("aspiration", "တ", "ထ"), ("aspiration", "ပ", "ဖ"),
    ("medial", "ျ", "ြ"), ("nasal", "န်", "မ်"), ("nasal", "န်", "ံ"), ("nasal", "မ်", "ံ"),
    ("stop_coda", "တ်", "ပ်"), ("stop_coda", "က်", "တ်"), ("vowel_length", "ိ", "ီ"), ("vowel_length", "ု", "ူ"),
)
TONES = ("့", "း")


def confusable_variants(word: Column) -> Column:
    """Array of (variant, type): each family swapped both ways, and the final tone dropped, changed or added; never the word itself."""
    out = [F.struct(F.replace(word, F.lit(x), F.lit(y)).alias("variant"), F.lit(kind).alias("type")) for kind, a, b in CONFUSIONS for x, y in ((a, b), (b, a))]
    bare = F.regexp_replace(word, f"[{''.join(TONES)}]$", "")
    out += [F.struct(F.concat(bare, F.lit(t)).alias("variant"), F.lit("tone").alias("type")) for t in ("", *TONES)]
    return F.array_distinct(F.filter(F.array(*out), lambda x: (x["variant"] != word) & (x["variant"] != "")))


def nasal_variants(word: Column) -> Column:
    endings = ("န်", "မ်", "င်", "ံ")
    return F.array_distinct(F.filter(F.array(*[F.replace(word, F.lit(a), F.lit(b)) for a in endings for b in endings if a != b]), lambda x: x != word))


def stem(word: Column, suffixes: tuple[str, ...]) -> Column:
    """(root, suffix): the longest suffix that leaves a root goes."""
    hits = F.filter(F.array(*[F.lit(s) for s in sorted(suffixes, key=lambda s: (-len(s), s))]), lambda s: word.endswith(s) & (F.length(word) > F.length(s)))
    suffix = F.when(F.size(hits) > 0, F.element_at(hits, 1))
    root = F.when(suffix.isNull(), word).otherwise(F.substring(word, F.lit(1), F.length(word) - F.length(suffix)))
    return F.struct(root.alias("root"), suffix.alias("suffix"))


def is_reduplicated(word: Column) -> Column:
    """Whether the word is a part of two or more characters said twice."""
    return word.rlike(r"^(.{2,})\1$")
