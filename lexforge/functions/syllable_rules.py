"""Phonotactic rules of one Myanmar syllable, each a predicate that Catalyst evaluates; apply them to distinct syllables and join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ASAT, VIRAMA, ZERO_WIDTH

# Classes of the script.
CONS = "က-ဠဿ"
INDEPENDENT = "အဣ-ဪ"
MEDIALS = "ျ-ှ"
UPPER, LOWER_V, TALL = "ိီဲ", "ုူ", "ါာ"
VOWELS = f"ေ{UPPER}{LOWER_V}{TALL}"
ANUSVARA, DOT, VISARGA = "ံ", "့", "း"
#: Rows of consonants; a stacked pair comes from one row, or is one of the extra pairs.
VARGA = ("ကခဂဃင", "စဆဇဈဉည", "ဋဌဍဎဏ", "တထဒဓန", "ပဖဗဘမ")
EXTRA_STACKS = ("လလ", "သသ", "ဿ")
# Consonants that take each medial.
TAKES = {
    "ျ": "ကခဂဃငစဆဇဈဋဌဍဎဏပဖဗဘမလသ",
    "ြ": "ကခဂဃငဋဌဍဎဏပဖဗဘမလ",
    "ွ": "ကခဂဃငစဆဇဈဉညဋဌဍဎဏတထဒဓနပဖဗဘမယရလဝသဟဠအ",
    "ှ": "ငဉညနမယရလဝဠ",
}

#: name: pattern of what is wrong.
PATTERNS = {
    "start_char": f"^[^{CONS}{INDEPENDENT}၀-၏]",
    "structure": f"[{VISARGA}{DOT}][{CONS}{MEDIALS}{VOWELS}]|[{VOWELS}][{MEDIALS}]",
    "asat_count": f"{ASAT}[^{VIRAMA}]*{ASAT}[^{VIRAMA}]*{ASAT}",
    "virama_after_medial": f"[{MEDIALS}]{VIRAMA}",
    "anusvara": f"{ANUSVARA}[^{DOT}]|[ီဲူေါာ]{ANUSVARA}",
    "kinzi": f"င{ASAT}{VIRAMA}(?![{CONS}အ])",
    "strict_kinzi": f"င{VIRAMA}",
    "vowels_upper": f"[{UPPER}][{UPPER}]",
    "vowels_lower": f"[{LOWER_V}][{LOWER_V}]",
    "great_sa": f"ဿ[{MEDIALS}]|{VIRAMA}ဿ|ဿ{VIRAMA}",
    "e_combination": f"ေ[{UPPER}{LOWER_V}]|[{UPPER}{LOWER_V}]ေ",
    "e_position": "^ေ",
    "asat_predecessor": f"(?<![{CONS}အ{TALL}ျု]){ASAT}",
    "vowel_combination": f"[{TALL}][{UPPER}{LOWER_V}]|[ဲီ][{LOWER_V}]",
    "double_mark": f"([{MEDIALS}{VOWELS}{ASAT}{VIRAMA}{ANUSVARA}{DOT}{VISARGA}])\\1",
    "medial_vowel": f"ွ[{LOWER_V}]{ASAT}|ှ[ဲ]{ASAT}",
    "corruption": r"[\x{FFFD}\x{0000}-\x{001F}]",
    "independent_vowel": f"[ဣ-ဪ][{MEDIALS}{UPPER}{TALL}ေ]",
    "virama_usage": f"{VIRAMA}$|{VIRAMA}[^{CONS}အ]|^{VIRAMA}",
    "tones": f"{DOT}{VISARGA}{DOT}|{VISARGA}[^{VISARGA}]*{VISARGA}|[ို]{VISARGA}$(?<=[^ာါီူ][ို]{VISARGA})(?<!ို{VISARGA})",
    "zero_width": f"[{ZERO_WIDTH}]",
    "tall_a": "ါ.*ာ|ာ.*ါ",
    "tall_a_after_wa": "ွါ",
    "dot_below": f"{DOT}[{VOWELS}{MEDIALS}{ANUSVARA}]",
    "virama_count": f"{VIRAMA}.*{VIRAMA}.*{VIRAMA}",
    "anusvara_asat": f"{ANUSVARA}{ASAT}",
    "asat_vowel": f"{ASAT}[{VOWELS}]",
    "tone_strict": f"{DOT}.*{DOT}|{VISARGA}.*{VISARGA}",
    "tone_position": f"{VISARGA}.|{DOT}[^{ASAT}{VISARGA}]",
    "scope": "[^က-၏]",
    "unique_marks": f"([{MEDIALS}ိီဲုူေ{ANUSVARA}{DOT}{VISARGA}])[^{VIRAMA}]*\\1",
    "one_final": f"[{CONS}]{ASAT}[{CONS}]{ASAT}|{ANUSVARA}[{CONS}]{ASAT}",
    "unexpected_consonant": f"^[{CONS}အ][{MEDIALS}{VOWELS}{ANUSVARA}{DOT}{VISARGA}]*[{CONS}](?![{ASAT}{DOT}{VIRAMA}])(?!.*{VIRAMA})",
}
GROUPS = {
    "basic": ("corruption", "start_char", "e_position", "independent_vowel", "structure", "unexpected_consonant"),
    "medials": ("medial_vowel", "medials"),
    "vowels_tones": (
        "vowels_upper", "vowels_lower", "e_combination", "vowel_combination", "anusvara", "tones", "virama_usage", "double_mark", "asat_count", "asat_predecessor", "tall_a", "tall_a_after_wa",
        "dot_below", "virama_count", "anusvara_asat", "asat_vowel", "great_sa", "zero_width", "stack",
    ),
    "advanced": ("kinzi", "strict_kinzi", "virama_after_medial", "tone_strict", "tone_position", "unique_marks", "one_final", "scope"),
}


def violations(syllable: Column, groups: tuple[str, ...] = ("basic", "medials", "vowels_tones", "advanced")) -> Column:
    """Names of the rules that the syllable breaks, in order; null and empty break none."""
    checks = {name: syllable.rlike(p) for name, p in PATTERNS.items()}
    medial = F.lit(False)
    for m, takes in TAKES.items():
        medial = medial | syllable.rlike(f"(?<![{takes}ျ-ှ]){m}")
    checks["medials"] = medial
    pair = "|".join(f"[{v}]{VIRAMA}[{v}]" for v in VARGA) + "|" + "|".join(f"{x[0]}{VIRAMA}{x[1]}" for x in EXTRA_STACKS if len(x) == 2) + f"|{ASAT}{VIRAMA}.|[{CONS}အ]{VIRAMA}[ယရလဝသဟ]"
    checks["stack"] = F.regexp_replace(syllable, pair, "").contains(VIRAMA)
    found = [F.when(checks[name], F.lit(name)) for g in groups for name in GROUPS[g]]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def is_valid(syllable: Column) -> Column:
    return F.size(violations(syllable)) == 0
