"""Schemas of the corpus, the dictionary tables and check results."""

from __future__ import annotations

CORPUS = "text string, source string"
SEGMENTED = "text string, source string, syllables array<string>, words array<string>, syllable_count int, word_count int"

#: Tables of a dictionary. Words are joined by their text, so that no dense ids need a global sort.
DICTIONARY = {
    "syllables": "syllable string, frequency bigint",
    "words": "word string, syllable_count int, frequency bigint, pos_tag string, is_curated boolean, inferred_pos string, inferred_confidence double, inferred_source string",
    "bigrams": "w1 string, w2 string, cnt bigint, probability double",
    "trigrams": "w1 string, w2 string, w3 string, cnt bigint, probability double",
    "fourgrams": "w1 string, w2 string, w3 string, w4 string, cnt bigint, probability double",
    "fivegrams": "w1 string, w2 string, w3 string, w4 string, w5 string, cnt bigint, probability double",
    "pos_unigrams": "tag string, probability double",
    "pos_bigrams": "tag1 string, tag2 string, probability double",
    "pos_trigrams": "tag1 string, tag2 string, tag3 string, probability double",
    "processed_files": "path string, mtime timestamp, size bigint",
    "metadata": "key string, value string",
    "confusable_pairs": "word1 string, word2 string, confusion_type string, context_overlap double, freq_ratio double, suppress boolean, source string",
    "compound_confusions": "compound string, part1 string, part2 string, compound_freq bigint, split_freq bigint, pmi double",
    "collocations": "word1 string, word2 string, pmi double, npmi double, count bigint",
    "register_tags": "word string, register string, confidence double, formal_count bigint, informal_count bigint",
    "ner_entities": "entity string, entity_type string, source string, confidence double, frequency bigint",
}

SUGGESTION = "struct<text:string,confidence:double,source:string>"
ERROR = f"struct<text:string,position:int,error_type:string,confidence:double,source_strategy:string,suggestions:array<{SUGGESTION}>>"
RESPONSE = f"text string, corrected_text string, has_errors boolean, level string, errors array<{ERROR}>, metadata map<string,string>"
