"""Queries: detectors over the tokens of all documents, tags, and whole checks; each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import check, confusables, detect, enrich, exchange, ngrams, suggest, tags
from ..session import kept
from .corpus import _CONF, GRAMS, WORDS, bigram_table, docs, word_table
from .script import _RAW_SQL, W, spelled, spelled_words

def _lexicon(spark, d):
    words = word_table(spark, d, 3)
    return words, ngrams.conditional(bigram_table(spark, d, 3))


def token_places(spark, d):
    return detect.tokens(docs(spark, d), "doc_id", "text")


def _near(spark, d):
    return detect.near_tokens(docs(spark, d), "doc_id", "text", lower=True)


def unknown_words(spark, d):
    every = kept(word_table(spark, d))
    words, odd = every.filter("frequency >= 3"), every.filter("frequency < 3").select("word")
    toks = detect.tokens(docs(spark, d), "doc_id", "text").withColumn("token", F.lower("token"))
    best = suggest.rank(suggest.lookup(odd.toDF("query"), words, 1, prefix=24), 1)  # whole words as keys: fewer pairs that are no neighbours, the same neighbours
    return detect.unknown_words(toks, "doc_id", words, best, unknown=odd.toDF("token")).select("doc_id", "start", "end", "text", "fix")


def broken_compound_errors(spark, d):
    compounds = enrich.broken_compounds(bigram_table(spark, d), word_table(spark, d), 2, 1, 0.5)
    return detect.broken_compounds(_near(spark, d), "doc_id", compounds).select("doc_id", "start", "end", "fix", "confidence")


def hidden_compound_errors(spark, d):
    return detect.hidden_compounds(_near(spark, d), "doc_id", word_table(spark, d), 1.5).select("doc_id", "start", "end", "fix")


def homophone_errors(spark, d):
    pairs = kept(enrich.confusable_pairs(word_table(spark, d), 40))
    return confusables.homophones(docs(spark, d), "doc_id", "text", pairs).select("doc_id", "start", "text", "fix", "confidence")


def context_probability_errors(spark, d):
    return exchange.unlikely(docs(spark, d), "doc_id", "text", 2).withColumnRenamed("token", "text")


def tone_errors(spark, d):
    """Words of the documents in Myanmar letters that another final tone makes far commoner ones."""
    words = spelled_words(spark, d)
    toks = detect.tokens(spelled(spark, d), "doc_id", "text")
    return detect.tone_probes(toks, "doc_id", words, 20.0).select("doc_id", "start", "end", "text", "fix")


def question_errors(spark, d):
    return detect.question_ends(_near(spark, d), "doc_id", ("que", "who", "for"), ("e", "s", "n", "t")).select("doc_id", "start", "text", "fix")


def entity_errors(spark, d):
    """Rule errors that stand on no entity."""
    return detect.drop_entities(rule_table_errors(spark, d), spark.createDataFrame([("and",)], "entity string")).select("doc_id", "start", "end", "text", "fix", "confidence")


def cascade_errors(spark, d):
    """Of script errors of a kind in a row the first one."""
    from .script import script_errors

    return detect.drop_cascades(script_errors(spark, d), "doc_id", "vowel_before_medial", 1).select("doc_id", "error_type", "start", "end")


RULES = [("the", None, "the", "the", 0.9), ("and", None, None, "&", 0.2), ("of", "and", None, "", 0.5)]


def rule_table_errors(spark, d):
    rules = spark.createDataFrame(RULES, "token string, left string, right string, fix string, confidence double")
    return detect.by_table(_near(spark, d), "doc_id", rules, "rule", 24).select("doc_id", "start", "end", "text", "fix", "confidence")


def tag_sequence_errors(spark, d):
    rows = docs(spark, d, "conversations").select("conv_id", F.col("turn").alias("idx"), F.col("turn").cast("int").alias("start"), (F.col("turn") + 1).cast("int").alias("end"), F.col("role").alias("token"), F.col("role").alias("tag"))
    pairs = spark.createDataFrame([("user", "assistant", 0.9), ("user", "user", 0.8)], "tag1 string, tag2 string, severity double")
    return detect.invalid_tags(rows, "conv_id", pairs).select("conv_id", "start", "text", "confidence")


def viterbi_tags(spark, d):
    rows = spark.createDataFrame([(1, ["the", "dog", "runs"]), (2, ["dog"]), (3, []), (4, ["xx", "runs"])], "id int, words array<string>")
    trans = {("", "D"): 0.6, ("", "N"): 0.3, ("", "V"): 0.1, ("D", "N"): 0.9, ("D", "V"): 0.1, ("N", "V"): 0.7, ("N", "N"): 0.2, ("V", "D"): 0.5}
    emit = {"the": {"D": 1.0}, "dog": {"N": 0.8, "V": 0.2}, "runs": {"V": 0.7, "N": 0.3}}
    return tags.viterbi(rows, trans, emit, ["D", "N", "V"]).select("id", F.array_join("tags", " ").alias("tags"))


def tag_disambiguation(spark, d):
    rows = spark.createDataFrame([(1, 0, ["N", "V"]), (1, 1, ["PPM"]), (1, 2, ["N", "V"]), (2, 0, ["ADV", "N"]), (2, 1, ["V"])], "s int, i int, tags array<string>")
    return tags.disambiguate(rows, "s", "i").select("s", "i", "tag")


def check_documents(spark, d):
    words, bigrams = _lexicon(spark, d)
    rows = docs(spark, d)
    found = check.errors(rows, words, bigrams, "doc_id", "text", compounds=enrich.broken_compounds(bigram_table(spark, d), word_table(spark, d), 5, 2, 0.5), level="context")
    return check.respond(rows, found, "doc_id", "text", "context").select("doc_id", "corrected_text", "has_errors", "level", F.size("errors").alias("n_errors"))


D = r"""dx AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+') AS w, regexp_split_to_array(coalesce(text, ''), '[^ \t\n\r]+') AS g FROM documents),
dy AS (SELECT doc_id, unnest(w) AS token, unnest(g[1:len(w)]) AS gap, unnest(range(0, len(w))) AS idx FROM dx),
dz AS (SELECT doc_id, CAST(idx AS INTEGER) AS idx, token, CAST(length(token) AS INTEGER) AS l, CAST(sum(length(gap) + length(token)) OVER (PARTITION BY doc_id ORDER BY idx) AS INTEGER) AS "end" FROM dy),
dn AS (SELECT doc_id, idx, lower(token) AS token, "end" - l AS start, "end", lower(lag(token) OVER o) AS prev, lower(lead(token) OVER o) AS next, lead("end") OVER o AS next_end FROM dz WINDOW o AS (PARTITION BY doc_id ORDER BY idx))"""
_PROB = "bp AS (SELECT w1, w2, round(cnt::DOUBLE / sum(cnt) OVER (PARTITION BY w1), 6) AS probability FROM b WHERE cnt >= {least})"
_RULES = "rules(token, l, r, fix, confidence) AS (VALUES " + ", ".join("(" + ", ".join("CAST(NULL AS VARCHAR)" if x is None else repr(x) for x in row) + ")" for row in RULES) + ")"
_RULED = 'SELECT doc_id, start, "end", n.token AS text, fix, confidence::DOUBLE AS confidence FROM dn n JOIN rules u ON u.token = n.token WHERE (l IS NULL OR l = prev) AND (r IS NULL OR r = next)'
SQL = {
    "token_places": f'WITH {D} SELECT doc_id, idx, token, "end" - l AS start, "end" FROM dz',
    "broken_compound_errors": f"WITH {D}, {GRAMS}, {WORDS}, s AS (SELECT sum(frequency)::DOUBLE AS total FROM w), x AS (SELECT w1 || w2 AS compound, w1, w2, cnt, log2((cnt / total) / ((a.frequency / total) * (c.frequency / total))) AS pmi FROM b, s, w a, w c, w k WHERE a.word = w1 AND c.word = w2 AND k.word = w1 || w2 AND k.frequency >= 2), m AS (SELECT * FROM x WHERE pmi >= 0.5 QUALIFY row_number() OVER (PARTITION BY compound ORDER BY cnt DESC, w1) = 1) SELECT doc_id, start, next_end AS \"end\", compound AS fix, least(0.5 + pmi / 20, 0.95::DOUBLE) AS confidence FROM dn JOIN m ON m.w1 = token AND m.w2 = next",
    "hidden_compound_errors": f"WITH {D}, {WORDS} SELECT doc_id, start, next_end AS \"end\", j.word AS fix FROM dn JOIN w j ON j.word = token || next LEFT JOIN w a ON a.word = token LEFT JOIN w c ON c.word = next WHERE j.frequency >= 1.5 * (least(coalesce(a.frequency, 0), coalesce(c.frequency, 0)) + 1)",
    "homophone_errors": f"WITH {D}, {GRAMS}, {WORDS}, {_CONF.format(least=40)}, {_PROB.format(least=1)}, v AS (SELECT w1 AS token, w2 AS other FROM q WHERE freq_ratio <= 1000 UNION ALL SELECT w2, w1 FROM q WHERE freq_ratio <= 1000), x AS (SELECT doc_id, idx, start, dn.token, other, (coalesce(e.probability, 1e-6) * coalesce(f.probability, 1e-6)) / (coalesce(g.probability, 1e-6) * coalesce(h.probability, 1e-6)) AS ratio FROM dn JOIN v ON v.token = dn.token LEFT JOIN bp e ON e.w1 = prev AND e.w2 = other LEFT JOIN bp f ON f.w1 = other AND f.w2 = next LEFT JOIN bp g ON g.w1 = prev AND g.w2 = dn.token LEFT JOIN bp h ON h.w1 = dn.token AND h.w2 = next) SELECT doc_id, start, token AS text, other AS fix, 0.5 + 0.45 * least(log10(ratio) / 6, 1.0::DOUBLE) AS confidence FROM x WHERE ratio >= 5 QUALIFY row_number() OVER (PARTITION BY doc_id, idx ORDER BY ratio DESC, other) = 1",
    "context_probability_errors": f"WITH {D}, {GRAMS}, {_PROB.format(least=2)} SELECT doc_id, start, \"end\", token AS text FROM dn LEFT JOIN bp l ON l.w1 = prev AND l.w2 = token LEFT JOIN bp r ON r.w1 = token AND r.w2 = next WHERE (prev IS NOT NULL OR next IS NOT NULL) AND (prev IS NULL OR coalesce(l.probability, 0) < 0.001) AND (next IS NULL OR coalesce(r.probability, 0) < 0.001)",
    "rule_table_errors": f"WITH {D}, {_RULES} {_RULED}",
    "entity_errors": f"WITH {D}, {_RULES}, x AS ({_RULED}) SELECT * FROM x WHERE text <> 'and'",
    "tone_errors": f"""WITH {W}, vx AS (SELECT doc_id, regexp_extract_all(v, '[^ \\t\\n\\r]+') AS w, regexp_split_to_array(v, '[^ \\t\\n\\r]+') AS g FROM v), vy AS (SELECT doc_id, unnest(w) AS token, unnest(g[1:len(w)]) AS gap, unnest(range(0, len(w))) AS idx FROM vx),
vz AS (SELECT doc_id, idx, token, CAST(sum(length(gap) + length(token)) OVER (PARTITION BY doc_id ORDER BY idx) AS INTEGER) AS e FROM vy), b0 AS (SELECT DISTINCT token, regexp_replace(token, '[့း]$', '') AS bare FROM vz), c AS (SELECT token, unnest([bare, bare || '့', bare || 'း']) AS variant FROM b0),
f AS (SELECT token, variant, x.frequency AS fv FROM c JOIN w x ON x.word = variant LEFT JOIN w y ON y.word = token WHERE variant <> token AND variant <> '' AND x.frequency >= 20 * (coalesce(y.frequency, 0) + 1) QUALIFY row_number() OVER (PARTITION BY token ORDER BY x.frequency DESC, variant) = 1)
SELECT doc_id, e - CAST(length(token) AS INTEGER) AS start, e AS "end", token AS text, variant AS fix FROM vz JOIN f USING (token)""",
    "question_errors": f"WITH {D}, m AS (SELECT *, max(CAST(token IN ('que', 'who', 'for') AS INTEGER)) OVER (PARTITION BY doc_id) AS asks FROM dn) SELECT doc_id, start, token AS text, token || 'e' AS fix FROM m WHERE asks = 1 AND next IS NULL AND NOT regexp_matches(token, '[esnt]$')",
    "cascade_errors": _RAW_SQL.replace("SELECT doc_id, error_type, CAST(start", "SELECT doc_id, error_type, start, \"end\" FROM (SELECT doc_id, error_type, CAST(start") + ") QUALIFY error_type <> 'vowel_before_medial' OR coalesce(start - lag(\"end\") OVER (PARTITION BY doc_id, error_type ORDER BY start) > 1, true)",
    "tag_sequence_errors": "WITH x AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) SELECT conv_id, CAST(turn AS INTEGER) AS start, role AS text, CASE role WHEN 'assistant' THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM x WHERE p = 'user' AND role IN ('assistant', 'user')",
}
QUERIES = {
    f.__name__: f
    for f in (
        token_places, unknown_words, broken_compound_errors, hidden_compound_errors, homophone_errors, context_probability_errors, rule_table_errors, tag_sequence_errors, tone_errors, question_errors, entity_errors, cascade_errors, viterbi_tags, tag_disambiguation, check_documents,
    )
}
