"""Queries: forms of words, probes of token and syllable runs, compounds with edits, reranking; each but the compounds with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import detect, grammar, joint, ngrams, probes, suggest, tags
from ..session import kept
from .checks import _CAND, _P2, _candidates
from .corpus import GRAMS, ONE_BYTE, WORDS, bigram_table, docs, word_table
from .grammar import K, near
from .script import _RAW_SQL, _SYL, V, W, _breaks, script_errors, spelled, spelled_words, syllable_counts, valid_syllables

PAIRS = [("is", "was"), ("was", "is"), ("the", "that"), ("that", "the"), ("der", "die"), ("die", "der"), ("la", "le"), ("de", "en"), ("of", "to"), ("to", "of"), ("and", "in")]
RULES = [(None, "the", 2), (None, "de", 1), ("dela", "de", 3), ("ofthe", None, 1), ("thhe", "the", 1)]
#: Tags of words by their end.
ENDS = (("S", "[.!?]$"), ("D", "[0-9]$"), ("V", "[aeiou]$"), ("C", "[a-z]$"))
#: Initials as in the operator, and what capitals and small letters are spelled with.
INITIALS = probes.ASPIRATED | {"ဘ": "ဗ", "ဓ": "ဒ", "ဆ": "စ"}


def word_forms(spark, d):
    """Distinct words that a wrong cut left over, with the name of their form."""
    return spelled_words(spark, d).select("word", probes.form_of(F.col("word")).alias("form")).filter("form is not null")


def truncated_words(spark, d):
    return probes.truncated(spelled_words(spark, d), ratio=2.0)


def moved_places(spark, d):
    """Places of the detectors' matches in the text without zero-width characters."""
    gone = detect.by_patterns(spelled(spark, d), "doc_id", "text", [p for p in detect.RAW if p[0] == "zero_width"])
    return probes.moved(script_errors(spark, d).drop("text"), "doc_id", ["start", "end"], gone)


def space_errors(spark, d):
    return probes.across_spaces(near(spark, d), "doc_id", word_table(spark, d), 5, 20)


def merge_errors(spark, d):
    return probes.merges(near(spark, d), "doc_id", word_table(spark, d), 20, 3)


def compound_lookup(spark, d):
    """Words of one use as words of 20 or more, one edit in each."""
    words = kept(word_table(spark, d).filter("frequency = 1 or frequency >= 20"))
    return probes.lookup_compound(words.filter("frequency = 1").select(F.col("word").alias("string")), words, 1, 20)


def _ranked(spark, d):
    """Candidates of the benchmark's unknown tokens, in their sentences, most frequent first."""
    ranked = suggest.rank_by(_candidates(spark, d), "frequency", 5).select(F.col("query").alias("token"), "term", "rank")
    return grammar.sentences(docs(spark, d, "benchmark"), "item_id", text.words(F.col("text"))).join(ranked, "token").select("item_id", "idx", "prev", F.col("token").alias("query"), "next", "term", "rank")


def context_reranked(spark, d):
    got = probes.rerank_context(_ranked(spark, d), ["item_id", "idx"], ngrams.conditional(bigram_table(spark, d, 5)))
    return got.select("item_id", "idx", "query", "term", "rank", "context", "score", "place")


def rule_reranked(spark, d):
    rules = spark.createDataFrame(RULES, "query string, term string, step int")
    return probes.rerank_rules(_ranked(spark, d).select("item_id", "idx", "query", "term", "rank"), ["item_id", "idx"], rules)


def pair_errors(spark, d):
    pairs = spark.createDataFrame(PAIRS, "word string, variant string")
    return probes.mined_pairs(near(spark, d), "doc_id", pairs, ngrams.conditional(bigram_table(spark, d, 5)))


def syllable_merges(spark, d):
    """Invalid syllables of all documents; side by side they may be a word, or a valid syllable with a mark."""
    rows = spelled(spark, d).select("doc_id", F.posexplode(text.syllables(F.col("text"))).alias("at", "syllable")).filter("syllable rlike '[က-၏]'")
    valid = valid_syllables(spark, d).select("syllable")
    return probes.joined_syllables(rows.join(valid, "syllable", "left_anti"), "doc_id", valid, spelled_words(spark, d))


def swapped_initials(spark, d):
    """Syllables of fewer than 20 uses that are commoner ones with an aspirated initial."""
    every = syllable_counts(spark, d)
    return probes.swapped_initial(every, every.filter("frequency >= 20"), 20, INITIALS)


def _tagger(spark, d):
    """Emissions and tag model of the documents, each word tagged by its end."""
    rows = docs(spark, d).select("doc_id", F.posexplode(text.words(F.col("text"))).alias("i", "word"))
    tagged = rows.withColumn("tag", F.coalesce(*[F.when(F.col("word").rlike(p), F.lit(t)) for t, p in ENDS], F.lit("X")))
    own = tags.histogram(tagged, "word", "tag", 0.0)
    emissions = own.withColumn("p", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("word"))).select("word", "tag", "p")
    seq = tags.sequences(tagged, "doc_id", ["i"], "tag")
    model = joint.tag_model(tags.unigram(seq), tags.bigram_laplace(seq), tags.trigram_laplace(seq))
    return emissions, model


def trigram_tags(spark, d):
    """Tags of all words of the benchmark under interpolated trigrams of the documents."""
    emissions, model = _tagger(spark, d)
    rows = docs(spark, d, "benchmark").select("item_id", text.words(F.col("text")).alias("words"))
    return joint.tag(rows, "item_id", emissions, model).select("item_id", F.size("words").cast("long").alias("n"), F.array_join("tags", " ").alias("tags"))


def joint_tags(spark, d):
    """Words and tags of the benchmark's words, written together three by three."""
    emissions, model = _tagger(spark, d)
    three = docs(spark, d, "benchmark").select(F.explode(grammar.windows_of(text.words(F.col("text")), 3)).alias("string")).distinct()
    got = joint.segment_and_tag(three, word_table(spark, d, 5), emissions, model)
    return got.select("string", F.array_join("words", " ").alias("words"), F.array_join("tags", " ").alias("tags"))


_FORM = "CASE " + " ".join(f"WHEN regexp_matches(word, '{p}') THEN '{n}'" for n, p in probes.FRAGMENTS + probes.INCOMPLETE + probes.WRONG_START) + " END"
_VALID = f"vs AS (SELECT s AS syllable, count(*) AS frequency FROM s WHERE regexp_matches(s, '[က-၏]') GROUP BY s HAVING {_breaks('s')} = '')"
_BK = K.replace("documents", "benchmark").replace("doc_id", "item_id")
_RANKED = f"r AS (SELECT query, term, CAST(row_number() OVER (PARTITION BY query ORDER BY frequency DESC, term) AS INTEGER) AS rank FROM cand QUALIFY rank <= 5), c AS (SELECT item_id, idx, prev, query, next, term, rank FROM k0_ JOIN r ON query = token)"
_IN_PLACE = f"{_BK.replace('k AS (', 'k0_ AS (')}, {_CAND}, {_RANKED}"
_KEYS = lambda x: f"list_distinct(list_filter([{x}] || list_transform(range(1, length({x}) + 1), lambda i: {x}[1:i - 1] || {x}[i + 1:]), lambda z: z <> ''))"
_LOG = lambda c: f"ln(greatest(coalesce({c}, 0.0::DOUBLE), 0.000001::DOUBLE))"
_quoted = lambda v: "NULL" if v is None else repr(v)
_PAIRS = "cp(word, variant) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PAIRS) + ")"
_RULES = "ru(query, term, step) AS (VALUES " + ", ".join(f"({_quoted(a)}, {_quoted(b)}, {c})" for a, b, c in RULES) + ")"

SQL = {
    "word_forms": f"WITH {W}, x AS (SELECT word, {_FORM} AS form FROM w) SELECT * FROM x WHERE form IS NOT NULL",
    "truncated_words": f"WITH {W}, x AS (SELECT word, frequency, word || unnest([{', '.join(map(repr, probes.ENDINGS))}]) AS complete FROM w WHERE regexp_matches(word, '[{text.CONSONANTS}]$')) SELECT x.word, complete, o.frequency / x.frequency::DOUBLE AS ratio FROM x JOIN w o ON o.word = complete WHERE o.frequency >= 2 * x.frequency QUALIFY row_number() OVER (PARTITION BY x.word ORDER BY o.frequency DESC, complete) = 1",
    "moved_places": f"""WITH e AS ({_RAW_SQL}), z AS (SELECT doc_id, start AS s, "end" AS t FROM e WHERE error_type = 'zero_width'), p AS (SELECT doc_id, start AS pos FROM e UNION SELECT doc_id, "end" FROM e),
m AS (SELECT p.doc_id, pos, CAST(pos - coalesce(sum(least(t, pos) - s), 0) AS INTEGER) AS np FROM p LEFT JOIN z ON z.doc_id = p.doc_id AND s < pos GROUP BY p.doc_id, pos)
SELECT e.doc_id, error_type, start, "end", a.np AS new_start, b.np AS new_end FROM e JOIN m a ON a.doc_id = e.doc_id AND a.pos = start JOIN m b ON b.doc_id = e.doc_id AND b.pos = "end" """,
    "space_errors": f"""WITH {K}, {WORDS}, o AS (SELECT k.*, coalesce(frequency, 0) AS own FROM k LEFT JOIN w ON w.word = token),
l AS (SELECT *, lead(token) OVER s AS t1, lead(token, 2) OVER s AS t2, lead(own) OVER s AS o1, lead(own, 2) OVER s AS o2 FROM o WINDOW s AS (PARTITION BY doc_id, sent ORDER BY idx)),
ok AS (SELECT *, length(token) BETWEEN 1 AND 15 AND length(t1) BETWEEN 1 AND 15 AS two FROM l),
h AS (SELECT doc_id, sent, idx, 3 AS n, token || t1 || t2 AS word, token || ' ' || t1 || ' ' || t2 AS text FROM ok WHERE two AND length(t2) BETWEEN 1 AND 15 AND least(own, o1, o2) < 20
  UNION ALL SELECT doc_id, sent, idx, 2, token || t1, token || ' ' || t1 FROM ok WHERE two AND least(own, o1) < 20),
g AS (SELECT doc_id, list([{{'idx': idx, 'n': n, 'word': word, 'text': text}}] ORDER BY n DESC, idx) AS hits FROM h WHERE word IN (SELECT word FROM w WHERE frequency >= 5) GROUP BY doc_id, sent),
u AS (SELECT doc_id, unnest(list_reduce(hits, lambda a, z: CASE WHEN len(list_filter(a, lambda y: y.idx < z[1].idx + z[1].n AND z[1].idx < y.idx + y.n)) = 0 THEN a || z ELSE a END)) AS e FROM g)
SELECT doc_id, e.idx AS idx, 'broken_compound' AS error_type, e.text AS text, e.word AS fix, 0.8::DOUBLE AS confidence, 21 AS priority FROM u""",
    "merge_errors": f"""WITH {K}, {WORDS}, x AS (SELECT k.*, token || next AS string FROM k LEFT JOIN w a ON a.word = token LEFT JOIN w b ON b.word = next WHERE token <> '' AND next <> '' AND least(coalesce(a.frequency, 0), coalesce(b.frequency, 0)) < 3 AND length(token || next) <= 24),
a AS (SELECT DISTINCT string FROM x WHERE string NOT IN (SELECT word FROM w)), ak AS (SELECT string, unnest({_KEYS('string')}) AS key FROM a), tk AS (SELECT word AS term, frequency, unnest({_KEYS('word')}) AS key FROM w WHERE frequency >= 20),
f AS (SELECT DISTINCT string, term, frequency FROM ak JOIN tk USING (key) WHERE damerau_levenshtein({ONE_BYTE('string')}, {ONE_BYTE('term')}) <= 1),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY string ORDER BY frequency DESC, term) = 1)
SELECT doc_id, idx, 'merge' AS error_type, token || ' ' || next AS text, term AS fix, 0.7::DOUBLE AS confidence, 46 AS priority FROM x JOIN b USING (string)""",
    "context_reranked": f"""WITH {WORDS}, {GRAMS}, {_P2}, {_IN_PLACE},
f AS (SELECT c.*, coalesce(l.probability, 0) + coalesce(x.probability, 0) AS fit FROM c LEFT JOIN p2 l ON l.w1 = prev AND l.w2 = term LEFT JOIN p2 x ON x.w1 = term AND x.w2 = next),
m AS (SELECT *, CASE WHEN max(fit) OVER z > 0 THEN fit / max(fit) OVER z ELSE 0 END::DOUBLE AS context, count(*) OVER z AS n FROM f WINDOW z AS (PARTITION BY item_id, idx)),
s AS (SELECT *, 0.5::DOUBLE * (1 - (rank - 1)::DOUBLE / n) + 0.5::DOUBLE * context AS score FROM m)
SELECT item_id, idx, query, term, rank, context, score, CAST(row_number() OVER (PARTITION BY item_id, idx ORDER BY score DESC, rank) AS INTEGER) AS place FROM s""",
    "rule_reranked": f"""WITH {WORDS}, {_IN_PLACE}, {_RULES}, s AS (SELECT item_id, idx, c.query, c.term, rank, coalesce(max(step), 0) AS step FROM c LEFT JOIN ru ON (ru.query IS NULL OR ru.query = c.query) AND (ru.term IS NULL OR ru.term = c.term) GROUP BY ALL)
SELECT item_id, idx, query, term, rank, CAST(row_number() OVER (PARTITION BY item_id, idx ORDER BY rank - step, step DESC, rank) AS INTEGER) AS place FROM s""",
    "pair_errors": f"""WITH {K}, {GRAMS}, {_P2}, {_PAIRS}, x AS (SELECT k.doc_id, k.idx, token, variant, {_LOG('ql.probability')} + {_LOG('qr.probability')} - {_LOG('pl.probability')} - {_LOG('pr.probability')} AS gain FROM k JOIN cp ON cp.word = token
  LEFT JOIN p2 pl ON pl.w1 = prev AND pl.w2 = token LEFT JOIN p2 pr ON pr.w1 = token AND pr.w2 = next LEFT JOIN p2 ql ON ql.w1 = prev AND ql.w2 = variant LEFT JOIN p2 qr ON qr.w1 = variant AND qr.w2 = next)
SELECT doc_id, idx, 'confusable_pair' AS error_type, token AS text, variant AS fix, least(0.5::DOUBLE + gain / 20, 0.95::DOUBLE) AS confidence, 49 AS priority FROM x WHERE gain >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id, idx ORDER BY gain DESC, variant) = 1""",
    "syllable_merges": f"""WITH {W}, {_SYL}, {_VALID}, a AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos FROM s),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM a WHERE regexp_matches(s, '[က-၏]') AND s NOT IN (SELECT syllable FROM vs)),
nx AS (SELECT *, s || lead(s) OVER (PARTITION BY doc_id, run ORDER BY pos) AS two FROM i),
h AS (SELECT *, CASE WHEN two IN (SELECT word FROM w) THEN 'word' WHEN two || '{text.ASAT}' IN (SELECT syllable FROM vs) THEN 'joined' END AS v FROM nx),
m AS (SELECT *, sum(CAST(v IS NULL AS INTEGER)) OVER (PARTITION BY doc_id, run ORDER BY pos) AS miss FROM h),
tk AS (SELECT *, v IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, run, miss, v IS NOT NULL ORDER BY pos) % 2 = 1 AS taken FROM m),
z AS (SELECT *, coalesce(lag(taken) OVER (PARTITION BY doc_id, run ORDER BY pos), false) AS second FROM tk)
SELECT doc_id, CAST(pos AS INTEGER) AS "at", CASE WHEN taken THEN two ELSE s END AS syllable, CASE WHEN taken THEN v END AS verdict, CASE WHEN taken AND v = 'joined' THEN two || '{text.ASAT}' END AS fix FROM z WHERE NOT second""",
    "swapped_initials": f"WITH {V}, {_SYL}, f AS (SELECT s AS syllable, count(*) AS frequency FROM s WHERE regexp_matches(s, '[က-၏]') GROUP BY s), y AS (SELECT syllable, CASE syllable[1:1] {' '.join(f'WHEN {a!r} THEN {b!r}' for a, b in INITIALS.items())} END || syllable[2:] AS fix FROM f WHERE frequency < 20) SELECT y.syllable, fix, f.frequency FROM y JOIN f ON f.syllable = fix WHERE f.frequency >= 20",
}
QUERIES = {name: globals()[name] for name in SQL} | {"compound_lookup": compound_lookup, "trigram_tags": trigram_tags, "joint_tags": joint_tags}
