"""Queries: grammar checks, suppression, corruption and evaluation over all documents; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dataset, evaluate, grammar, suggest, suppress
from .corpus import GRAMS, TOK, WORDS, bigram_table, docs, word_table
from .script import _RAW_SQL, _SYL, V, W, script_errors, spelled, spelled_words, _variant_list

# Rule tables of the queries: name, schema, rows.
TABLES = {
    "typos": ("token string, left string, right string, fix string, confidence double", [("thhe", None, None, "the", 0.9), ("nd", None, None, "and", 0.85), ("th", "of", None, "the", 0.8), ("th", None, None, "they", 0.6), ("orre", None, "the", "or", 0.7), ("ou", "de", None, "où", 0.65)]),
    "frames": ("verb string, particle string", [("is", "that"), ("is", "the"), ("was", "the"), ("was", "a"), ("are", "of"), ("est", "la")]),
    "pairs": ("left string, right string, confidence double", [("of", "of", 0.9), ("the", "the", 0.95), ("de", "de", 0.8), ("the", "of", 0.7), ("la", "der", 0.6)]),
    "needs": ("token string, class string", [("that", "V"), ("la", "P"), ("der", "P")]),
    "classes": ("word string, class string", [("is", "V"), ("was", "V"), ("de", "P"), ("of", "P"), ("the", "D"), ("und", "C")]),
    "nouns": ("word string, class string", [("the", "x"), ("and", "y"), ("la", "y"), ("to", "x")]),
    "counters": ("word string, class string", [("the", "x"), ("of", "y"), ("a", "y"), ("der", "x")]),
    "endings": ("affirmative string, negative string", [("the", "not the"), ("of", "not of"), ("de", "ne de"), ("and", "nor")]),
    "adverbs": ("word string, tense string", [("that", "past"), ("this", "present"), ("then", "past"), ("for", "future")]),
    "markers": ("word string, tense string", [("was", "past"), ("is", "present"), ("be", "future"), ("are", "present")]),
    "marks": ("word string, register string, other string", [("the", "formal", "th"), ("der", "formal", "die"), ("is", "plain", "are"), ("und", "plain", "and"), ("que", "plain", "qui")]),
    "ranks": ("word string, rank int", [("is", 1), ("was", 1), ("be", 2), ("the", 3), ("of", 2)]),
    "links": ("linker string, partner string", [("that", "is"), ("und", "der"), ("for", "the")]),
    "low": ("kind string, min_frequency bigint, max_confidence double, without_fix boolean", [("particle_chain", 5000, 0.8, False), ("boundary", 3000, 0.6, False), ("aspect", 0, 0.9, True)]),
}
NO_START, NO_END = ("of", "and", "de", "que"), ("the", "a", "der", "to", "in", "la")
ENDS = ("e", "n", "s", "d", "t", "r")
NUMERALS = ("of", "de", "in")


def table(spark, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def _values(name: str) -> str:
    """The rule table as a part of a WITH."""
    schema, rows = TABLES[name]
    cols = [c.strip().split(" ") for c in schema.split(",")]
    lit = lambda v, t: f"CAST({'NULL' if v is None else repr(v) if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else v} AS {({'string': 'VARCHAR', 'double': 'DOUBLE', 'int': 'INTEGER', 'bigint': 'BIGINT', 'boolean': 'BOOLEAN'})[t]})"
    body = ", ".join("(" + ", ".join(lit(v, t) for v, (_, t) in zip(r, cols, strict=True)) + ")" for r in rows)
    return f'{name}({", ".join(chr(34) + c + chr(34) for c, _ in cols)}) AS (VALUES {body})'


K = rf"""k0 AS (SELECT doc_id, unnest(a) AS raw, unnest(range(0, len(a))) AS idx FROM (SELECT doc_id, {TOK} AS a FROM documents)),
k1 AS (SELECT *, coalesce(sum(CAST(regexp_matches(raw, '[.!?]$') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent, regexp_replace(raw, '[.,!?;:]+$', '') AS token FROM k0),
k AS (SELECT doc_id, CAST(idx AS INTEGER) AS idx, CAST(sent AS BIGINT) AS sent, token, lag(token, 2) OVER s AS prev2, lag(token) OVER s AS prev, lead(token) OVER s AS next FROM k1 WINDOW s AS (PARTITION BY doc_id, sent ORDER BY idx))"""


def near(spark, d) -> DataFrame:
    return grammar.sentences(docs(spark, d), "doc_id", text.words(F.col("text")))


def sentence_tokens(spark, d):
    return near(spark, d)


def typo_rules(spark, d):
    return grammar.word_rules(near(spark, d), "doc_id", table(spark, "typos"), "typo", 24)


def verb_particle(spark, d):
    return grammar.agreement(near(spark, d), "doc_id", table(spark, "frames"))


def particle_chains(spark, d):
    return grammar.chains(near(spark, d), "doc_id", table(spark, "pairs"))


def particle_constraints(spark, d):
    return grammar.constraints(near(spark, d), "doc_id", table(spark, "needs"), table(spark, "classes"))


def classifier_mismatch(spark, d):
    return grammar.classifiers(near(spark, d), "doc_id", table(spark, "nouns"), table(spark, "counters"), NUMERALS)


def negation_mismatch(spark, d):
    return grammar.negation(near(spark, d), "doc_id", "un", table(spark, "endings"))


def tense_mismatch(spark, d):
    return grammar.tense(near(spark, d), "doc_id", table(spark, "adverbs"), table(spark, "markers"))


def register_mixing(spark, d):
    return grammar.registers(near(spark, d), "doc_id", table(spark, "marks"))


def aspect_order(spark, d):
    return grammar.aspect(near(spark, d), "doc_id", table(spark, "ranks"))


def sentence_boundaries(spark, d):
    return grammar.boundaries(near(spark, d), "doc_id", NO_START, NO_END)


def sentence_structure(spark, d):
    return grammar.structure(near(spark, d), "doc_id", ENDS)


def merged_words(spark, d):
    return grammar.merged(near(spark, d), "doc_id", word_table(spark, d), bigram_table(spark, d))


def split_words(spark, d):
    return grammar.split(near(spark, d), "doc_id", word_table(spark, d), 20, 5)


def repeated_words(spark, d):
    return grammar.repeated(near(spark, d), "doc_id", ("that",))


def clause_linkage(spark, d):
    return grammar.linkage(near(spark, d), "doc_id", table(spark, "links"))


def _some(spark, d) -> list[DataFrame]:
    n = near(spark, d)
    return [grammar.chains(n, "doc_id", table(spark, "pairs")), grammar.boundaries(n, "doc_id", NO_START, NO_END), grammar.aspect(n, "doc_id", table(spark, "ranks")), grammar.repeated(n, "doc_id"), grammar.tense(n, "doc_id", table(spark, "adverbs"), table(spark, "markers"))]


def grammar_errors(spark, d):
    """All checks of a sentence, the best error of each place."""
    return grammar.resolve(_some(spark, d), "doc_id")


def low_value_grammar(spark, d):
    return suppress.low_value(grammar.resolve(_some(spark, d), "doc_id"), word_table(spark, d), table(spark, "low"))


def dominant_variants(spark, d):
    return grammar.dominant(spelled_words(spark, d), text.confusable_variants)


def syllable_windows(spark, d):
    """What two or three syllables in a row spell, of what is a word of its own five times or more."""
    parts = spelled(spark, d).select(text.syllables(F.col("text")).alias("s"))
    found = parts.select(F.explode(grammar.windows_of(F.col("s"), 2)).alias("word"), F.lit(2).alias("n")).unionByName(parts.select(F.explode(grammar.windows_of(F.col("s"), 3)).alias("word"), F.lit(3).alias("n")))
    counts = found.groupBy("word", "n").agg(F.count("*").alias("windows"))
    return counts.join(spelled_words(spark, d, 5), "word")


# ---------------------------------------------------------------- suppression


def _spans(spark, d) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for k, v in PRIORITY.items() for x in (k, v)])
    return script_errors(spark, d).withColumns({"priority": F.element_at(kinds, F.col("error_type")), "confidence": F.lit(0.9)}).drop("text")


PRIORITY = {"zero_width": 1, "broken_virama": 2, "medial_order": 3, "leading_e": 4, "vowel_before_medial": 5, "vowel_order": 6, "incomplete_stacking": 7, "duplicate_mark": 2, "vowel_after_dot": 4}
FRAGMENTS, CAUSES = ("incomplete_stacking", "vowel_order"), ("duplicate_mark", "broken_virama", "medial_order")


def near_errors_dropped(spark, d):
    return suppress.near_others(_spans(spark, d), "doc_id", FRAGMENTS, CAUSES)


def placeholders_dropped(spark, d):
    return suppress.placeholders(_spans(spark, d), "doc_id", ("incomplete_stacking",))


def boosted_errors(spark, d):
    return suppress.boost(_spans(spark, d), "doc_id", ("incomplete_stacking", "broken_virama"), ("duplicate_mark",))


def overlaps_dropped(spark, d):
    return suppress.overlaps(_spans(spark, d), "doc_id")


def merged_spans(spark, d):
    return suppress.merge_spans(_spans(spark, d), "doc_id")


def error_places(spark, d):
    return suppress.place_features(_spans(spark, d), "doc_id").select("doc_id", "error_type", "start", "end", "gap", "share")


# ---------------------------------------------------------------- corruption, evaluation


def script_corruptions(spark, d):
    """One synthetic error of each kind in every document, and the kind that its hash chooses."""
    t = F.col("text")
    made = {k: dataset.corrupt_script(t, k) for k in dataset.SCRIPT_KINDS}
    chosen = dataset.chosen_kind(F.col("doc_id").cast("string"))
    return spelled(spark, d).select("doc_id", *[F.md5(c).alias(k) for k, c in made.items()], chosen.alias("chosen"), F.md5(dataset.corrupted(t, F.col("doc_id").cast("string"))).alias("corrupted"))


def word_swaps(spark, d):
    """The first word of a table in each document, swapped for its counterpart."""
    w = text.words(F.col("text"))
    return docs(spark, d).select("doc_id", F.md5(F.array_join(dataset.swap_word(w, {"the": "then", "de": "des", "der": "die", "of": "off"}), " ")).alias("swapped"))


def _scores(spark, d) -> DataFrame:
    marks = F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]", ""))
    return docs(spark, d).join(docs(spark, d, "labels"), "doc_id").select("lang", (F.col("quality") == 0).alias("gold"), (marks / F.greatest(F.length("text"), F.lit(1))).alias("score"))


def auroc(spark, d):
    return evaluate.auroc(_scores(spark, d), ["lang"])


def score_statistics(spark, d):
    return evaluate.standard(_scores(spark, d), "score", ["lang"])


def run_comparison(spark, d):
    """Metrics of two runs side by side: with few marks and with many."""
    x = _scores(spark, d)
    runs = [evaluate.detection(x.select("lang", "gold", (F.col("score") > bar).alias("found")), ["lang"]) for bar in (0.02, 0.06)]
    return evaluate.compare(*runs, ["lang"], ["precision", "recall", "f1", "fpr"])


def compound_splits(spark, d):
    """Words of few uses as two commoner ones."""
    return suggest.split_in_two(word_table(spark, d), 2, 20)


def dictionary_insert(spark, d):
    """Words of the documents, and those of the benchmark that they lack: what is there already stays."""
    from ..operators import enrich, ngrams

    more = ngrams.token_counts(docs(spark, d, "benchmark"), text.words(F.col("text")), 1)
    return enrich.insert_new(word_table(spark, d), more, ["word"])


_E = 'CAST(NULL AS VARCHAR)'


def _err(kind: str, fix: str, confidence: str, priority: int, rest: str) -> str:
    return f"SELECT k.doc_id, k.idx, '{kind}' AS error_type, k.token AS text, {fix} AS fix, CAST({confidence} AS DOUBLE) AS confidence, {priority} AS priority FROM {rest}"


_CHAINS = _err("particle_chain", _E, "p.confidence", 16, 'k JOIN pairs p ON p."left" = k.prev AND p."right" = k.token')
_BOUND = _err("boundary", "''", "0.55", 12, f"k WHERE (prev IS NULL AND next IS NOT NULL AND token IN {NO_START}) OR (next IS NULL AND prev IS NOT NULL AND token IN {NO_END})")
_ASPECT = _err("aspect", _E, "0.6", 17, "k JOIN ranks a ON a.word = k.token JOIN ranks b ON b.word = k.prev WHERE b.rank >= a.rank")
_REPEAT = _err("repeated", "''", "0.6", 10, "k WHERE token = prev AND length(token) > 1")
_TENSE = _err("tense", _E, "0.7", 20, "k JOIN markers m ON m.word = k.token JOIN (SELECT doc_id, sent, list(tense) AS said FROM k JOIN adverbs a ON a.word = k.token GROUP BY ALL) s ON s.doc_id = k.doc_id AND s.sent = k.sent WHERE NOT list_contains(said, m.tense)")
_ALL = f"WITH {K}, {_values('pairs')}, {_values('ranks')}, {_values('adverbs')}, {_values('markers')}, every AS ({_CHAINS} UNION ALL {_BOUND} UNION ALL {_ASPECT} UNION ALL {_REPEAT} UNION ALL {_TENSE}), best AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY doc_id, idx ORDER BY priority DESC, confidence DESC, error_type) = 1)"
_PRIO = "CASE error_type " + " ".join(f"WHEN '{k}' THEN {p}" for k, p in PRIORITY.items()) + " END"
_S = _RAW_SQL.replace("SELECT doc_id, error_type, CAST(start AS INTEGER) AS start, CAST(\"end\" AS INTEGER) AS \"end\", text FROM f", f"s AS (SELECT doc_id, error_type, CAST(start AS INTEGER) AS start, CAST(\"end\" AS INTEGER) AS \"end\", {_PRIO} AS priority, CAST(0.9 AS DOUBLE) AS confidence FROM f)").replace(") s AS (", "), s AS (")
_CMP = """x AS (SELECT lang, quality = 0 AS gold, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::DOUBLE / greatest(length(text), 1) AS score FROM documents JOIN labels USING (doc_id))"""


def _runs(bar: float, name: str) -> str:
    return f"""{name} AS (SELECT lang, count(*) FILTER (gold AND f) AS tp, count(*) FILTER (NOT gold AND f) AS fp, count(*) FILTER (gold AND NOT f) AS fn, count(*) FILTER (NOT gold AND NOT f) AS tn FROM (SELECT lang, gold, score > {bar} AS f FROM x) GROUP BY lang),
{name}m AS (SELECT lang, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall, CASE WHEN fp + tn > 0 THEN fp::DOUBLE / (fp + tn) ELSE 0 END AS fpr FROM {name}),
{name}f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM {name}m)"""


def _first(table_: dict[str, str], x: str = "v") -> str:
    """The text with its first character of the table swapped."""
    at = f"(length({x}) - length(regexp_replace({x}, '^[^{''.join(table_)}]*', '')) + 1)"
    return f"CASE WHEN regexp_matches({x}, '[{''.join(table_)}]') THEN left({x}, {at} - 1) || " + "CASE " + f"{x}[{at}:{at}] " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table_.items()) + f" END || {x}[{at} + 1:] ELSE {x} END"


_MADE = {k: _first(t) for k, t in dataset.SCRIPT_KINDS.items()}
_KIND = f"CAST(CAST('0x' || left(md5(CAST(doc_id AS VARCHAR)), 8) AS UBIGINT) % {len(dataset.SCRIPT_KINDS)} AS INTEGER)"
_NAMES = list(dataset.SCRIPT_KINDS)
_SW = {"the": "then", "de": "des", "der": "die", "of": "off"}

SQL = {
    "sentence_tokens": f"WITH {K} SELECT * FROM k",
    "typo_rules": f"WITH {K}, {_values('typos')} {_err('typo', 'r.fix', 'r.confidence', 24, 'k JOIN typos r ON r.token = k.token WHERE (r.left IS NULL OR r.left = k.prev) AND (r.right IS NULL OR r.right = k.next) QUALIFY row_number() OVER (PARTITION BY k.doc_id, k.idx ORDER BY r.confidence DESC, r.fix) = 1')}",
    "verb_particle": f"WITH {K}, {_values('frames')} {_err('verb_particle', 'f.fix', '0.7', 14, '(SELECT * FROM k WHERE token IN (SELECT particle FROM frames)) k JOIN (SELECT verb, min(particle) AS fix FROM frames GROUP BY verb) f ON f.verb = k.prev WHERE NOT EXISTS (SELECT 1 FROM frames g WHERE g.verb = k.prev AND g.particle = k.token)')}",
    "particle_chains": f"WITH {K}, {_values('pairs')} {_CHAINS}",
    "particle_constraints": f"WITH {K}, {_values('needs')}, {_values('classes')} {_err('particle_constraint', _E, '0.65', 13, 'k JOIN needs n ON n.token = k.token LEFT JOIN classes c ON c.word = k.prev WHERE c.class IS NULL OR c.class <> n.class')}",
    "classifier_mismatch": f"WITH {K}, {_values('nouns')}, {_values('counters')} {_err('classifier', 'f.fix', '0.8', 18, f'(SELECT * FROM k WHERE prev IN {NUMERALS}) k JOIN nouns n ON n.word = k.prev2 JOIN counters c ON c.word = k.token LEFT JOIN (SELECT class, min(word) AS fix FROM counters GROUP BY class) f ON f.class = n.class WHERE c.class <> n.class')}",
    "negation_mismatch": f"WITH {K}, {_values('endings')}, m AS (SELECT *, max(CAST(token LIKE 'un%' AND length(token) > 2 AS INTEGER)) OVER (PARTITION BY doc_id, sent ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS denied FROM k) {_err('negation', 'e.negative', '0.75', 19, 'm k JOIN endings e ON e.affirmative = k.token WHERE denied = 1 AND next IS NULL')}",
    "tense_mismatch": f"WITH {K}, {_values('adverbs')}, {_values('markers')} {_TENSE}",
    "register_mixing": f"WITH {K}, {_values('marks')}, m AS (SELECT k.*, register, other, count(*) OVER (PARTITION BY doc_id, register) AS mine, count(*) OVER (PARTITION BY doc_id) AS every FROM k JOIN marks r ON r.word = k.token) {_err('register', 'other', '1 - mine::DOUBLE / every', 21, 'm k WHERE 2 * mine < every')}",
    "aspect_order": f"WITH {K}, {_values('ranks')} {_ASPECT}",
    "sentence_boundaries": f"WITH {K} {_BOUND}",
    "sentence_structure": f"WITH {K}, m AS (SELECT *, count(*) OVER (PARTITION BY doc_id, sent) AS n FROM k) {_err('structure', _E, '0.5', 11, 'm k WHERE n >= 5 AND next IS NULL AND NOT (' + ' OR '.join(f'token LIKE {chr(39)}%{e}{chr(39)}' for e in ENDS) + ')')}",
    "merged_words": f"WITH {K}, {GRAMS}, {WORDS}, j AS (SELECT w1 || w2 AS joined, w1 || ' ' || w2 AS fix FROM b WHERE cnt >= 5 QUALIFY row_number() OVER (PARTITION BY w1 || w2 ORDER BY cnt DESC, w1) = 1) {_err('merged', 'j.fix', '0.7', 15, 'k JOIN j ON j.joined = k.token LEFT JOIN w ON w.word = k.token WHERE coalesce(w.frequency, 0) <= 2')}",
    "split_words": f"WITH {K}, {WORDS} {_err('split', 'j.word', '0.7', 22, 'k JOIN w j ON j.word = k.token || k.next AND j.frequency >= 5 LEFT JOIN w a ON a.word = k.token LEFT JOIN w c ON c.word = k.next WHERE least(coalesce(a.frequency, 0), coalesce(c.frequency, 0)) < 20')}",
    "repeated_words": f"WITH {K} {_REPEAT} AND token <> 'that'",
    "clause_linkage": f"WITH {K}, {_values('links')} {_err('linkage', 'l.partner', '0.5', 9, 'k JOIN links l ON l.linker = k.token LEFT JOIN (SELECT doc_id, sent, token, max(idx) AS at FROM k GROUP BY ALL) p ON p.doc_id = k.doc_id AND p.sent = k.sent AND p.token = l.partner WHERE p.at IS NULL OR p.at <= k.idx')}",
    "grammar_errors": f"{_ALL} SELECT * FROM best",
    "low_value_grammar": f"{_ALL}, {_values('low')}, {WORDS} SELECT best.* FROM best LEFT JOIN low ON low.kind = error_type LEFT JOIN w ON w.word = text WHERE NOT coalesce(coalesce(w.frequency, 0) >= min_frequency AND confidence <= max_confidence AND (NOT without_fix OR fix IS NULL), false)",
    "dominant_variants": f"WITH {W}, x AS (SELECT word, frequency, unnest({_variant_list()}) AS v FROM w) SELECT x.word, v.variant AS variant, v.type AS type, o.frequency::DOUBLE / x.frequency AS ratio FROM x JOIN w o ON o.word = v.variant WHERE o.frequency >= 10 * x.frequency QUALIFY row_number() OVER (PARTITION BY x.word ORDER BY o.frequency DESC, v.variant, v.type) = 1",
    "syllable_windows": f"WITH {W}, {_SYL}, j AS (SELECT s || lead(s) OVER o AS two, s || lead(s) OVER o || lead(s, 2) OVER o AS three FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY k)), u AS (SELECT two AS word, 2 AS n FROM j UNION ALL SELECT three, 3 FROM j), g AS (SELECT word, n, count(*) AS windows FROM u WHERE word IS NOT NULL GROUP BY ALL) SELECT g.*, frequency FROM g JOIN w USING (word) WHERE frequency >= 5",
    "near_errors_dropped": f"""{_S}, m AS (SELECT *, max(CASE WHEN error_type IN {CAUSES} THEN "end" END) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, min(CASE WHEN error_type IN {CAUSES} THEN start END) OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY start, "end", error_type))
SELECT doc_id, error_type, start, "end", priority, confidence FROM m WHERE NOT (error_type IN {FRAGMENTS} AND (coalesce(start - b <= 1, false) OR coalesce(a - "end" <= 1, false)))""",
    "placeholders_dropped": f"""{_S} SELECT * FROM s WHERE NOT (error_type = 'incomplete_stacking' AND EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.start = s.start AND o.error_type <> 'incomplete_stacking'))""",
    "boosted_errors": f"""{_S}, m AS (SELECT *, max(CASE WHEN error_type = 'duplicate_mark' THEN "end" END) OVER (PARTITION BY doc_id ORDER BY start RANGE UNBOUNDED PRECEDING) AS r FROM s) SELECT doc_id, error_type, start, "end", priority, CASE WHEN error_type IN ('incomplete_stacking', 'broken_virama') AND r >= "end" THEN least(confidence + 0.05, 1.0) ELSE confidence END AS confidence FROM m""",
    "overlaps_dropped": f"""{_S}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority, start - "end", start, error_type) AS n FROM s) SELECT doc_id, error_type, start, "end", priority, confidence FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.doc_id = r.doc_id AND o.n < r.n AND o.start < r."end" AND r.start < o."end")""",
    "merged_spans": f"""{_S}, m AS (SELECT *, max("end") OVER (PARTITION BY doc_id, error_type ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM s), g AS (SELECT *, sum(CASE WHEN r IS NULL OR start > r THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, error_type ORDER BY start, "end") AS run FROM m) SELECT doc_id, error_type, min(start) AS start, max("end") AS "end", count(*) AS n FROM g GROUP BY doc_id, error_type, run""",
    "error_places": f"""{_S} SELECT doc_id, error_type, start, "end", start - lag("end") OVER o AS gap, row_number() OVER o / count(*) OVER (PARTITION BY doc_id)::DOUBLE AS share FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY start, "end", error_type)""",
    "script_corruptions": f"WITH {V}, m AS (SELECT doc_id, {', '.join(f'{e} AS x_{k}' for k, e in _MADE.items())}, {_KIND} AS c FROM v) SELECT doc_id, {', '.join(f'md5(x_{k}) AS "{k}"' for k in _NAMES)}, ({_NAMES})[c + 1] AS chosen, md5(([{', '.join(f'x_{k}' for k in _NAMES)}])[c + 1]) AS corrupted FROM m",
    "word_swaps": f"WITH x AS (SELECT doc_id, {TOK} AS a FROM documents), y AS (SELECT doc_id, a, coalesce(list_min(list_filter([{', '.join(f'list_position(a, {k!r})' for k in _SW)}], lambda z: z > 0)), 0) AS p FROM x) SELECT doc_id, md5(array_to_string(list_transform(a, lambda t, i: CASE WHEN i = p THEN CASE t {' '.join(f'WHEN {a!r} THEN {b!r}' for a, b in _SW.items())} END ELSE t END), ' ')) AS swapped FROM y",
    "auroc": f"WITH {_CMP}, r AS (SELECT lang, score, count(*) FILTER (gold) AS p, count(*) FILTER (NOT gold) AS q FROM x GROUP BY ALL), c AS (SELECT *, sum(q) OVER (PARTITION BY lang ORDER BY score) - q AS below FROM r) SELECT lang, sum(p * (below + q / 2.0::DOUBLE)) / nullif(sum(p) * sum(q), 0) AS auroc, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(q) AS BIGINT) AS negatives FROM c GROUP BY lang",
    "score_statistics": f"WITH {_CMP} SELECT lang, avg(score) AS mean, stddev_pop(score) AS deviation, count(*) AS n FROM x GROUP BY lang",
    "run_comparison": f"WITH {_CMP}, {_runs(0.02, 'a')}, {_runs(0.06, 'b')} SELECT a.lang, {', '.join(f'a.{m}::DOUBLE AS {m}_old, b.{m}::DOUBLE AS {m}_new, (b.{m} - a.{m})::DOUBLE AS {m}_change' for m in ('precision', 'recall', 'f1', 'fpr'))} FROM af a JOIN bf b USING (lang)",
    "compound_splits": f"WITH {WORDS}, q AS (SELECT word, unnest(range(2, length(word) - 1)) AS i FROM w WHERE frequency <= 2 AND length(word) >= 4), x AS (SELECT word, word[1:i] AS a, word[i + 1:] AS b FROM q) SELECT x.word, a.word AS part1, b.word AS part2, a.frequency * b.frequency AS uses FROM x JOIN w a ON a.word = x.a AND a.frequency >= 20 JOIN w b ON b.word = x.b AND b.frequency >= 20 QUALIFY row_number() OVER (PARTITION BY x.word ORDER BY a.frequency * b.frequency DESC, a.word) = 1",
    "dictionary_insert": f"WITH {WORDS}, n AS (SELECT word, count(*) AS frequency FROM (SELECT unnest({TOK}) AS word FROM benchmark) GROUP BY word) SELECT * FROM w UNION ALL SELECT * FROM n WHERE word NOT IN (SELECT word FROM w)",
}
QUERIES = {name: globals()[name] for name in SQL}
