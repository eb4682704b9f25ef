"""Queries: corpus to dictionary, and enrichment; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distance, text
from ..operators import dataset, enrich, ngrams

TOK = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\r]+'), lambda x: x <> '')"
#: SQL's distances count bytes; lower-cased words have no capitals, so these stand for letters of two bytes.
ONE_BYTE = lambda x: f"translate({x}, 'éóèñçüêäöíßáúàâîôûëïœæåøãõ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
FORMAL, INFORMAL = ("the", "der", "la", "le"), ("is", "und", "que", "et")
QUALITY = r"regexp_full_match(word, '\p{L}+') AND length(word) BETWEEN 2 AND 40 AND NOT regexp_matches(word, 'aaaa|bbbb|cccc|dddd|eeee|ffff|gggg|hhhh|iiii|jjjj|kkkk|llll|mmmm|nnnn|oooo|pppp|qqqq|rrrr|ssss|tttt|uuuu|vvvv|wwww|xxxx|yyyy|zzzz|ßßßß|ääää|éééé|èèèè|êêêê|çççç|öööö|üüüü|óóóó|íííí|ññññ|úúúú|áááá')"
WORDS = f"w AS (SELECT word, count(*) AS frequency FROM (SELECT unnest({TOK}) AS word FROM documents) GROUP BY word)"
GRAMS = f"""t AS (SELECT doc_id, {TOK} AS a FROM documents),
p AS (SELECT doc_id, unnest(a) AS w, unnest(range(1, len(a) + 1)) AS i FROM t),
g AS (SELECT w AS w1, lead(w, 1) OVER d AS w2, lead(w, 2) OVER d AS w3 FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT w1, w2, count(*) AS cnt FROM g WHERE w2 IS NOT NULL GROUP BY w1, w2)"""


def docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _tokens():
    return text.words(F.col("text"))


def word_table(spark: SparkSession, sf_dir: str, min_count: int = 1) -> DataFrame:
    return ngrams.token_counts(docs(spark, sf_dir), _tokens(), min_count)


def bigram_table(spark: SparkSession, sf_dir: str, min_count: int = 1) -> DataFrame:
    return ngrams.ngram_counts(ngrams.windows(docs(spark, sf_dir), _tokens(), 2), 2, min_count)


def trigram_table(spark: SparkSession, sf_dir: str, min_count: int = 1) -> DataFrame:
    return ngrams.ngram_counts(ngrams.windows(docs(spark, sf_dir), _tokens(), 3), 3, min_count)


def token_counts(spark, d):
    return word_table(spark, d)


def word_counts_quality(spark, d):
    return ngrams.token_counts(docs(spark, d), _tokens(), 5, blacklist=("the", "und")).filter(ngrams.is_quality(F.col("word")))


def bigram_counts(spark, d):
    return bigram_table(spark, d, 10)


def bigram_probabilities(spark, d):
    return ngrams.conditional(bigram_table(spark, d, 10))


def bigram_counts_vocabulary(spark, d):
    vocabulary = word_table(spark, d, 50).filter(ngrams.is_quality(F.col("word")))
    return ngrams.ngram_counts(ngrams.windows(docs(spark, d), _tokens(), 3, blacklist=("of", "die")), 2, 5, vocabulary)


def trigram_counts(spark, d):
    return trigram_table(spark, d, 5)


def trigram_probabilities(spark, d):
    return ngrams.conditional(trigram_table(spark, d, 5))


def fourgram_counts(spark, d):
    return ngrams.ngram_counts(ngrams.windows(docs(spark, d), _tokens(), 4), 4, 4)


def fivegram_counts(spark, d):
    return ngrams.ngram_counts(ngrams.windows(docs(spark, d), _tokens(), 5), 5, 4)


def top_continuations(spark, d):
    return ngrams.top_continuations(ngrams.conditional(bigram_table(spark, d, 5)), 5)


def bigram_load_limit(spark, d):
    return ngrams.load_limit(bigram_table(spark, d, 5), 500)


def table_stats(spark, d):
    return ngrams.table_stats(bigram_table(spark, d, 10))


def quality_report(spark, d):
    return ngrams.quality_report(docs(spark, d), _tokens())


def frequency_denominator(spark, d):
    return ngrams.frequency_denominator(word_table(spark, d))


def collocations(spark, d):
    return enrich.collocations(bigram_table(spark, d), word_table(spark, d), 10, min_pmi=1.0)


def broken_compounds(spark, d):
    return enrich.broken_compounds(bigram_table(spark, d), word_table(spark, d), min_compound=2, min_split=1, min_pmi=0.5)


def register_tags(spark, d):
    return enrich.register_tags(bigram_table(spark, d), FORMAL, INFORMAL, 20)


def confusable_pairs(spark, d):
    return enrich.confusable_pairs(word_table(spark, d), 20)


def left_context_cosine(spark, d):
    pairs = enrich.confusable_pairs(word_table(spark, d), 40).select("w1", "w2")
    return enrich.left_context_cosine(pairs, bigram_table(spark, d))


def ingest_filter(spark, d):
    pages = docs(spark, d, "pages").withColumn("ratio", text.script_ratio(F.regexp_replace("html", "<[^>]*>", " "), "a-zA-Z"))
    return pages.filter("ratio >= 0.6").select("page_id", "ratio")


def script_ratio(spark, d):
    return docs(spark, d).select("doc_id", text.script_ratio(F.col("text"), "a-z").alias("ratio"))


def line_dedup(spark, d):
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter("trim(line) <> ''")
    return dataset.dedup_lines(lines, "line", ["doc_id", "line_no"])


def ledger_antijoin(spark, d):
    seen = docs(spark, d).filter("doc_id % 3 = 0").select("doc_id", "n_chars")
    now = docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n_chars"), "source")
    return now.join(seen, ["doc_id", "n_chars"], "left_anti").select("doc_id", "n_chars", "source")


def dictionary_upsert(spark, d):
    half = lambda c: ngrams.token_counts(docs(spark, d).filter(c), _tokens())
    return enrich.upsert(half("doc_id % 2 = 0"), half("doc_id % 2 = 1"), ["word"], ("frequency",))


def levenshtein_pairs(spark, d):
    w = word_table(spark, d, 60).filter("length(word) between 4 and 8").select("word")
    pairs = enrich.confusable_pairs(word_table(spark, d), 60, float("inf")).select("w1", "w2")
    return pairs.join(w.withColumnRenamed("word", "w1"), "w1", "left_semi").select("w1", "w2", F.levenshtein("w1", "w2").alias("distance"), distance.dice(F.col("w1"), F.col("w2")).alias("dice"))


def segmented_corpus(spark, d):
    return docs(spark, d).select("doc_id", "source", F.size(_tokens()).alias("word_count"), F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("line_count"))


_CONF = f"""k AS (SELECT word, frequency, unnest(list_distinct(list_concat([word], list_transform(range(1, length(word) + 1), lambda i: word[1:i - 1] || word[i + 1:])))) AS key
  FROM w WHERE frequency >= {{least}} AND length(word) <= 10),
c AS (SELECT DISTINCT x.word AS w1, y.word AS w2, x.frequency AS f1, y.frequency AS f2 FROM k x JOIN k y USING (key) WHERE key <> '' AND x.word < y.word),
q AS (SELECT *, greatest(f1, f2)::DOUBLE / least(f1, f2) AS freq_ratio FROM c WHERE levenshtein({ONE_BYTE('w1')}, {ONE_BYTE('w2')}) <= 1
  OR (levenshtein({ONE_BYTE('w1')}, {ONE_BYTE('w2')}) = 2 AND length(w1) = length(w2) AND list_sort(string_split(w1, '')) = list_sort(string_split(w2, ''))))"""

SQL = {
    "token_counts": f"WITH {WORDS} SELECT word, frequency FROM w",
    "word_counts_quality": f"WITH {WORDS} SELECT word, frequency FROM w WHERE word NOT IN ('the', 'und') AND frequency >= 5 AND {QUALITY}",
    "bigram_counts": f"WITH {GRAMS} SELECT * FROM b WHERE cnt >= 10",
    "bigram_probabilities": f"WITH {GRAMS} SELECT *, round(cnt::DOUBLE / sum(cnt) OVER (PARTITION BY w1), 6) AS probability FROM b WHERE cnt >= 10",
    "bigram_counts_vocabulary": f"WITH {GRAMS}, {WORDS}, v AS (SELECT word FROM w WHERE frequency >= 50 AND {QUALITY}) SELECT w1, w2, count(*) AS cnt FROM g WHERE w2 IS NOT NULL AND w1 NOT IN ('of', 'die') AND w2 NOT IN ('of', 'die') AND coalesce(w3, '') NOT IN ('of', 'die') AND w1 IN (FROM v) AND w2 IN (FROM v) GROUP BY ALL HAVING count(*) >= 5",
    "trigram_counts": f"WITH {GRAMS} SELECT w1, w2, w3, count(*) AS cnt FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 5",
    "trigram_probabilities": f"WITH {GRAMS}, x AS (SELECT w1, w2, w3, count(*) AS cnt FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 5) SELECT *, round(cnt::DOUBLE / sum(cnt) OVER (PARTITION BY w1, w2), 6) AS probability FROM x",
    "fourgram_counts": f"WITH {GRAMS}, h AS (SELECT w AS w1, lead(w, 1) OVER d AS w2, lead(w, 2) OVER d AS w3, lead(w, 3) OVER d AS w4 FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i)) SELECT w1, w2, w3, w4, count(*) AS cnt FROM h WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 4",
    "fivegram_counts": f"WITH {GRAMS}, h AS (SELECT w AS w1, lead(w, 1) OVER d AS w2, lead(w, 2) OVER d AS w3, lead(w, 3) OVER d AS w4, lead(w, 4) OVER d AS w5 FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i)) SELECT w1, w2, w3, w4, w5, count(*) AS cnt FROM h WHERE w5 IS NOT NULL GROUP BY ALL HAVING count(*) >= 4",
    "top_continuations": f"WITH {GRAMS}, x AS (SELECT *, round(cnt::DOUBLE / sum(cnt) OVER (PARTITION BY w1), 6) AS probability FROM b WHERE cnt >= 5) SELECT *, CAST(row_number() OVER (PARTITION BY w1 ORDER BY probability DESC, cnt DESC, w2) AS INTEGER) AS rank FROM x QUALIFY rank <= 5",
    "bigram_load_limit": f"WITH {GRAMS} SELECT * FROM b WHERE cnt >= 5 ORDER BY cnt DESC, w1, w2 LIMIT 500",
    "table_stats": f"WITH {GRAMS} SELECT count(*) AS entries, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS total FROM b WHERE cnt >= 10",
    "quality_report": f"WITH x AS (SELECT len({TOK}) AS n FROM documents), y AS (SELECT count(*) AS rows, count(*) FILTER (n = 0) AS empty, avg(n) FILTER (n > 0) AS avg_words FROM x) SELECT rows, empty, avg_words, 100.0 * empty / rows AS empty_pct, 100.0 * empty / rows <= 20 AND avg_words BETWEEN 3 AND 30 AS ok FROM y",
    "frequency_denominator": f"WITH {WORDS}, r AS (SELECT frequency, row_number() OVER (ORDER BY frequency) - 1 AS i, count(*) OVER () AS n FROM w) SELECT frequency * 10 AS denominator FROM r WHERE i = CAST(floor(n * 0.95) AS BIGINT)",
    "collocations": f"WITH {GRAMS}, {WORDS}, s AS (SELECT sum(frequency)::DOUBLE AS total FROM w), x AS (SELECT b.*, log2((cnt / total) / ((a.frequency / total) * (c.frequency / total))) AS pmi, total FROM b, s, w a, w c WHERE a.word = w1 AND c.word = w2 AND cnt >= 10) SELECT w1, w2, cnt, pmi, pmi / -log2(cnt / total) AS npmi FROM x WHERE pmi >= 1",
    "broken_compounds": f"WITH {GRAMS}, {WORDS}, s AS (SELECT sum(frequency)::DOUBLE AS total FROM w), x AS (SELECT w1 || w2 AS compound, w1 AS part1, w2 AS part2, k.frequency AS compound_freq, cnt AS split_freq, log2((cnt / total) / ((a.frequency / total) * (c.frequency / total))) AS pmi FROM b, s, w a, w c, w k WHERE a.word = w1 AND c.word = w2 AND k.word = w1 || w2 AND k.frequency >= 2) SELECT * FROM x WHERE pmi >= 0.5 QUALIFY row_number() OVER (PARTITION BY compound ORDER BY split_freq DESC, part1) = 1",
    "register_tags": f"WITH {GRAMS}, n AS (SELECT w1 AS word, w2 AS m, cnt FROM b UNION ALL SELECT w2, w1, cnt FROM b), y AS (SELECT word, sum(CASE WHEN m IN {FORMAL} THEN cnt ELSE 0 END)::BIGINT AS formal_count, sum(CASE WHEN m IN {INFORMAL} THEN cnt ELSE 0 END)::BIGINT AS informal_count FROM n WHERE m IN {FORMAL + INFORMAL} AND word NOT IN {FORMAL + INFORMAL} GROUP BY word), z AS (SELECT *, (formal_count - informal_count)::DOUBLE / (formal_count + informal_count + 1) AS l FROM y WHERE formal_count + informal_count >= 20) SELECT word, CASE WHEN l >= 0.3 THEN 'formal' WHEN l <= -0.3 THEN 'informal' ELSE 'neutral' END AS register, abs(l) AS confidence, formal_count, informal_count FROM z",
    "confusable_pairs": f"WITH {WORDS}, {_CONF.format(least=20)} SELECT * FROM q WHERE freq_ratio <= 1000",
    "left_context_cosine": f"WITH {GRAMS}, {WORDS}, {_CONF.format(least=40)}, pq AS MATERIALIZED (SELECT w1, w2 FROM q WHERE freq_ratio <= 1000), u AS (SELECT w1 AS word FROM pq UNION SELECT w2 FROM pq), l AS MATERIALIZED (SELECT b.w2 AS word, b.w1 AS before, cnt FROM b JOIN u ON u.word = b.w2), n AS (SELECT word, sqrt(sum(cnt * cnt)) AS norm FROM l GROUP BY word), dots AS (SELECT pq.w1, pq.w2, sum(x.cnt * y.cnt) AS dot FROM pq JOIN l x ON x.word = pq.w1 JOIN l y ON y.word = pq.w2 AND y.before = x.before GROUP BY ALL) SELECT pq.w1, pq.w2, coalesce(dot / (n1.norm * n2.norm), 0.0)::DOUBLE AS overlap FROM pq LEFT JOIN dots USING (w1, w2) LEFT JOIN n n1 ON n1.word = pq.w1 LEFT JOIN n n2 ON n2.word = pq.w2",
    "ingest_filter": r"WITH x AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', '', 'g') AS s FROM pages), y AS (SELECT page_id, CASE WHEN length(s) > 0 THEN (length(s) - length(regexp_replace(s, '[a-zA-Z]', '', 'g')))::DOUBLE / length(s) ELSE 0 END AS ratio FROM x) SELECT * FROM y WHERE ratio >= 0.6",
    "script_ratio": r"WITH x AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\r]+', '', 'g') AS s FROM documents) SELECT doc_id, CASE WHEN length(s) > 0 THEN (length(s) - length(regexp_replace(s, '[a-z]', '', 'g')))::DOUBLE / length(s) ELSE 0 END AS ratio FROM x",
    "line_dedup": r"WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents) SELECT line, doc_id, CAST(line_no AS INTEGER) AS line_no FROM x WHERE trim(line) <> '' QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, line_no) = 1",
    "ledger_antijoin": "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars, source FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 9 = 0",
    "dictionary_upsert": f"WITH {WORDS} SELECT word, frequency FROM w",
    "levenshtein_pairs": f"WITH {WORDS}, {_CONF.format(least=60)}, x AS (SELECT w1, w2, list_transform(range(1, length(w1)), lambda i: w1[i:i + 1]) AS a, list_transform(range(1, length(w2)), lambda i: w2[i:i + 1]) AS b FROM q WHERE length(w1) BETWEEN 4 AND 8) SELECT w1, w2, CAST(levenshtein({ONE_BYTE('w1')}, {ONE_BYTE('w2')}) AS INTEGER) AS distance, coalesce(2.0 * coalesce(list_sum(list_transform(list_distinct(a), lambda v: least(len(list_filter(a, lambda z: z = v)), len(list_filter(b, lambda z: z = v))))), 0) / nullif(len(a) + len(b), 0), 0)::DOUBLE AS dice FROM x",
    "segmented_corpus": f"SELECT doc_id, source, CAST(len({TOK}) AS INTEGER) AS word_count, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS INTEGER) AS line_count FROM documents",
}
QUERIES = {name: globals()[name] for name in SQL}
