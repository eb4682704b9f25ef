"""Queries: tags, suggestions, scores, fusion, evaluation, datasets; each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import distance, text
from ..operators import confusables, dataset, enrich, evaluate, fusion, ngrams, suggest, tags
from ..session import kept
from .corpus import _CONF, GRAMS, ONE_BYTE, TOK, WORDS, bigram_table, docs, trigram_table, word_table

# errors made from tables: a document's symbols, capitals and repeats as three detectors
ERRORS = """e AS (
  SELECT doc_id, kind, tier, prio, least(0.99, n / 50.0) AS confidence FROM (
    SELECT doc_id, 'symbol' AS kind, 1 AS tier, 20 AS prio, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n FROM documents
    UNION ALL SELECT doc_id, 'capital', 2, 10, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) FROM documents
    UNION ALL SELECT doc_id, 'digit', 1, 30, length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) FROM documents) WHERE n > 0)"""
POINTS = [(0.0, 0.05), (0.2, 0.3), (0.5, 0.7), (0.9, 0.95)]
COEF = [1.5, -0.75, 0.25]


def _errors(spark, d):
    rows = docs(spark, d)
    parts = []
    for kind, tier, prio, chars in (("symbol", 1, 20, "[#*$%&|<>]"), ("capital", 2, 10, "[A-Z]"), ("digit", 1, 30, "[0-9]")):
        n = F.length("text") - F.length(F.regexp_replace("text", chars, ""))
        parts.append(rows.select("doc_id", F.lit(kind).alias("error_type"), F.lit(tier).alias("tier"), F.lit(prio).alias("priority"), n.alias("n")))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("n > 0")
    return every.select("doc_id", "error_type", "tier", "priority", F.col("priority").alias("idx"), F.least(F.lit(0.99), F.col("n") / 50.0).alias("confidence"))


def _roles(spark, d):
    return tags.sequences(docs(spark, d, "conversations"), "conv_id", ["turn", "role", "text"], "role")


def _events(spark, d):
    return tags.sequences(docs(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


def tag_unigram(spark, d):
    return tags.unigram(_events(spark, d))


def tag_bigram_laplace(spark, d):
    return tags.bigram_laplace(_events(spark, d))


def tag_trigram_laplace(spark, d):
    return tags.trigram_laplace(_events(spark, d))


def role_bigram_laplace(spark, d):
    return tags.bigram_laplace(_roles(spark, d))


def order_status_transitions(spark, d):
    seq = tags.sequences(docs(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderpriority")
    return tags.bigram_laplace(seq)


def tag_histogram(spark, d):
    return tags.histogram(docs(spark, d, "events").withColumn("u", F.col("user_id").cast("string")), "u", "event_type")


def dominant_tag(spark, d):
    rows = docs(spark, d, "events").withColumn("u", (F.col("user_id") % 7).cast("string"))
    return tags.dominant(tags.histogram(rows, "u", "event_type"), 0.2, 50)


def pos_coverage(spark, d):
    words = word_table(spark, d, 20)
    words = tags.infer(words, [("suffix", "tion", "N", 0.8), ("suffix", "ly", "ADV", 0.7), ("prefix", "th", "DET", 0.4)])
    return tags.coverage(words.withColumn("pos_tag", F.when(F.col("word").isin("the", "of", "und"), "PART")))


def pos_inference(spark, d):
    return tags.infer(word_table(spark, d, 20), [("numeral", "", "NUM", 0.95), ("suffix", "tion", "N", 0.8), ("suffix", "ly", "ADV", 0.7), ("prefix", "th", "DET", 0.4)])


def pos_resolution(spark, d):
    words = tags.infer(word_table(spark, d, 50), [("suffix", "tion", "N", 0.8)]).withColumn("pos_tag", F.when(F.length("word") <= 2, "PART"))
    roots = words.select("word", F.when(F.col("word").endswith("s"), "PL").alias("root_tag"))
    return tags.resolve(words, roots, F.lit("X")).select("word", "resolved")


def symspell_candidates(spark, d):
    return _candidates(spark, d).select("query", "term", "frequency")


def _candidates(spark, d):
    asked = docs(spark, d, "benchmark").select(F.explode(text.words(F.col("text"))).alias("query")).distinct()
    return suggest.lookup(asked, word_table(spark, d, 30), 1)


def symspell_ranked(spark, d):
    asked = docs(spark, d, "benchmark").select(F.explode(text.words(F.col("text"))).alias("query")).distinct()
    return suggest.rank(suggest.lookup(asked, word_table(spark, d, 20), 2), 5)


def candidate_sources(spark, d):
    found = _candidates(spark, d)
    a = found.select("query", "term", (1.0 / (1 + F.col("distance"))).alias("score"), F.lit("edit").alias("source"))
    b = found.select("query", "term", distance.dice(F.col("query"), F.col("term")).alias("score"), F.lit("dice").alias("source"))
    return suggest.merge_sources([a, b])


def _pairs_after(spark, d):
    rows = ngrams.windows(docs(spark, d, "benchmark"), text.words(F.col("text")), 3)
    return rows.na.drop().distinct()


def smoothed_bigram_backoff(spark, d):
    pairs = _pairs_after(spark, d).select("w1", "w2").distinct()
    return suggest.backoff_bigram(pairs, ngrams.conditional(bigram_table(spark, d, 5)), word_table(spark, d), denominator=400_000.0)


def smoothed_trigram_backoff(spark, d):
    b, t = ngrams.conditional(bigram_table(spark, d, 5)), ngrams.conditional(trigram_table(spark, d, 3))
    return suggest.backoff_trigram(_pairs_after(spark, d), t, b, word_table(spark, d), denominator=400_000.0)


def add_k_bigrams(spark, d):
    b = bigram_table(spark, d, 10)
    pre = b.groupBy("w1").agg(F.sum("cnt").alias("prefix"))
    v = word_table(spark, d).agg(F.count("*").alias("v"))
    return b.join(pre, "w1").crossJoin(F.broadcast(v)).select("w1", "w2", suggest.add_k(F.col("cnt"), F.col("prefix"), F.col("v"), 0.5).alias("p"))


def context_scores(spark, d):
    b = ngrams.conditional(bigram_table(spark, d, 10))
    return b.select("w1", "w2", suggest.context_score(F.col("probability"), F.col("cnt") % 3).alias("score"))


def statistical_confusables(spark, d):
    words = kept(word_table(spark, d, 9))
    pairs = kept(enrich.confusable_pairs(words, 40, float("inf"), None))
    return confusables.statistical(docs(spark, d), "text", words, pairs)


def noisy_or_fusion(spark, d):
    e = _errors(spark, d).withColumn("cluster", F.col("tier"))
    return fusion.noisy_or(e, ["doc_id"])


def arbiter_winner(spark, d):
    return fusion.arbiter(_errors(spark, d), ["doc_id"]).select("doc_id", "error_type", "tier", "confidence")


def priority_winner(spark, d):
    e = _errors(spark, d).withColumn("suggestions", F.array("error_type"))
    return fusion.first_by_priority(e, ["doc_id"]).select("doc_id", "error_type", F.array_join("suggestions", ",").alias("suggestions"))


def calibrated(spark, d):
    return _errors(spark, d).select("doc_id", "error_type", fusion.calibrate(F.col("confidence"), POINTS).alias("calibrated"))


def meta_classifier(spark, d):
    x = docs(spark, d).select("doc_id", F.array(F.length("text") / 1000.0, F.size(text.words(F.col("text"))) / 100.0, (F.col("doc_id") % 5).cast("double")).alias("features"))
    return x.select("doc_id", fusion.logistic(F.col("features"), COEF, -0.5).alias("score"))


def confidence_gate(spark, d):
    return fusion.gate(_errors(spark, d), "doc_id", {"capital": 0.3, "symbol": 0.2}, 0.1, {"digit": 0.5}).select("doc_id", "error_type", "confidence")


def actions(spark, d):
    e = _errors(spark, d)
    return e.groupBy(fusion.action(F.col("error_type"), F.col("confidence"), ("digit",)).alias("action")).agg(F.count("*").alias("n"))


def detection_metrics(spark, d):
    x = docs(spark, d).join(docs(spark, d, "labels"), "doc_id")
    marks = F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]", ""))
    return evaluate.detection(x.select((F.col("quality") == 0).alias("gold"), (20 * marks > F.length("text")).alias("found")))


def detection_by_tier(spark, d):
    x = docs(spark, d).join(docs(spark, d, "labels"), "doc_id")
    marks = F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]", ""))
    return evaluate.detection(x.select("lang", (F.col("quality") == 0).alias("gold"), (20 * marks > F.length("text")).alias("found")), ["lang"])


def suggestion_metrics(spark, d):
    x = docs(spark, d, "lineitem").select(F.when(F.col("l_linenumber") < 7, F.col("l_linenumber")).alias("rank"))
    return evaluate.ranking(x)


def latency_percentiles(spark, d):
    return evaluate.percentile_at(docs(spark, d, "events"), "value")


def _spans(spark, d):
    words = docs(spark, d).select("doc_id", "n_chars")
    gold = words.select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))).alias("gold_id"), "n_chars").select("doc_id", "gold_id", (F.col("gold_id") * 37 % 200).alias("gold_start"), (F.col("gold_id") * 37 % 200 + 20).alias("gold_end"))
    system = words.select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))).alias("sys_id"), "n_chars").select("doc_id", "sys_id", ((F.col("sys_id") * 29 + F.col("n_chars")) % 200).alias("sys_start"), ((F.col("sys_id") * 29 + F.col("n_chars")) % 200 + 15).alias("sys_end"))
    return gold, system


def span_overlap(spark, d):
    return evaluate.overlaps(*_spans(spark, d)).select("doc_id", "gold_id", "sys_id", "overlap")


def span_greedy_match(spark, d):
    return evaluate.greedy_match(evaluate.overlaps(*_spans(spark, d)))


def preprocess_report(spark, d):
    rows = docs(spark, d)
    return dataset.report(dataset.preprocess(rows, text.script_ratio(F.col("text"), "a-zA-Z")))


def pair_filters(spark, d):
    rows = docs(spark, d).select("doc_id", F.col("text").alias("clean")).withColumn("corrupted", F.regexp_replace("clean", "th", "t"))
    return dataset.pair_filters(rows, text.script_ratio(F.col("corrupted"), "a-zA-Z"), ["doc_id"], max_bytes=20_000).select("doc_id", F.length("corrupted").alias("n"))


def hash_split(spark, d):
    return dataset.split(docs(spark, d).select("doc_id"), F.col("doc_id"), pinned=F.col("doc_id") % 50 == 0)


def stratified_split(spark, d):
    return dataset.stratified(docs(spark, d).select("doc_id", "lang"), "lang", F.col("doc_id"))


def reservoir(spark, d):
    return dataset.sample(docs(spark, d).select("doc_id", "lang"), F.col("doc_id"), 100)


def corruption(spark, d):
    rows = docs(spark, d).select("doc_id", text.words(F.col("text")).alias("w")).filter("size(w) > 3")
    at = F.lit(2)
    return rows.select("doc_id", *[F.md5(F.array_join(dataset.corrupt(F.col("w"), k, at), " ")).alias(k) for k in ("drop", "double", "swap", "split", "join")])


def reranker_features(spark, d):
    c = suggest.rank(_candidates(spark, d), 5)
    return dataset.reranker_features(c.select(F.col("query").alias("error_id"), F.col("query").alias("error"), F.col("term").alias("candidate"), "frequency", "distance", "rank"))


def corrected_text(spark, d):
    """Whole texts with spans at the start and, in longer ones, at the end; what lies behind a text's end is no error of it."""
    n = F.length("text")
    e = F.array(*[F.struct((n + a if a < 0 else F.lit(a)).alias("start"), (n + z if a < 0 else F.lit(z)).alias("end"), F.lit(x).alias("fix"), F.lit(k).alias("action"), F.lit(least).alias("least")) for a, z, x, k, least in (
        (10, 15, "FIX", "SUGGEST", 15), (12, 20, "lost", "AUTO_FIX", 20), (0, 3, "Any", "SUGGEST", 3), (30, 32, "no", "INFORM", 32), (38, 40, "", "SUGGEST", 40), (-4, -2, "END", "SUGGEST", 50),
    )])
    return docs(spark, d).select("doc_id", F.md5(fusion.corrected(F.col("text"), F.filter(e, lambda x: n >= x["least"]))).alias("corrected"))


def cross_sentence_context(spark, d):
    x = fusion.previous_context(docs(spark, d, "conversations").select("conv_id", "turn", "role", "text").dropDuplicates(["conv_id", "turn"]), "conv_id", "turn", "text")
    return x.select("conv_id", "turn", "context", "shift")


def contained_errors(spark, d):
    gold, system = _spans(spark, d)
    e = gold.toDF("doc_id", "id", "start", "end").withColumn("priority", F.lit(1)).unionByName(system.toDF("doc_id", "id", "start", "end").withColumn("priority", F.lit(2)))
    return fusion.drop_contained(e, "doc_id").select("doc_id", "priority", "id", "start", "end")


_SEQ = "s AS (SELECT {tag} AS tag1, lead({tag}, 1) OVER w AS tag2, lead({tag}, 2) OVER w AS tag3 FROM {table} WINDOW w AS (PARTITION BY {key} ORDER BY {order})), v AS (SELECT DISTINCT tag1 AS tag FROM s)"
_EV = _SEQ.format(tag="event_type", table="events", key="user_id", order="ts, event_id")
_BI = """, c AS (SELECT tag1, tag2, count(*) AS cnt FROM s WHERE tag2 IS NOT NULL GROUP BY ALL), p AS (SELECT tag1, sum(cnt) AS pred FROM c GROUP BY tag1)
SELECT a.tag AS tag1, b.tag AS tag2, coalesce(cnt, 0) AS cnt, (coalesce(cnt, 0) + 1)::DOUBLE / (coalesce(pred, 0) + (SELECT count(*) FROM v)) AS probability
FROM v a CROSS JOIN v b LEFT JOIN c ON c.tag1 = a.tag AND c.tag2 = b.tag LEFT JOIN p ON p.tag1 = a.tag"""
_MARKS = "length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g'))"
_DETECT = """m AS (SELECT {g} count(*) FILTER (gold AND found) AS tp, count(*) FILTER (NOT gold AND found) AS fp, count(*) FILTER (gold AND NOT found) AS fn, count(*) FILTER (NOT gold AND NOT found) AS tn FROM x GROUP BY ALL),
n AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall FROM m)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, CASE WHEN fp + tn > 0 THEN fp::DOUBLE / (fp + tn) ELSE 0 END AS fpr FROM n"""
_X = f"x AS (SELECT lang, quality = 0 AS gold, 20 * ({_MARKS}) > length(text) AS found FROM documents JOIN labels USING (doc_id))"
_SP = "gs AS (SELECT doc_id, i AS gold_id, i * 37 % 200 AS gold_start, i * 37 % 200 + 20 AS gold_end FROM documents, range(5) t(i)), ss AS (SELECT doc_id, i AS sys_id, (i * 29 + n_chars) % 200 AS sys_start, (i * 29 + n_chars) % 200 + 15 AS sys_end FROM documents, range(6) t(i))"
_BW = f"bw AS (SELECT item_id, unnest({TOK}) AS w, unnest(range(1, len({TOK}) + 1)) AS i FROM benchmark), bg AS (SELECT w AS w1, lead(w, 1) OVER z AS w2, lead(w, 2) OVER z AS w3 FROM bw WINDOW z AS (PARTITION BY item_id ORDER BY i)), tri AS (SELECT DISTINCT w1, w2, w3 FROM bg WHERE w3 IS NOT NULL)"
_P2 = "p2 AS (SELECT *, round(cnt::DOUBLE / sum(cnt) OVER (PARTITION BY w1), 6) AS probability FROM b WHERE cnt >= 5)"
_CAND = f"k AS (SELECT word AS term, frequency FROM w WHERE frequency >= 30), q AS (SELECT DISTINCT query FROM (SELECT unnest({TOK}) AS query FROM benchmark) WHERE query NOT IN (SELECT term FROM k)), cand AS (SELECT query, term, frequency FROM q, k WHERE abs(length(query) - length(term)) <= 1 AND length(query) + length(term) > 2 AND damerau_levenshtein({ONE_BYTE('query')}, {ONE_BYTE('term')}) <= 1)"
#: Pairs of words of any length.
_CONF_ANY = _CONF.replace(" AND length(word) <= 10", "")
_DICE = "da AS (SELECT *, list_transform(range(1, length(query)), lambda i: query[i:i + 1]) AS a, list_transform(range(1, length(term)), lambda i: term[i:i + 1]) AS b FROM cand), dc AS (SELECT query, term, frequency, coalesce(2.0 * coalesce(list_sum(list_transform(list_distinct(a), lambda v: least(len(list_filter(a, lambda z: z = v)), len(list_filter(b, lambda z: z = v))))), 0) / nullif(len(a) + len(b), 0), 0)::DOUBLE AS dice FROM da)"

SQL = {
    "tag_unigram": f"WITH {_EV} SELECT tag1 AS tag, count(*) AS cnt, count(*)::DOUBLE / sum(count(*)) OVER () AS probability FROM s GROUP BY tag1",
    "tag_bigram_laplace": f"WITH {_EV}{_BI}",
    "tag_trigram_laplace": f"WITH {_EV}, c AS (SELECT tag1, tag2, tag3, count(*) AS cnt FROM s WHERE tag2 IS NOT NULL AND tag3 IS NOT NULL GROUP BY ALL), p AS (SELECT tag1, tag2, sum(cnt) AS pred FROM c GROUP BY ALL) SELECT p.tag1, p.tag2, v.tag AS tag3, coalesce(cnt, 0) AS cnt, (coalesce(cnt, 0) + 1)::DOUBLE / (pred + (SELECT count(*) FROM v)) AS probability FROM p CROSS JOIN v LEFT JOIN c ON c.tag1 = p.tag1 AND c.tag2 = p.tag2 AND c.tag3 = v.tag",
    "role_bigram_laplace": f"WITH {_SEQ.format(tag='role', table='conversations', key='conv_id', order='turn, role, text')}{_BI}",
    "order_status_transitions": f"WITH {_SEQ.format(tag='o_orderpriority', table='orders', key='o_custkey', order='o_orderdate, o_orderkey')}{_BI}",
    "tag_histogram": "WITH c AS (SELECT CAST(user_id AS VARCHAR) AS word, event_type AS tag, count(*) AS cnt FROM events WHERE event_type <> 'UNK' GROUP BY ALL) SELECT * FROM c QUALIFY cnt >= greatest(1, floor(sum(cnt) OVER (PARTITION BY word) * 0.05))",
    "dominant_tag": "WITH c AS (SELECT CAST(user_id % 7 AS VARCHAR) AS word, event_type AS tag, count(*) AS cnt FROM events GROUP BY ALL), h AS (SELECT * FROM c QUALIFY cnt >= greatest(1, floor(sum(cnt) OVER (PARTITION BY word) * 0.05))), t AS (SELECT *, CAST(sum(cnt) OVER (PARTITION BY word) AS BIGINT) AS total, row_number() OVER (PARTITION BY word ORDER BY cnt DESC, tag) AS n FROM h) SELECT word, tag, cnt::DOUBLE / total AS share, total FROM t WHERE n = 1 AND cnt::DOUBLE / total >= 0.2 AND total >= 50",
    "pos_coverage": f"WITH {WORDS}, x AS (SELECT word IN ('the', 'of', 'und') AS t, word LIKE '%tion' OR word LIKE '%ly' OR word LIKE 'th%' AS i FROM w WHERE frequency >= 20) SELECT count(*) AS words, count(*) FILTER (t) AS tagged, count(*) FILTER (NOT t AND i) AS inferred, count(*) FILTER (NOT t AND NOT i) AS untagged FROM x",
    "pos_inference": rf"WITH {WORDS}, x AS (SELECT *, CASE WHEN regexp_full_match(word, '\p{{Nd}}+') THEN 1 WHEN word LIKE '%tion' THEN 2 WHEN word LIKE '%ly' THEN 3 WHEN word LIKE 'th%' THEN 4 END AS k FROM w WHERE frequency >= 20) SELECT word, frequency, (['NUM', 'N', 'ADV', 'DET'])[k] AS inferred_pos, CAST(([0.95, 0.8, 0.7, 0.4])[k] AS DOUBLE) AS inferred_confidence, (['numeral', 'suffix', 'suffix', 'prefix'])[k] AS inferred_source FROM x",
    "pos_resolution": f"WITH {WORDS} SELECT word, CASE WHEN length(word) <= 2 THEN 'PART' WHEN word LIKE '%tion' THEN 'N' WHEN word LIKE '%s' THEN 'PL' ELSE 'X' END AS resolved FROM w WHERE frequency >= 50",
    "symspell_candidates": f"WITH {WORDS}, {_CAND} SELECT query, term, frequency FROM cand",
    "candidate_sources": f"WITH {WORDS}, {_CAND}, {_DICE}, u AS (SELECT query, term, 0.5::DOUBLE AS score, 'edit' AS source FROM cand UNION ALL SELECT query, term, dice, 'dice' FROM dc) SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query, term ORDER BY score DESC, source) = 1",
    "reranker_features": f"WITH {WORDS}, {_CAND}, {_DICE}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY 1 - 0.1::DOUBLE * log10(frequency + 1), frequency DESC, term) AS INTEGER) AS rank FROM dc QUALIFY rank <= 5) SELECT query AS error_id, query AS error, term AS candidate, frequency, 1 AS distance, rank, ln(frequency + 1) AS log_frequency, ln(frequency + 1) / max(ln(frequency + 1)) OVER (PARTITION BY query) AS relative_frequency, dice, CAST(abs(length(query) - length(term)) AS INTEGER) AS length_gap, 1.0::DOUBLE / rank AS inverse_rank, left(query, 1) = left(term, 1) AS same_first, count(*) OVER (PARTITION BY query) AS candidates FROM r",
    "statistical_confusables": f"WITH {GRAMS}, {WORDS}, {_CONF_ANY.format(least=40)}, pr AS (SELECT w1, w2, round(cnt::DOUBLE / sum(cnt) OVER (PARTITION BY w1), 6) AS probability FROM b), v AS (SELECT w1 AS word, w2 AS variant FROM q UNION ALL SELECT w2, w1 FROM q), x AS (SELECT b.w1 AS l, v.word, variant, CASE WHEN o.probability IS NULL THEN 0 WHEN m.probability IS NULL THEN 1e6 ELSE o.probability / m.probability END::DOUBLE AS ratio FROM b JOIN v ON v.word = b.w2 LEFT JOIN pr m ON m.w1 = b.w1 AND m.w2 = v.word LEFT JOIN pr o ON o.w1 = b.w1 AND o.w2 = v.variant) SELECT l AS \"left\", word, variant, ratio, 0.5 + 0.45 * least(log10(ratio) / 6, 1.0::DOUBLE) AS confidence FROM x WHERE ratio >= 10 QUALIFY row_number() OVER (PARTITION BY l, word ORDER BY ratio DESC, variant) = 1",
    "hash_split": "WITH x AS (SELECT doc_id, CAST('0x' || left(md5(CAST(doc_id AS VARCHAR)), 8) AS UBIGINT) % 100 AS p FROM documents) SELECT doc_id, CASE WHEN doc_id % 50 = 0 OR p < 90 THEN 'train' WHEN p < 95 THEN 'dev' ELSE 'test' END AS split FROM x",
    "reservoir": "SELECT doc_id, lang FROM documents ORDER BY md5('0:' || doc_id), doc_id LIMIT 100",
    "contained_errors": f"WITH {_SP}, e AS (SELECT doc_id, 1 AS priority, gold_id AS id, gold_start AS start, gold_end AS \"end\" FROM gs UNION ALL SELECT doc_id, 2, sys_id, sys_start, sys_end FROM ss) SELECT * FROM e QUALIFY coalesce(max(\"end\") OVER (PARTITION BY doc_id ORDER BY start, \"end\" DESC, priority ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < \"end\", true)",
    "span_greedy_match": f"WITH RECURSIVE {_SP}, o AS (SELECT doc_id, gold_id, sys_id, least(gold_end, sys_end) - greatest(gold_start, sys_start) AS overlap FROM gs JOIN ss USING (doc_id) WHERE gold_start < sys_end AND sys_start < gold_end), c AS MATERIALIZED (SELECT gs.doc_id, gs.gold_id, coalesce(list(sys_id ORDER BY overlap DESC, sys_id) FILTER (sys_id IS NOT NULL), []) AS cands FROM gs LEFT JOIN o USING (doc_id, gold_id) GROUP BY ALL), r AS (SELECT doc_id, -1::BIGINT AS gold_id, []::BIGINT[] AS taken, NULL::BIGINT AS sys_id FROM documents UNION ALL SELECT doc_id, gold_id, CASE WHEN p IS NULL THEN taken ELSE list_append(taken, p) END, p FROM (SELECT r.doc_id, c.gold_id, taken, list_filter(cands, lambda z: NOT list_contains(taken, z))[1] AS p FROM r JOIN c ON c.doc_id = r.doc_id AND c.gold_id = r.gold_id + 1) q) SELECT doc_id, gold_id, sys_id FROM r WHERE sys_id IS NOT NULL",
    "smoothed_bigram_backoff": f"WITH {GRAMS}, {WORDS}, {_BW}, {_P2}, q AS (SELECT DISTINCT w1, w2 FROM tri) SELECT q.w1, q.w2, coalesce(probability, least(0.4 * frequency / 400000.0, 0.1), 0)::DOUBLE AS p FROM q LEFT JOIN p2 USING (w1, w2) LEFT JOIN w ON w.word = q.w2",
    "smoothed_trigram_backoff": f"WITH {GRAMS}, {WORDS}, {_BW}, {_P2}, t3 AS (SELECT w1, w2, w3, count(*) AS cnt FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 3), p3 AS (SELECT *, round(cnt::DOUBLE / sum(cnt) OVER (PARTITION BY w1, w2), 6) AS probability FROM t3) SELECT q.w1, q.w2, q.w3, coalesce(p3.probability, 0.4 * p2.probability, least(0.4::DOUBLE * 0.4 * frequency / 400000.0, 0.1), 0)::DOUBLE AS p FROM tri q LEFT JOIN p3 USING (w1, w2, w3) LEFT JOIN p2 ON p2.w1 = q.w2 AND p2.w2 = q.w3 LEFT JOIN w ON w.word = q.w3",
    "add_k_bigrams": f"WITH {GRAMS}, {WORDS}, x AS (SELECT * FROM b WHERE cnt >= 10) SELECT w1, w2, (cnt + 0.5::DOUBLE) / (sum(cnt) OVER (PARTITION BY w1) + 0.5::DOUBLE * (SELECT count(*) FROM w)) AS p FROM x",
    "context_scores": f"WITH {GRAMS}, x AS (SELECT *, round(cnt::DOUBLE / sum(cnt) OVER (PARTITION BY w1), 6) AS probability FROM b WHERE cnt >= 10) SELECT w1, w2, 0.4 * ln(greatest(probability, 1e-10)) - 0.6 * (cnt % 3) * 10 AS score FROM x",
    "noisy_or_fusion": f"WITH {ERRORS}, m AS (SELECT doc_id, tier, max(confidence) AS best FROM e GROUP BY ALL) SELECT doc_id, 1 - product(1 - best)::DOUBLE AS fused, count(*) AS clusters FROM m GROUP BY doc_id",
    "arbiter_winner": f"WITH {ERRORS} SELECT doc_id, kind AS error_type, tier, confidence::DOUBLE AS confidence FROM e QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY tier DESC, confidence DESC, prio) = 1",
    "priority_winner": f"WITH {ERRORS} SELECT doc_id, arg_min(kind, prio) AS error_type, string_agg(kind, ',' ORDER BY prio) AS suggestions FROM e GROUP BY doc_id",
    "calibrated": f"WITH {ERRORS} SELECT doc_id, kind AS error_type, (CASE WHEN confidence <= 0.0 THEN 0.05 WHEN confidence <= 0.2 THEN 0.05 + confidence * (0.25 / 0.2) WHEN confidence <= 0.5 THEN 0.3 + (confidence - 0.2) * (0.4 / 0.3) WHEN confidence <= 0.9 THEN 0.7 + (confidence - 0.5) * (0.25 / 0.4) ELSE 0.95 END)::DOUBLE AS calibrated FROM e",
    "meta_classifier": f"SELECT doc_id, 1 / (1 + exp(-(-0.5 + 1.5 * length(text) / 1000.0 - 0.75 * len({TOK}) / 100.0 + 0.25 * (doc_id % 5)))) AS score FROM documents",
    "confidence_gate": f"WITH {ERRORS}, p AS (SELECT * FROM e WHERE confidence >= CASE kind WHEN 'capital' THEN 0.3 WHEN 'symbol' THEN 0.2 ELSE 0.1 END) SELECT doc_id, kind AS error_type, confidence::DOUBLE AS confidence FROM p WHERE NOT (coalesce((SELECT max(o.confidence) FROM p o WHERE o.doc_id = p.doc_id AND o.kind <> p.kind) > confidence, false) AND confidence < CASE kind WHEN 'digit' THEN 0.5 ELSE 0 END)",
    "actions": f"WITH {ERRORS} SELECT CASE WHEN kind = 'digit' THEN 'INFORM' WHEN confidence >= 0.9 THEN 'AUTO_FIX' ELSE 'SUGGEST' END AS action, count(*) AS n FROM e GROUP BY ALL",
    "detection_metrics": f"WITH {_X}, {_DETECT.format(g='')}",
    "detection_by_tier": f"WITH {_X}, {_DETECT.format(g='lang,')}",
    "suggestion_metrics": "WITH x AS (SELECT CASE WHEN l_linenumber < 7 THEN l_linenumber END AS rank FROM lineitem) SELECT avg(coalesce(1.0::DOUBLE / rank, 0)) AS mrr, avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS top1, avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS top5 FROM x",
    "latency_percentiles": "WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL), s AS (SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS share) SELECT share, value FROM r, s WHERE i = CAST(floor(n * share) AS BIGINT)",
    "span_overlap": f"WITH {_SP} SELECT doc_id, gold_id, sys_id, least(gold_end, sys_end) - greatest(gold_start, sys_start) AS overlap FROM gs JOIN ss USING (doc_id) WHERE gold_start < sys_end AND sys_start < gold_end",
    "preprocess_report": r"WITH x AS (SELECT length(trim(coalesce(text, ''))) AS n, regexp_replace(coalesce(text, ''), '[ \t\n\r]+', '', 'g') AS s FROM documents) SELECT CASE WHEN n = 0 THEN 'empty' WHEN n < 10 THEN 'short' WHEN n > 1000 THEN 'long' WHEN (length(s) - length(regexp_replace(s, '[a-zA-Z]', '', 'g')))::DOUBLE / length(s) < 0.6 THEN 'script' ELSE 'kept' END AS reason, count(*) AS rows FROM x GROUP BY ALL",
    "pair_filters": r"WITH x AS (SELECT doc_id, text AS clean, replace(text, 'th', 't') AS corrupted FROM documents), y AS (SELECT *, regexp_replace(corrupted, '[ \t\n\r]+', '', 'g') AS s FROM x), z AS (SELECT * FROM y WHERE (length(s) - length(regexp_replace(s, '[a-zA-Z]', '', 'g')))::DOUBLE / length(s) >= 0.8 AND s <> regexp_replace(clean, '[ \t\n\r]+', '', 'g') AND length(corrupted) >= 0.7 * length(clean) AND octet_length(encode(corrupted)) <= 20000 AND octet_length(encode(clean)) <= 20000 QUALIFY row_number() OVER (PARTITION BY corrupted ORDER BY doc_id) = 1) SELECT doc_id, CAST(length(corrupted) AS INTEGER) AS n FROM z",
    "stratified_split": "SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR))) % 2 = 1 THEN 'dev' ELSE 'test' END AS split FROM documents",
    "corrected_text": "WITH x AS (SELECT doc_id, text AS t, length(text) AS n FROM documents) SELECT doc_id, md5(CASE WHEN n < 3 THEN t WHEN n < 15 THEN 'Any' || t[4:] WHEN n < 40 THEN 'Any' || t[4:10] || 'FIX' || t[16:] WHEN n < 50 THEN 'Any' || t[4:10] || 'FIX' || t[16:38] || t[41:] ELSE 'Any' || t[4:10] || 'FIX' || t[16:38] || t[41:n - 4] || 'END' || t[n - 1:] END) AS corrected FROM x",
    "cross_sentence_context": "WITH c AS (SELECT conv_id, turn, any_value(text) AS text FROM conversations GROUP BY ALL), x AS (SELECT conv_id, turn, right(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), ''), 100) AS context FROM c) SELECT *, CAST(length(context) AS INTEGER) AS shift FROM x",
    "corruption": f"WITH x AS (SELECT doc_id, {TOK} AS w FROM documents), y AS (SELECT doc_id, w, w[2] AS b, greatest(length(w[2]) // 2, 1) AS h FROM x WHERE len(w) > 3), z AS (SELECT doc_id, w, b[1:h - 1] || b[h + 1:] AS p, b[1:h] || b[h:h] || b[h + 1:] AS q, b[1:h - 1] || b[h + 1:h + 1] || b[h:h] || b[h + 2:] AS r, b[1:h] || ' ' || b[h + 1:] AS s, b || w[3] AS j FROM y) SELECT doc_id, {', '.join(f'md5(array_to_string([w[1]] || [{v}] || w[{3 + (k == "join")}:], chr(32))) AS \"{k}\"' for k, v in (('drop', 'p'), ('double', 'q'), ('swap', 'r'), ('split', 's'), ('join', 'j')))} FROM z",
}
_ROWS_ONLY = ("symspell_ranked",)
QUERIES = {name: globals()[name] for name in [*SQL, *_ROWS_ONLY]}
