import math
from collections import Counter, defaultdict

import pytest

from lexforge.functions.distance import alignment
from lexforge.plans import MODULES

from .compare import SF, connection, same

SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, SQL[name])


def test_queries_without_sql():
    assert set(QUERIES) - set(SQL) == {"symspell_ranked", "unknown_words", "viterbi_tags", "tag_disambiguation", "check_documents", "compound_lookup", "trigram_tags", "joint_tags"}


def test_unknown_words(spark, con):
    """Against the tokens that aren't words of three uses, and the edits of what is offered."""
    got = QUERIES["unknown_words"](spark, SF).collect()
    known = dict(con.execute("SELECT w, count(*) FROM (SELECT unnest(regexp_extract_all(lower(text), '[^ \\t\\n\\r]+')) AS w FROM documents) GROUP BY w HAVING count(*) >= 3").fetchall())
    every = con.execute("SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^ \\t\\n\\r]+')) AS w FROM documents").fetchall()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(x for x in every if x[1] not in known)
    for r in got[:2000]:
        assert r["fix"] is None or (r["fix"] in known and alignment(r["text"], r["fix"]) <= 1)
    missed = {r["text"] for r in got if r["fix"] is None}
    for w in sorted(missed)[:200]:
        assert not any(abs(len(w) - len(k)) <= 1 and min(len(w), len(k)) > 1 and alignment(w, k) <= 1 for k in known)


def test_symspell_ranked(spark, con):
    words = dict(con.execute("SELECT w, count(*) FROM (SELECT unnest(regexp_extract_all(lower(text), '[^ \\t\\n\\r]+')) AS w FROM documents) GROUP BY w HAVING count(*) >= 20").fetchall())
    got = defaultdict(list)
    for r in QUERIES["symspell_ranked"](spark, SF).collect():
        got[r["query"]].append((r["rank"], r["term"], r["distance"]))
    for q in sorted(got)[:60]:
        near = sorted((alignment(q, t) - 0.1 * math.log10(f + 1), -f, t, alignment(q, t)) for t, f in words.items() if abs(len(q) - len(t)) <= 2 and alignment(q, t) <= 2)
        assert [(t, d) for _, t, d in sorted(got[q])] == [(t, d) for _, _, t, d in near[:5]]


def test_check_documents(spark):
    rows = QUERIES["check_documents"](spark, SF).collect()
    assert len(rows) == 200 and len({r["doc_id"] for r in rows}) == 200
    assert all(r["has_errors"] == (r["n_errors"] > 0) and r["level"] == "context" for r in rows) and any(r["has_errors"] for r in rows)


def test_tags(spark):
    got = {r["id"]: r["tags"] for r in QUERIES["viterbi_tags"](spark, SF).collect()}
    assert got[1] == "D N V" and got[2] == "N" and got[3] == ""
    assert [r["tag"] for r in QUERIES["tag_disambiguation"](spark, SF).orderBy("s", "i").collect()] == ["N", "PPM", "V", "ADV", "V"]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["w1", "w2", "cnt", "probability"]
    assert set(e.oracle_sql()) <= set(e.queries())
