"""Tags and words found together against all answers tried."""

import itertools
import math
import random

import pytest

from lexforge.operators import joint

UNI = {"N": 0.5, "V": 0.3, "P": 0.2}
BI = {("", "N"): 0.8, ("N", "V"): 0.6, ("V", "N"): 0.5, ("N", "P"): 0.3, ("P", "N"): 0.7}
TRI = {("", "", "N"): 0.9, ("", "N", "V"): 0.7, ("N", "V", "N"): 0.6, ("V", "N", "P"): 0.4, ("N", "P", "N"): 0.8}
EMIT = {"ab": {"N": 0.9, "V": 0.1}, "a": {"P": 0.6, "N": 0.4}, "bc": {"V": 1.0}, "c": {"N": 0.5, "P": 0.5}, "abc": {"N": 0.2, "V": 0.8}}
USES = {"ab": 30, "a": 50, "b": 2, "bc": 20, "c": 40, "abc": 3, "ca": 10}


def score(words, tags):
    """Plain sum of the logs of the interpolated steps and the emissions."""
    total, before = 0.0, ("", "")
    for w, t in zip(words, tags, strict=True):
        p = 0.1 * UNI.get(t, 1e-10) + 0.3 * BI.get((before[1], t), 1e-10) + 0.6 * TRI.get((*before, t), 1e-10)
        total += math.log(max(p, 1e-10)) + math.log(EMIT.get(w, UNI)[t])
        before = (before[1], t)
    return total


def tables(spark):
    emissions = spark.createDataFrame([(w, t, p) for w, x in EMIT.items() for t, p in x.items()], "word string, tag string, p double")
    model = joint.tag_model(
        spark.createDataFrame(list(UNI.items()), "tag string, probability double"), spark.createDataFrame([(*k, p) for k, p in BI.items()], "tag1 string, tag2 string, probability double"),
        spark.createDataFrame([(*k, p) for k, p in TRI.items()], "tag1 string, tag2 string, tag3 string, probability double"),
    )
    return emissions, model


def test_tag(spark):
    random.seed(1)
    emissions, model = tables(spark)
    sentences = [[random.choice([*EMIT, "zz"]) for _ in range(random.randint(0, 5))] for _ in range(25)]
    rows = spark.createDataFrame([*enumerate(sentences), (99, None)], "id int, words array<string>")
    got = {r["id"]: r["tags"] for r in joint.tag(rows, "id", emissions, model).collect()}
    assert got.pop(99) is None and len(got) == 25
    for i, words in enumerate(sentences):
        options = [sorted(EMIT.get(w, UNI)) for w in words]
        assert math.isclose(score(words, got[i]), max((score(words, t) for t in itertools.product(*options)), default=0.0), abs_tol=1e-9)


def test_segment_and_tag(spark):
    random.seed(2)
    emissions, model = tables(spark)
    strings = ["", "x", "abc", *{"".join(random.choice("abcx") for _ in range(random.randint(1, 6))) for _ in range(25)}]
    words = spark.createDataFrame([*USES.items(), (None, 5), ("", 7)], "word string, frequency bigint")
    total = sum(USES.values()) + 12
    rows = spark.createDataFrame([(s,) for s in [*strings, None, "abc"]], "string string")
    got = {r["string"]: (list(r["words"]), list(r["tags"])) for r in joint.segment_and_tag(rows, words, emissions, model).collect()}
    assert set(got) == set(strings) and got[""] == ([], [])

    def value(ws, ts):
        return score(ws, ts) + sum(math.log(USES[w] / total) if w in USES else -12.0 for w in ws)

    for s in set(strings) - {""}:
        best = -math.inf
        for n in range(len(s)):
            for cuts in itertools.combinations(range(1, len(s)), n):
                ws = [s[a:b] for a, b in itertools.pairwise((0, *cuts, len(s)))]
                if all(w in USES or len(w) == 1 for w in ws):
                    best = max(best, *(value(ws, t) for t in itertools.product(*[sorted(EMIT.get(w, UNI)) for w in ws])))
        assert "".join(got[s][0]) == s and math.isclose(value(*got[s]), best, abs_tol=1e-9)


def test_tag_model_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(joint, "MOST_TAG_ROWS", 3)
    with pytest.raises(ValueError):
        tables(spark)


def test_queries_over_the_benchmark(spark):
    """Every word has a tag, and the words spell their string; known words that end in a stop have its tag."""
    from lexforge.plans.probes import QUERIES

    from .compare import SF, connection

    con = connection()
    want = dict(con.execute("SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\r]+'), lambda x: x <> '') FROM benchmark").fetchall())
    known = {r[0] for r in con.execute("SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\r]+')) FROM documents").fetchall()}
    got = {r["item_id"]: r for r in QUERIES["trigram_tags"](spark, SF).collect()}
    assert set(got) == set(want)
    for i, words in want.items():
        tags = got[i]["tags"].split(" ") if words else []
        assert got[i]["n"] == len(words) == len(tags)
        assert all(t == "S" for w, t in zip(words, tags, strict=True) if w in known and w[-1] in ".!?")
    three = {"".join(w[k : k + 3]) for w in want.values() for k in range(len(w) - 2)}
    rows = QUERIES["joint_tags"](spark, SF).collect()
    assert {r["string"] for r in rows} == three and len(rows) == len(three)
    assert all(r["words"].replace(" ", "") == r["string"] and len(r["words"].split(" ")) == len(r["tags"].split(" ")) for r in rows)
