"""Rows that share a doc_id or have none, columns with clashing names, ties, empty tables: for every operator and stage."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexforge.llm import op1_decontaminate as op1
from lexforge.llm import op2_tokens as op2
from lexforge.llm import op3_substrings as op3
from lexforge.llm import op4_mix as op4
from lexforge.llm import op5_quality as op5
from lexforge.llm import op6_minhash as op6
from lexforge.llm import op7_lm as op7
from lexforge.llm import op8_lines as op8
from lexforge.llm import op9_secrets as op9
from lexforge.llm import op10_toxicity as op10

from .test_llm import docs_of, items_of, odd_texts

#: Names that the plans use themselves.
CLASH = "keep size target taken source_size own drop id row key kind item items line template tag score kept_text n_lines n_dropped kept contaminated quality toxic trusted digest _key _salt".split()


def marks_of(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")


def operators(spark):
    import public_tokenizers

    path, items, marks = public_tokenizers.path("byte_bpe_50k.json"), items_of(spark), marks_of(spark)
    return {
        "op1": lambda d: op1.contamination(d, items).drop("items"),
        "op2": lambda d: op2.token_counts(d, path),
        "op3": op3.dedup_digests,
        "op4": op4.mix,
        "op5": lambda d: op5.quality(d, marks),
        "op6": lambda d: op6.near_duplicates(d, 3, 85),
        "op7": lambda d: op7.lm_scores(d, flush=5000),
        "op8": lambda d: op8.drop_lines(d, 2).select("doc_id", "kept_text", "n_lines", "n_dropped"),
        "op9": op9.secrets,
        "op10": lambda d: op10.toxicity(d, marks),
    }


def rows_of(df):
    return Counter(tuple(float(f"{v:.6g}") if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("name", [f"op{i}" for i in range(1, 11)])
def test_clashing_columns_and_empty_tables(spark, name):
    run = operators(spark)[name]
    texts = odd_texts()
    texts[9] = texts[9][:20_000]
    docs = docs_of(spark, [*texts, texts[3], "solo"], [*range(len(texts)), 4, None])
    clash = docs
    for c in CLASH:
        clash = clash.withColumn(c, F.lit("x"))
    plain = run(docs)
    got = rows_of(plain)
    assert sum(got.values()) == len(texts) + 2
    assert rows_of(run(clash).select(*plain.columns)) == got
    assert run(docs_of(spark, [])).count() == 0


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    rng = random.Random(21)
    words = [rng.choice("abcdefghij") * 3 + str(i) for i in range(80)]
    shared = " ".join(words)
    docs = docs_of(spark, [shared, shared, "just three words"], [0, 1, 1])
    rows = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in op3.dedup_digests(docs).collect()}
    assert rows == {(0, 80): 0, (1, 80): 80, (1, 3): 0}
    items = spark.createDataFrame([(1, " ".join(words[:40]))], "item_id bigint, text string")
    hits = {(r["doc_id"], r["n_words"]): (r["n_hit"], r["contaminated"]) for r in op1.contamination(docs, items).collect()}
    assert hits == {(0, 80): (40, True), (1, 80): (40, True), (1, 3): (0, False)}
    nulls = docs_of(spark, [shared, shared, "other text"], [4, None, None])
    assert {(r["doc_id"], r["n_words"]): r["n_removed"] for r in op3.dedup_digests(nulls).collect()} == {(4, 80): 0, (None, 80): 80, (None, 2): 0}
    line = "all rights reserved by the owner of this page"
    texts = [*(f"{line}\ntext {chr(97 + i) * 4}" for i in range(12)), "first\nsecond\nthird"]
    rows = [tuple(r) for r in op8.drop_lines(docs_of(spark, texts, [*range(12), 7]), 10).select("doc_id", "kept_text", "n_dropped").collect()]
    assert sorted(rows) == sorted([(0, texts[0], 0), *((i, texts[i].split("\n")[1], 1) for i in range(1, 12)), (7, texts[12], 0)])


def test_toxicity_without_evidence_is_clean(spark):
    texts = [f"plain words number {chr(97 + i % 26) * 3} of a text" for i in range(40)]
    docs = docs_of(spark, [*texts, None, ""])
    for label in (lambda i: i % 2, lambda i: i % 4 != 0, lambda i: 1, lambda i: 0):
        marks = spark.createDataFrame([(i, int(label(i))) for i in range(40)], "doc_id bigint, toxic int")
        assert {r["predicted"] for r in op10.toxicity(docs, marks).collect()} == {0}


def test_toxicity_of_a_toxic_majority(spark):
    rng = random.Random(22)
    clean = lambda: ["".join(rng.choice("aeioklmnrst") for _ in range(rng.randint(3, 8))) for _ in range(40)]
    texts = []
    for i in range(300):
        t = clean()
        if i % 4:
            t[5], t[20] = "blargh", rng.choice(["zwonker", "frubble"])
        texts.append(" ".join(t))
    opening = "this page was shared by the same six words "
    texts = [opening + t for t in texts]
    marks = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in op10.toxicity(docs_of(spark, [*texts, "nothing here"]), marks).collect()}
    assert sum(got[i] == int(i % 4 > 0) for i in range(300)) >= 290 and got[300] == 0


def tree(texts, min_docs, depth=3, similarity=0.75):
    """Lines to drop by a plain template tree: (row, line number)."""
    masked = lambda x: tuple("*" if any(c.isdigit() for c in w) else w for w in x.split())
    docs = defaultdict(set)
    for i, t in enumerate(texts):
        for x in t.split("\n"):
            if x.split():
                docs[masked(x)].add(i)
    leaves = defaultdict(list)
    for m, d in docs.items():
        leaves[len(m), m[:depth]].append((m, d))
    gone = set()
    owner = {}
    for lines in leaves.values():
        templates = []
        # the commonest first; lines of equal count must not depend on their order in this test's corpus
        for m, _ in sorted(lines, key=lambda x: -len(x[1])):
            fits = [(sum(a == b and a != 0 for a, b in zip(t, m, strict=True)), -j) for j, (t, _) in enumerate(templates)]
            best, j = max(fits, default=(0, 0))
            if fits and best / len(m) >= similarity:
                t, members = templates[-j]
                templates[-j] = (tuple(a if a == b else 0 for a, b in zip(t, m, strict=True)), [*members, m])
            else:
                templates.append((m, [m]))
        for _, members in templates:
            every = set().union(*(docs[m] for m in members))
            if len(every) >= min_docs:
                owner.update({m: min(every) for m in members})
    for i, t in enumerate(texts):
        gone |= {(i, no) for no, x in enumerate(t.split("\n")) if x.split() and owner.get(masked(x), i) != i}
    return gone


@pytest.mark.parametrize("leaf_lines", [2, 20_000])
def test_op8_equals_a_plain_template_tree(spark, leaf_lines):
    rng = random.Random(23)
    names = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(40)]
    prose = lambda: " ".join("".join(rng.choice("klmnopqr") for _ in range(5)) for _ in range(9))
    texts = []
    for i in range(150):
        name = names[min(int(rng.expovariate(0.12)), 39)]
        texts.append("\n".join([prose(), f"written by {name} for the library of the town", "", f"page {i} of {rng.randint(2, 9)}", "see also the index", prose()][: rng.randint(1, 6)]))
    texts += ["", " \n\t", "see also the index\nsee also the index"]
    # the order of lines of equal count is by their hashes; where it could matter this corpus would not do
    rows = {r["doc_id"]: r["kept_text"] for r in op8.drop_lines(docs_of(spark, texts), 10, leaf_lines=leaf_lines).collect()}
    gone = tree(texts, 10)
    assert len(gone) > 100
    for i, t in enumerate(texts):
        assert rows[i] == "\n".join(x for no, x in enumerate(t.split("\n")) if (i, no) not in gone)


def test_op6_bands():
    for percent in (3, 10, 30, 50, 70, 80, 85, 95, 100):
        n, r = op6.bands(percent)
        assert n * r <= 192 and (1 - (percent / 100) ** r) ** n <= 0.01
    assert op6.bands(85) == (32, 6) and op6.bands(80) == (38, 5)
    with pytest.raises(ValueError):
        op6.bands(1)


def test_pipeline_keeps_columns_and_rows_of_one_id(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(24)
    prose = lambda: " ".join("".join(rng.choice("aeiklmnost") for _ in range(5)) for _ in range(40))
    texts = [prose() for _ in range(8)]
    docs = docs_of(spark, [*texts, texts[0], None, ""], [1, 1, 2, 3, None, None, 6, 7, 9, 10, 11])
    for c in CLASH:
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    marks_of(spark).write.parquet(f"{tmp_path}/labels.parquet")
    items_of(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, str(tmp_path))
        last = i == len(cp.STAGES) - 1
        assert [c for c in out.columns if not last or c not in ("size", "target", "taken")] == [c for c in docs.columns if not last or c not in ("size", "target", "taken")]
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        mine = [c for c in CLASH if not last or c not in ("size", "target", "taken")]
        assert docs.filter(" or ".join(f"`{c}` != 'own {c}'" for c in mine)).count() == 0
    rows = docs.collect()
    # the copy goes; rows that share an id stay
    assert Counter(r["doc_id"] for r in rows) == Counter({1: 2, 2: 1, 3: 1, None: 2, 6: 1, 7: 1, 10: 1, 11: 1})
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert r["size"] == len((r["text"] or "").split()) and 0 <= r["taken"] <= 2 * r["size"]
    for v in by.values():
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) < 1
