"""Each stage of the pipeline against a plain version over its own input."""

import random
import re
from collections import defaultdict

import corpus_pipeline as cp
from lexforge.llm.op10_toxicity import toxicity

from .test_llm import LOWER, SPACE


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeiouklmnprst") for _ in range(rng.randint(4, 9)))
    vocabulary = [word() for _ in range(3000)]
    prose = lambda n=60: [rng.choice(vocabulary) for _ in range(n)]
    items = [" ".join(prose(30)) for _ in range(4)]
    docs, labels = [], []
    for i in range(240):
        lines = [" ".join(prose()), " ".join(prose(20))]
        if i % 6 == 1:
            lines.append("all rights reserved by nobody")
        if i % 8 == 2:
            lines[0] += " " + items[i % 4]
        if i % 10 == 3:
            t = lines[0].split()
            for _ in range(3):
                t[rng.randrange(len(t))] = rng.choice(["zwonker", "blarghly", "frubbled"])
            lines[0] = " ".join(t)
        if i % 12 == 4 and docs:
            t = docs[-4].split(" ")
            t[rng.randrange(len(t))] = word()
            lines = " ".join(t).split("\n")
        docs.append("\n".join(lines))
        labels.append((i, int(i % 10 == 3), 1))
    return docs, labels, items


def near(texts):
    sets = {}
    for i, t in texts.items():
        w = t.translate(LOWER).split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    owners = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            owners[g].append(i)
    label = {i: i for i in sets}
    pairs = {(a, b) for o in owners.values() for a in o for b in o if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in links:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {i for i in label if label[i] == i}


def contaminated(text, windows):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
    hit = {j for i in range(len(w) - 12) if tuple(w[i : i + 13]) in windows for j in range(i, i + 13)}
    return bool(hit) and 20 * len(hit) >= len(w)


def test_stages(spark, tmp_path):
    texts, labels, items = corpus()
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stage = dict(cp.STAGES)

    def step(name, df):
        path = f"{d}/out_{name}"
        stage[name](spark, df, d).write.parquet(path)
        out = spark.read.parquet(path)
        return out, {r["doc_id"]: r for r in out.collect()}

    docs1, kept = step("toxicity", docs)
    predicted = {r["doc_id"] for r in toxicity(docs, spark.read.parquet(f"{d}/labels.parquet")).filter("predicted = 1").collect()}
    assert set(kept) == set(range(240)) - predicted
    toxic = {i for i, t in enumerate(texts) if re.search("zwonker|blarghly|frubbled", t)}
    assert len(predicted ^ toxic) <= 2

    before = {i: r["text"] for i, r in kept.items()}
    docs2, kept = step("line_dedup", docs1)
    owners = defaultdict(set)
    for i, t in before.items():
        for x in t.split("\n"):
            owners[x].add(i)
    drop = {x: min(o) for x, o in owners.items() if len(o) >= 10 and x.strip()}
    assert drop
    want = {i: "\n".join(x for x in t.split("\n") if drop.get(x, i) == i) for i, t in before.items()}
    assert {i: r["text"] for i, r in kept.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in kept.values())

    docs3, kept3 = step("near_duplicates", docs2)
    assert set(kept3) == near(want) and len(kept3) < len(want)

    docs4, kept4 = step("decontamination", docs3)
    windows = {tuple(t.split()[i : i + 13]) for t in items for i in range(len(t.split()) - 12)}
    assert set(kept4) == {i for i, r in kept3.items() if not contaminated(r["text"], windows)} and len(kept4) < len(kept3)

    _, mixed = step("mixing", docs4)
    assert set(mixed) == set(kept4)
    by = defaultdict(list)
    for r in mixed.values():
        assert r["size"] == len(re.findall(SPACE, r["text"])) and 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]].append(r)
    for rows in by.values():
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) < 1
    assert {i: r["taken"] for i, r in mixed.items()} == {r["doc_id"]: r["taken"] for r in cp.run(spark, d).collect()}
