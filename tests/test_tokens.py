"""Tokens and matches against Python's own, and what they hold in memory at once."""

import random
import re
import tracemalloc

import pyarrow as pa

from lexforge.operators import detect


def texts_of(n):
    random.seed(4)
    return [(i, None if i % 17 == 3 else "".join(random.choices("aÉß字😀 \t\n\r \u0085", k=random.choice([0, 1, 2, 9, 60])))) for i in range(n)]


def want_of(rows, around):
    out = []
    for i, x in rows:
        m = [(k.start(), k.end(), k.group()) for k in re.finditer(r"[^ \t\n\r]+", x or "")]
        at = lambda j, m=m: m[j] if 0 <= j < len(m) else (None, None, None)
        out += [(i, j, s, e, t, *([at(j - 2)[2], at(j - 1)[2], at(j + 1)[2], at(j + 2)[2], at(j + 1)[1]] if around else [])) for j, (s, e, t) in enumerate(m)]
    return out


def test_tokens_and_neighbours(spark, monkeypatch):
    rows = texts_of(300)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for around, f in ((False, detect.tokens), (True, detect.near_tokens)):
        assert sorted(map(tuple, f(df, "doc_id", "text").collect())) == want_of(rows, around)
        monkeypatch.setattr(detect, "_PIECE", 50)
        monkeypatch.setattr(detect, "_ROWS", 7)
        # in this process: small pieces and small batches, so that both edges fall inside of texts' tokens
        got = [tuple(r.values()) for b in detect._found(around)(iter([pa.RecordBatch.from_pydict({"d": [i for i, _ in rows], "t": [x or "" for _, x in rows]})])) for r in b.to_pylist()]
        assert got == want_of(rows, around)
        monkeypatch.undo()


def test_neighbours_without_shuffle(spark):
    df = detect.near_tokens(spark.createDataFrame([(1, "A İ b")], "doc_id bigint, text string"), "doc_id", "text", lower=True)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert [(r["token"], r["start"], r["end"], r["prev"]) for r in df.collect()] == [("a", 0, 1, None), ("i̇", 2, 3, "a"), ("b", 4, 5, "i̇")]


def test_scan(spark):
    rows = texts_of(120)
    got = spark.createDataFrame(rows, "doc_id bigint, text string").select("doc_id", "text", detect.scan(detect.F.col("text"), "[aß]+").alias("m"))
    for _, x, m in got.collect():
        assert (m is None) == (x is None)
        assert x is None or [tuple(r) for r in m] == [(k.start(), k.end(), k.group()) for k in re.finditer("[aß]+", x)]


def test_memory_of_a_batch():
    """A batch of texts of 8 MB: what its tokens hold at once is a small multiple of a piece, not of the batch."""
    batch = pa.RecordBatch.from_pydict({"d": list(range(2000)), "t": ["word " * 800] * 2000})
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    most, n = 0, 0
    for b in detect._found(True)(iter([batch])):
        n += len(b)
        most = max(most, pa.total_allocated_bytes() - before)
    peak = tracemalloc.get_traced_memory()[1] + most
    tracemalloc.stop()
    assert n == 1_600_000 and peak < 150e6
