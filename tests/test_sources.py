import json

import pytest

from lexforge.sources import corpus
from lexforge.streaming import checker


def texts(df):
    return sorted(r["text"] for r in df.collect())


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" one \n\ntwo\n")
    assert texts(corpus.read(spark, str(tmp_path / "a.txt"))) == ["one", "two"]
    (tmp_path / "a.csv").write_text("id,text\n1,\"x, y\"\n2,\n3,z\n")
    assert texts(corpus.read(spark, str(tmp_path / "a.csv"))) == ["x, y", "z"]
    (tmp_path / "b.tsv").write_text("1\tp\n2\tq\n")
    assert texts(corpus.read(spark, str(tmp_path / "b.tsv"), column=1)) == ["p", "q"]
    (tmp_path / "a.jsonl").write_text('{"text": "k"}\nnot json{\n"s"\n')
    assert texts(corpus.read(spark, str(tmp_path / "a.jsonl"))) == ["k", "s"]
    (tmp_path / "bad.jsonl").write_text('{"other": 1}\n')
    with pytest.raises(Exception, match="no key"):
        corpus.read(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "a.json").write_text(json.dumps([{"text": "m"}, "n", {"text": ""}]))
    assert texts(corpus.read(spark, str(tmp_path / "a.json"))) == ["m", "n"]
    (tmp_path / "one.json").write_text('{"text": "single"}')
    assert texts(corpus.read(spark, str(tmp_path / "one.json"))) == ["single"]
    with pytest.raises(Exception, match="too large"):
        corpus.read(spark, str(tmp_path / "a.json"), max_json_bytes=3).collect()
    corpus.sample(spark).write.parquet(str(tmp_path / "p.parquet"))
    assert len(texts(corpus.read(spark, str(tmp_path / "p.parquet")))) == 3


def test_ingest_and_ledger(spark, tmp_path):
    rows = spark.createDataFrame([("မြန်_မာ", "b"), ("မြန်မာ", "a"), ("latin only", "a")], "text string, source string")
    assert [tuple(r) for r in corpus.ingest(rows).collect()] == [("မြန်မာ", "a")]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "x.txt").write_text("x")
    seen = spark.createDataFrame(corpus.files(spark, str(folder)).collect(), "path string, mtime timestamp, size bigint")
    assert corpus.changed(corpus.files(spark, str(folder)), seen).count() == 0
    (folder / "y.txt").write_text("y")
    (folder / "x.txt").unlink()
    assert corpus.changed(corpus.files(spark, str(folder)), seen).count() == 1
    assert corpus.removed(corpus.files(spark, str(folder)), seen).count() == 1


@pytest.mark.parametrize("kind", ["parquet", "tsv", "csv", "json"])
def test_tables_round_trip(spark, tmp_path, kind):
    rows = spark.createDataFrame([("a", 1), ("b c", 2)], "word string, frequency bigint")
    corpus.write_table(rows, str(tmp_path / "t"), kind)
    assert sorted(corpus.read_table(spark, str(tmp_path / "t"), "word string, frequency bigint", kind).collect()) == sorted(rows.collect())


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.txt").write_text("one two\n\nthree\n")
    q = checker.check(checker.lines(spark, str(folder)), lambda df: df.selectExpr("text", "length(text) AS n"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted((r["text"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("one two", 7), ("three", 5)]
    assert checker.progress(q)["lines"] >= 2
    schema = "conv_id bigint, turn bigint, text string"
    for k, part in enumerate([[(1, 0, "a" * 150), (2, 0, "x")], [(1, 1, "b"), (2, 1, None), (2, 2, "z")]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "turns" / f"p{k}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "turns"))
        q = checker.with_context(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "ctx")).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {(r["conv_id"], r["turn"]): r["context"] for r in spark.read.parquet(str(tmp_path / "ctx")).collect()}
    assert got == {(1, 0): "", (2, 0): "", (1, 1): "a" * 100, (2, 1): "x", (2, 2): ""}
