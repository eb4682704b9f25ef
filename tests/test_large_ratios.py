"""Words whose uses differ by more than a thousand times are pairs in SQL too."""

from lexforge.plans import corpus

from .compare import same


def test_levenshtein_pairs_of_any_ratio(spark, tmp_path):
    import duckdb

    spark.createDataFrame([(1, "abcd " * 60 + "abce abcf " * 60_060)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = corpus.QUERIES["levenshtein_pairs"](spark, str(tmp_path))
    assert got.count() == 3
    same(got, con, corpus.SQL["levenshtein_pairs"])
