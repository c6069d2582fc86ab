import corpus_pipeline


def test_stages_and_rows(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontaminate", "mixture", "token_output"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        docs = corpus_pipeline.materialize(out, "stage")
        assert docs.count() > 20
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").orderBy("start").collect()
    assert len(rows) == docs.count() and rows[0].start == 0
