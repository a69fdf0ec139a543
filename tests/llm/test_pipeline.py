"""The pipeline's stages one after the other, and that it gives what its stages give."""

import corpus_pipeline


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf), name)
        assert 0 < docs.count() <= before, name
        before = docs.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    want = {r.doc_id: tuple(r.ids) for r in docs.collect()}
    assert {r.doc_id: tuple(r.ids) for r in corpus_pipeline.run(spark, sf).collect()} == want
