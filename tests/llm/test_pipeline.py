"""The pipeline's stages keep what they should, and columns stay those of documents."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == columns and 0.8 * n < docs.count() <= n
        n = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == n
    assert {r[0] for r in last.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}
    assert last.selectExpr("count_if(decoded_sha256 is null) AS n").first().n == 0
