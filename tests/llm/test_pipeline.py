import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from gridloom.staging import staged

    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = staged(stage(spark, before, sf), name)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert 0 < out.count() <= before.count()
        assert out.select("doc_id").distinct().count() == out.count()
        before = out
    assert before.filter(F.col("text").rlike("AKIA[A-Z0-9]{16,}")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    assert packed.select("doc_id").distinct().count() == before.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_empty_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_edge_rows_through_all_stages(spark, docs, tmp_path):
    """Nulls, blanks, copies, a repeated row, a very long text and clashing columns go through the stages together."""
    from gridloom.staging import staged
    from tests.llm.conftest import TEXTS

    spark.createDataFrame([(i, 1, 0) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = staged(stage(spark, before, str(tmp_path)), name)
        assert before.schema == docs.schema
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert sorted(texts) == [i for i, t in enumerate(TEXTS) if t not in TEXTS[:i] and (t is None or t.strip())]
    assert texts[5] == TEXTS[5] and "hunter" not in texts[8]
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == set(texts)
