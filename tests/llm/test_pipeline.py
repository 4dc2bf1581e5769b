import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from newsloom.llm import set_join

SF_DIR = "/root/testdata/sf0.01"


def test_stages(spark, odd_documents):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "ngram_jaccard_join", "pii", "source_mix", "bpe"]
    for name, function in corpus_pipeline.STAGES[:-1]:
        assert function(spark, odd_documents, SF_DIR).columns == odd_documents.columns, name
        empty = function(spark, odd_documents.limit(0), SF_DIR)
        assert empty.count() == 0 and empty.columns == odd_documents.columns
    assert corpus_pipeline.encode_texts(spark, odd_documents, SF_DIR).count() == odd_documents.count()


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    ids = {r["doc_id"] for r in out.select("doc_id").collect()}
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    groups = {r["doc_id"]: r["component_id"] for r in set_join.group_documents(documents).collect()}
    assert ids and ids <= {r["doc_id"] for r in documents.select("doc_id").collect()}
    assert len(ids & bad) <= 0.02 * len(bad)
    kept = [groups[i] for i in ids]
    assert len(kept) - len(set(kept)) <= 0.02 * len(kept)


def test_whole_run_on_odd_rows(spark, odd_documents, tmp_path):
    """Columns that the operators would use themselves, nulls, repeated rows and long texts, stage after stage."""
    odd = odd_documents.withColumnsRenamed({"n": "_id", "size": "_set", "pattern": "_copies", "key": "_row", "part": "_copy"})
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF_DIR}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    found = [r["doc_id"] for r in out.collect()]
    assert set(found) <= {None, 1, 2, 3, 4, 5, 6, 7, 8} and found.count(1) <= 3
    odd.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{SF_DIR}/labels.parquet").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_every_operator_is_registered():
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in queries()) == 1
    assert "pipeline" in queries() and set(oracle_sql()) <= set(queries())
