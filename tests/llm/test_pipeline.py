import corpus_pipeline


def test_each_stage_reads_a_stored_table(spark, monkeypatch):
    files = []

    def stage(spark, docs, sf_dir):
        files.append(set(docs.inputFiles()))
        return docs.where("doc_id % 2 = 0" if len(files) == 1 else "doc_id % 3 = 0")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", stage), ("b", stage), ("c", stage)])
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    first, second, third = files
    assert all("documents.parquet" in f for f in first) and not second & first and not third & second
    assert all("/strandline/" in f for f in second | third)
    assert out.count() > 0 and out.where("doc_id % 6 <> 0").count() == 0
