"""Each stage of the pipeline on its own input."""

import corpus_pipeline
from pathloom.llm import jaccard

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        if name == "ngram_jaccard_join":
            classes = {r["doc_id"]: r["component_id"] for r in jaccard.link_classes(docs).collect()}
            assert sorted(r["doc_id"] for r in out.collect()) == sorted(k for k, v in classes.items() if k == v)
        docs = spark.createDataFrame(out.collect(), out.schema)
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert ids.count() == docs.count() < before and ids.where("not round_trip").count() == 0
    assert docs.where("text rlike 'token = \"[0-9a-f]{40}\"'").count() == 0
