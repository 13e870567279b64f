import corpus_pipeline as p
from tokenloom.llm import decontam, jaccard, quality


def test_stages_follow_each_other(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    d = docs
    seen = []
    for name, stage in p.STAGES[:-1]:
        d = stage(spark, d, small)
        assert d.columns == docs.columns, name
        d = spark.createDataFrame(d.toPandas(), docs.schema)
        seen.append({r.doc_id for r in d.collect()})
    kept = {r.doc_id for r in quality.op9(docs).where("kept").collect()}
    assert seen[0] == kept
    classes = {r.doc_id: r.class_id for r in jaccard.near_duplicates(docs.where(docs.doc_id.isin(list(kept)))).collect()}
    assert seen[1] == {i for i, c in classes.items() if i == c}
    leaks = {r.doc_id for r in decontam.op6(docs, bench).where("contaminated").collect()}
    assert seen[2] == seen[1] - leaks
    assert seen[3] <= seen[2]
    out = p.run(spark, small).collect()
    assert {r.doc_id for r in out} == seen[3] and sum(r.n_tokens for r in out) > 0


def test_empty_table(spark, odd_docs, no_docs, small):
    for first in (no_docs, odd_docs):
        d = first
        for name, stage in p.STAGES:
            d = stage(spark, d, small)
        assert d.count() >= 0
