"""Pipeline stages on documents with clashing names and types without an order."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tokenloom.llm import decontam, jaccard, mixing, quality, tokens

CLASH = ["_id", "_keep", "_ident", "_row", "row", "_d", "_s", "_k", "_key", "_group", "size", "key", "p", "t", "words",
         "_source", "_position", "_epoch", "class_id", "ids", "part", "n", "class"]


@pytest.fixture(scope="module")
def clashing(docs):
    odd = docs.where("doc_id < 60").withColumns({c: F.lit(c) for c in CLASH})
    odd = odd.withColumn("tags", F.create_map(F.lit("a"), F.col("doc_id").cast("string")))
    return odd.unionByName(odd.where("doc_id < 5"))         # repeated rows


def plain(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_every_stage_keeps_columns_and_gives_the_same_documents(spark, small, clashing):
    bench = spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text")
    bare = clashing.select("doc_id", "text", "lang", "source", "n_chars")
    for stage in (quality.filter_documents, jaccard.deduplicate, lambda d: decontam.remove_leaks(d, bench), mixing.mix):
        got = stage(clashing)
        assert got.columns == clashing.columns
        assert plain(got) == plain(stage(bare))
        assert all(r.tags == {"a": str(r.doc_id)} and r["_id"] == "_id" for r in got.collect())
    assert sorted(map(tuple, tokens.op8(clashing).collect())) == sorted(map(tuple, tokens.op8(bare).collect()))


def test_stages_on_empty_clashing_tables(spark, small, clashing):
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, clashing.where("false"), small)
        assert got.collect() == []
        assert number == 4 or got.columns == clashing.columns
