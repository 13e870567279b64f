import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tokenloom.operators import ann, topk
from tokenloom.operators import vectors as vx
from tokenloom.sources import fixtures as fx

T0 = dt.datetime(2024, 1, 1)
T1 = dt.datetime(2024, 1, 2)
SCHEMA = "entity_type string, entity_id long, store_id int, platform string, model string, " \
         "dimensions long, vector array<float>, created_at timestamp_ntz, updated_at timestamp_ntz"


def test_upsert_keeps_created_at_and_later_sequence_wins(spark):
    old = spark.createDataFrame([("product", 1, 0, "p", "m", 2, [1.0, 0.0], T0, T0)], SCHEMA)
    batch = spark.createDataFrame([("product", 1, 0, "p", "m2", 2, [0.0, 1.0], T1, T1, 1),
                                   ("product", 1, 0, "p", "m3", 2, [2.0, 2.0], T1, T1, 2),
                                   ("product", 2, 0, "p", "m", 2, [3.0, 3.0], T1, T1, 1)],
                                  SCHEMA + ", seq int")
    out = {r.entity_id: r for r in vx.upsert_vectors(old, batch).collect()}
    assert out[1].model == "m3" and out[1].created_at == T0 and out[1].updated_at == T1
    assert out[2].created_at == T1
    again = vx.upsert_vectors(vx.upsert_vectors(old, batch), batch)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, vx.upsert_vectors(old, batch).collect()))


def test_decode_bad_json_is_empty(spark):
    df = spark.createDataFrame([("[0.1,2e-3]",), ("{bad",), (None,)], "vector string")
    got = [r.vector for r in vx.decode_vectors(df).collect()]
    assert np.allclose(got[0], [0.1, 0.002]) and got[1] == [] and got[2] == []


def test_truncate_and_clear(spark):
    df = spark.createDataFrame([("product", 1, 0, "p", "m", 3, [3.0, 4.0, 5.0], T0, T0),
                                ("product", 2, 0, "p", "m", 1, [2.0], T0, T0)], SCHEMA)
    t = {r.entity_id: r.vector for r in vx.truncate_vectors(df, 2).collect()}
    assert np.allclose(t[1], [0.6, 0.8]) and t[2] == [2.0]
    assert vx.clear_vectors(df, F.col("entity_id") == 1).count() == 1
    try:
        vx.clear_vectors(df, None)
        raise AssertionError("expected refusal")
    except ValueError:
        pass


def test_ann_recall_and_scored_share(spark, small, medium):
    for folder in (small, medium):
        v = fx.scoped_vectors(spark, folder)
        exact = topk.cosine_topk(v, v, 3, exclude_self=True)
        got = ann.ann_topk(v, v, 3, exclude_self=True)
        assert ann.recall(got, exact).first().recall >= 0.9
        assert ann.RERANK < 0.2 * v.count()
        truth = {tuple(r)[:6]: r.similarity for r in exact.collect()}
        for r in got.collect():     # the final order is exact
            if tuple(r)[:6] in truth:
                assert abs(r.similarity - truth[tuple(r)[:6]]) < 1e-12


def test_ann_probing_and_scoring_everything_is_exact(spark, small, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_CODES", 60)      # many shards and query blocks
    monkeypatch.setattr(ann, "QUERY_BLOCK", 100)
    v = fx.scoped_vectors(spark, small)
    exact = {(r.query_id, r.query_store_id, r.neighbor_id, r.neighbor_store_id, r["rank"]) for r in topk.cosine_topk(v, v, 3, exclude_self=True).collect()}
    full = ann.ann_topk(v, v, 3, exclude_self=True, rerank=10_000, probe_share=1.0)
    assert {(r.query_id, r.query_store_id, r.neighbor_id, r.neighbor_store_id, r["rank"]) for r in full.collect()} == exact
    shares = []
    for share in (0.05, 0.3, 1.0):
        got = ann.ann_topk(v, v, 3, exclude_self=True, rerank=10_000, probe_share=share).collect()
        shares.append(len({(r.query_id, r.query_store_id, r.neighbor_id, r.neighbor_store_id, r["rank"]) for r in got} & exact))
    assert 0 < shares[0] < shares[1] < shares[2] == len(exact)


def test_ann_clusters_need_few_probes(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.05 * rng.normal(size=16)).astype(float).tolist()) for i in range(600)]
    v = spark.createDataFrame(rows, "entity_id long, vector array<float>")
    exact = topk.cosine_topk(v, v, 5, exclude_self=True)
    got = ann.ann_topk(v, v, 5, exclude_self=True, probe_share=0.1)
    assert ann.recall(got, exact).first().recall >= 0.9


def test_ann_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [0.6, 0.8]), (6, [1.0, 2.0, 3.0])]
    v = spark.createDataFrame(rows, "entity_id long, vector array<float>")
    got = {(r.query_id, r.neighbor_id) for r in ann.ann_topk(v, v, 3, exclude_self=True).collect()}
    assert got == {(1, 5), (5, 1)}
    assert ann.ann_topk(v.where("false"), v.where("false"), 3).collect() == []
    alone = v.where("entity_id = 6")
    assert ann.ann_topk(alone, alone, 3, exclude_self=True).collect() == []


def test_save_condition_falsy_context(spark):
    rows = [(1, '{"entity_type":"product","entity_id":5}'), (2, "{}"), (3, "{bad"),
            (4, '{"entity_type":"product","entity_id":0}'), (5, '{"entity_type":"0","entity_id":7}'),
            (6, '{"entity_type":"category","entity_id":"12"}')]
    df = spark.createDataFrame(rows, "task_id long, context string").withColumn("task_type", F.lit("embedding"))
    got = {r.task_id: r.save for r in vx.save_condition(df).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True}


def test_provider_registry_capability_order(spark):
    from tokenloom.sources.dims import provider_dim, providers_with_capability
    got = [r.code for r in providers_with_capability(provider_dim(spark), "embed").collect()]
    assert got == ["openai", "google", "mistral", "ollama", "generic"]
    img = [r.code for r in providers_with_capability(provider_dim(spark), "image").collect()]
    assert img == ["openai", "google", "openrouter", "generic"]


def test_ann_answers_every_dimension(spark):
    from tokenloom.operators.ann import ann_topk
    from tokenloom.operators.topk import cosine_topk
    rows = [(i, [float(i + 1), 1.0] if i % 2 else [1.0, float(i), 2.0]) for i in range(12)]
    v = spark.createDataFrame(rows, "entity_id long, vector array<double>")
    key = lambda df: sorted((r.query_id, r.rank, r.neighbor_id) for r in df.collect())
    exact = key(cosine_topk(v, v, 2, exclude_self=True))
    assert key(ann_topk(v, v, 2, lists=3, probe_share=1.0, exclude_self=True)) == exact
    assert len({q for q, _, _ in exact}) == 12
