"""Operator 11 against dense linear algebra on the distinct grid vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import whitening as w


def reference(rows, components=4):
    """Brute force: numpy's eigh of the covariance, exact integers for the rest."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(256 * float(np.float32(c)))) for c in v] for _, v in good])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    z = fit - s / n
    v = z.T @ z / n
    e, c = np.linalg.eigh(v)
    e, c = e[::-1][:components], c[:, ::-1][:, :components]
    white = (x - s / n) @ c / np.sqrt(e)
    return [i for i, _ in good], n, ((n * x - s) ** 2).sum(axis=1), white, e / np.trace(v)


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>" + extra)


def check(df, rows):
    ids, n, deviation, white, explained = reference(rows)
    got = df.orderBy("vec_id", "component").toPandas()
    k = white.shape[1]
    assert len(got) == k * len(ids)
    order = np.argsort(ids, kind="stable")
    assert got.vec_id.tolist() == np.repeat(np.array(ids)[order], k).tolist()
    assert set(got.n) == {n} and got.deviation.tolist() == np.repeat(deviation[order], k).tolist()
    mine = got.whitened.to_numpy().reshape(-1, k)
    for j in range(k):
        assert min(np.abs(mine[:, j] - white[order, j]).max(), np.abs(mine[:, j] + white[order, j]).max()) < 1e-9
    assert np.allclose(got.explained.to_numpy().reshape(-1, k), explained, rtol=1e-9)
    assert got.identity_error.max() < 1e-9


def test_whole_table(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding")
    check(w.op11(table), [tuple(r) for r in table.collect()])


def test_copies_count_once_and_bad_vectors_go(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(80)]
    rows += [(100 + i, rows[0][1]) for i in range(200)]                       # a third of all rows and more
    rows += [(400, [c + 1e-5 for c in rows[1][1]])]                             # same cell of the grid or its own
    rows += [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6)]
    check(w.op11(frame(spark, rows).repartition(7)), rows)


def test_repeated_and_null_ids_keep_their_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 5 or None, rng.normal(size=3).astype(np.float32).tolist()) for i in range(40)]
    got = w.op11(frame(spark, rows).repartition(3)).groupBy("vec_id").count().collect()
    assert {r["vec_id"]: r["count"] for r in got} == {None: 24, 1: 24, 2: 24, 3: 24, 4: 24}


def test_each_length_is_its_own_space_and_rank_bounds_components(spark):
    line = [(i, [0.1 * i, 0.2 * i, 0.0]) for i in range(6)]     # nearly one direction
    plane = [(10, [1.0, 0.0]), (11, [0.0, 1.0])]                # two points: one direction
    single, empty = [(20, [0.5] * 7)], [(30, [])]
    got = w.op11(frame(spark, line + plane + single + empty)).collect()
    assert {r["vec_id"] for r in got} == {*range(6), 10, 11}
    pair = [r for r in got if r["vec_id"] in (10, 11)]
    assert len(pair) == 2 and {r["n"] for r in pair} == {2} and {r["component"] for r in pair} == {1}
    assert sorted(abs(r["whitened"]) for r in pair) == pytest.approx([1, 1])
    assert all(r["explained"] == pytest.approx(1) for r in pair)


def test_huge_entries_saturate(spark):
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])]
    got = w.op11(frame(spark, rows)).collect()
    assert {r["vec_id"] for r in got} == {1, 2, 3}
    assert [r["deviation"] for r in got if r["vec_id"] == 1][0] is None
    assert w.op11(frame(spark, [(1, [1e16, 0.0]), (2, [0.0, 0.0])])).count() == 2


def test_empty_table_and_extra_columns(spark):
    assert w.op11(frame(spark, [])).collect() == []
    rows = [(i, [float(i), float(i * i)], "a", i) for i in range(5)]
    df = frame(spark, rows, ", n string, whitened int").withColumn("row", F.lit(1))
    out = w.whiten(df, w.fit(df))
    assert out.select("row.*").columns == ["vec_id", "n", "whitened", "row"] and out.count() == 5


@pytest.mark.parametrize("seed,d,rank", [(0, 1, 1), (1, 2, 2), (2, 9, 4), (3, 40, 40), (4, 33, 20)])
def test_cholesky_and_jacobi(seed, d, rank):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(d, rank)) * np.logspace(0, -3, rank)
    v = base @ base.T
    factor, order = w.pivoted_cholesky(v)
    assert factor.shape[1] == rank and np.allclose(np.triu(factor, 1), 0)
    assert np.allclose(factor @ factor.T, v[order][:, order], atol=1e-12)
    values, vectors = w.principal(v)
    exact = np.linalg.svd(base, compute_uv=False) ** 2
    assert np.allclose(values, exact, rtol=1e-7) and np.allclose(values[:1], exact[:1], rtol=1e-13)
    assert np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-12)
    assert np.allclose(v @ vectors, vectors * values, atol=1e-12)


def test_ties_and_nothing():
    values, vectors = w.principal(np.eye(5) * 3)
    assert np.allclose(values, 3) and np.allclose(vectors.T @ vectors, np.eye(5))
    assert len(w.principal(np.zeros((4, 4)))[0]) == 0


def test_sums_do_not_overflow(spark):
    big = 2.0 ** 62 / 256
    rows = [(i, [big, float(i)]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert w.fit(df)[2].sums == [9 << 62, 256 * 36]
