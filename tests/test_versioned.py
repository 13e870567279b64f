"""Versioned store: snapshots, crash safety, splitting buckets, exactly-once merges."""

import glob
import math
import os

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import vectors as vx
from tokenloom.plans import vectorstore as vs
from tokenloom.plans import versioned as vd
from tokenloom.session import scratch_path
from tokenloom.sources import fixtures as fx

COLS = ["entity_type", "entity_id", "store_id", "dimensions", "vector", "created_at", "updated_at"]


def rows(df, cols=COLS):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def simple(spark, pairs, kind="long"):
    return spark.createDataFrame(pairs, f"k {kind}, v string")


def replace_all(batch):
    """Merge rule of the tests: the batch's rows win by key."""
    def combine(current):
        old = current["t"].join(batch.select("k"), "k", "left_anti")
        return {"t": old.unionByName(batch.select(*current["t"].columns))}
    return combine


def store_of(spark, pairs, max_rows):
    return vd.VersionedStore.create(spark, scratch_path(spark, "store"), {"t": simple(spark, pairs)}, ["k"], max_rows)


def test_merge_equals_upsert_and_touches_only_its_buckets(spark, small):
    base, batch = fx.vectors(spark, small), fx.vector_batch(spark, small)
    store = vs.create_vectors(spark, scratch_path(spark, "vec"), base, max_rows=100)
    before = store.state()
    assert len(before.rows) == 8 and sum(before.rows.values()) == base.count()   # 500 rows
    one = batch.where(F.col("entity_id") == 0)
    vs.merge_vectors(store, one)
    after = store.state()
    changed = [b for b in after.folders if after.folders[b] != before.folders.get(b)]
    assert len({b[:4] for b in changed}) == 1                                   # one old bucket (or its parts)
    vs.merge_vectors(store, batch)
    vs.merge_vectors(store, batch)                                               # again: no change of content
    assert rows(vs.read_vectors(store)) == rows(vx.upsert_vectors(base, batch))
    assert rows(vs.read_vectors(store, 1)) == rows(base)                         # earlier versions stay


def test_stored_created_at_stays(spark):
    import datetime as dt
    t = [dt.datetime(2024, 1, d) for d in range(1, 10)]
    kind = ("entity_type string, entity_id long, store_id int, platform string, model string, dimensions long, "
            "vector array<float>, created_at timestamp_ntz, updated_at timestamp_ntz, seq int")
    old = spark.createDataFrame([("product", 1, 0, "p", "m", 1, [1.0], t[4], t[4], -1)], kind)
    new = spark.createDataFrame([("product", 1, 0, "p", "m", 1, [2.0], t[1], t[6], 1),
                                 ("product", 1, 1, "p", "m", 1, [3.0], t[2], t[7], 2),
                                 ("product", 1, 1, "p", "m", 1, [4.0], t[3], t[6], 1)], kind)
    got = {r.store_id: (r.vector[0], r.created_at) for r in vx.upsert_vectors(old, new).collect()}
    assert got == {0: (2.0, t[4]), 1: (3.0, t[3])}   # the new key's first version was that of t[6]


def test_buckets_split_as_they_fill(spark):
    store = store_of(spark, [(i, "a") for i in range(10)], max_rows=16)
    assert list(store.state().rows) == ["b"]
    want = {i: "a" for i in range(10)}
    for start, n, text in ((10, 20, "b"), (30, 200, "c"), (0, 5, "d"), (225, 3, "e")):
        batch = simple(spark, [(i, text) for i in range(start, start + n)])
        store.merge(batch, replace_all(batch))
        want.update({i: text for i in range(start, start + n)})
        state = store.state()
        assert dict(map(tuple, store.read("t").collect())) == want
        assert sum(state.rows.values()) == len(want)
        # Names form a complete prefix code: every hash falls into one bucket.
        assert math.isclose(sum(2.0 ** -(len(b) - 1) for b in state.rows), 1)
        assert max(state.rows.values()) <= 2 * 16
    assert len(state.rows) > 8
    found = store.lookup("t", simple(spark, [(7, ""), (229, ""), (999, "")], "int"))   # another integer type
    assert sorted(map(tuple, found.collect())) == [(7, "a"), (229, "c")]
    scanned = store.lookup("t", simple(spark, [(7, "")])).inputFiles()
    assert len(scanned) < len(state.rows) / 2


def test_killed_merge_leaves_the_old_version(spark, monkeypatch):
    store = store_of(spark, [(i, "a") for i in range(40)], max_rows=8)
    want = sorted(map(tuple, store.read("t").collect()))
    batch = simple(spark, [(i, "b") for i in range(60)])

    # Killed after the data was written, before the commit.
    with monkeypatch.context() as m:
        m.setattr(vd.VersionedStore, "_commit", lambda self, state: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.merge(batch, replace_all(batch))
    assert store.state().version == 1 and sorted(map(tuple, store.read("t").collect())) == want

    # Killed while tasks were writing.
    boom = F.when(F.col("k") == 39, F.raise_error(F.lit("lost"))).otherwise(F.col("v"))
    with pytest.raises(Exception, match="lost"):
        store.merge(batch, lambda current: {"t": current["t"].withColumn("v", boom)})
    assert sorted(map(tuple, store.read("t").collect())) == want

    # Run again, then clear away what the killed runs left.
    assert store.merge(batch, replace_all(batch)) == 2
    assert sorted(map(tuple, store.read("t").collect())) == [(i, "b") for i in range(60)]
    local = store.root.replace("file:", "")
    assert len(os.listdir(f"{local}/data")) >= 3
    store.vacuum(keep=1)
    assert len([d for d in os.listdir(f"{local}/data") if not d.startswith(".")]) == 1
    assert sorted(map(tuple, store.read("t").collect())) == [(i, "b") for i in range(60)]
    with pytest.raises(ValueError, match="no version 1"):
        store.read("t", 1)


def test_a_batch_number_is_applied_once(spark):
    store = store_of(spark, [(1, "a")], max_rows=8)
    for text, number in (("b", 5), ("c", 5), ("d", 4)):
        batch = simple(spark, [(1, text)])
        assert store.merge(batch, replace_all(batch), "feed", number) == 2
    assert [tuple(r) for r in store.read("t").collect()] == [(1, "b")]
    none = simple(spark, [])
    assert store.merge(none, replace_all(none)) == 2                       # nothing to do
    assert store.merge(none, replace_all(none), "feed", 6) == 3            # noted
    assert store.state().applied == {"feed": 6}
    assert [tuple(r) for r in store.history().orderBy("version").collect()] == [(1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_empty_store_and_null_keys(spark):
    store = store_of(spark, [], max_rows=4)
    assert store.read("t").collect() == [] and store.lookup("t", simple(spark, [(1, "")])).collect() == []
    batch = simple(spark, [(None, "n"), (1, "a")])
    store.merge(batch, lambda current: {"t": current["t"].unionByName(batch)})
    assert sorted(map(tuple, store.read("t").collect()), key=str) == [(1, "a"), (None, "n")]


def test_second_writer_is_detected(spark, monkeypatch):
    store = store_of(spark, [(1, "a")], max_rows=8)
    real = vd.uuid.uuid4
    state = store.state()
    state.version = 2
    store._commit(state)
    files = glob.glob(store.root.replace("file:", "") + "/manifests/version=2/*.parquet")
    kept = [(f, open(f, "rb").read()) for f in files]
    original = vd.VersionedStore._manifests

    def raced(self):
        for f, data in kept:   # the other writer's file stands beside ours
            os.makedirs(os.path.dirname(f), exist_ok=True)
            with open(f, "wb") as out:
                out.write(data)
        return original(self)

    monkeypatch.setattr(vd.VersionedStore, "_manifests", raced)
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit(state)
    assert vd.uuid.uuid4 is real


def test_a_table_may_follow_from_the_others_as_stored(spark):
    tables = {"a": simple(spark, [(1, "x"), (2, "y")]), "b": simple(spark, [])}
    store = vd.VersionedStore.create(spark, scratch_path(spark, "store"), tables, ["k"], 8)
    seen = []

    def follows(new):
        seen.extend(new["a"].inputFiles())
        return new["a"].where("v = 'z'")

    store.merge(simple(spark, [(1, "z")]), lambda now: {
        "a": now["a"].select("k", F.when(F.col("k") == 1, "z").otherwise(F.col("v")).alias("v")), "b": follows})
    assert [tuple(r) for r in store.read("b").collect()] == [(1, "z")]
    assert seen and all("/data/2-" in f for f in seen)                  # not computed again


def test_appended_bucket_is_written_anew_when_it_has_outgrown_its_bounds(spark, monkeypatch):
    monkeypatch.setattr(vd, "MAX_FOLDERS", 2)
    store = store_of(spark, [(0, "0"), (1, "1")], max_rows=2)
    for i in (2, 3, 4):
        one = simple(spark, [(i, str(i))]).coalesce(1)
        store.append("t", one, one)
    state = store.state()
    assert sorted(r.k for r in store.read("t").collect()) == list(range(5)) and len(state.rows) > 1
    assert max(len(f["t"].splitlines()) for f in state.folders.values() if "t" in f) <= 2
