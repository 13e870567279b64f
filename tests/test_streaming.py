"""Streaming = batch, late rows past the watermark, repeated deliveries."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from tokenloom.catalog import QUERIES, priced_calls
from tokenloom.operators import usage
from tokenloom.session import scratch_path
from tokenloom.streaming import streams as st

SCHEMA = "call_id string, called_at timestamp_ntz, consumer string, platform string, model string, " \
         "input_tokens long, output_tokens long, store_id int, estimated_cost decimal(10,6)"


def _calls(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _row(i, ts):
    return (f"c{i}", ts, "_direct", "openai", "gpt-4o", 10, 5, 0, None)


def test_stream_usage_equals_batch(spark, small):
    got = sorted(map(tuple, QUERIES["stream_usage"](spark, small).collect()))
    exp = usage.call_usage(priced_calls(spark, small))
    exp = exp.select([F.col(c).cast("double") if c == "estimated_cost" else F.col(c) for c in exp.columns])
    assert got == sorted(map(tuple, exp.collect()))


def test_late_rows_restarts_and_batches_run_again(spark):
    """However late a row is, the table ends equal to the batch rollup."""
    src, ckpt = scratch_path(spark, "late-src"), scratch_path(spark, "late-ckpt")
    store = st.usage_store(spark, scratch_path(spark, "late-usage"))
    d0 = dt.datetime(2024, 1, 10, 12)
    arrivals = [[_row(1, d0), _row(2, d0 + dt.timedelta(days=3))],
                [_row(3, d0 + dt.timedelta(days=2)), _row(4, dt.datetime(2021, 1, 1, 1))],     # years late
                [_row(5, d0), _row(6, dt.datetime(2021, 1, 1, 2)), (*_row(7, d0)[:3], None, *_row(7, d0)[4:])]]
    everything = []
    for rows in arrivals:
        _calls(spark, rows).write.mode("append").parquet(src)
        everything += rows
        got = st.stream_usage(st.file_stream(spark, src, _calls(spark, []).schema), store, ckpt)
        exp = usage.call_usage(_calls(spark, everything))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))
    version = store.state().version
    again = usage.call_usage(_calls(spark, arrivals[2]))
    assert store.merge(again, lambda now: {"usage": usage.usage_merge(now["usage"], again)}, "calls", 2) == version
    assert {r.period_date: r.request_count for r in store.read("usage").collect()} == {
        dt.date(2024, 1, 10): 2, dt.date(2024, 1, 12): 1, dt.date(2024, 1, 13): 1, dt.date(2021, 1, 1): 2}


def test_rate_limit_is_known_after_the_batch(spark):
    src, ckpt = scratch_path(spark, "rate-src"), scratch_path(spark, "rate-ckpt")
    store = st.rate_store(spark, scratch_path(spark, "rates"))
    minute = dt.datetime(2024, 1, 10, 12, 5)
    for n, want in ((2, [(minute, 2, False)]), (2, [(minute, 4, True)])):
        spark.createDataFrame([(minute + dt.timedelta(seconds=i),) for i in range(n)], "ts timestamp_ntz") \
            .write.mode("append").parquet(src)
        stream = st.file_stream(spark, src, "ts timestamp_ntz")
        got = st.stream_rate_limit(stream, "ts", 3, store, ckpt)
        assert [tuple(r) for r in got.collect()] == want


def test_stream_timeouts_equal_batch_rule(spark, small):
    got = {r.task_id for r in QUERIES["stream_timeouts"](spark, small).collect()}
    t = QUERIES["task_log"](spark, small).where("started_at IS NOT NULL")
    late = F.col("completed_at") > F.timestamp_add("SECOND", F.lit(120), F.col("started_at"))
    exp = {r.task_id for r in t.where(F.col("completed_at").isNull() | late).collect()}
    assert got == exp


SAVE = "entity_type string, entity_id long, store_id int, name string, short_description string, " \
       "description string, active boolean, changed_at timestamp_ntz"


def _save(hour, name, entity_id=1, store_id=0, entity_type="product", active=True):
    return (entity_type, entity_id, store_id, name, None, f"<p>{name}</p>", active, dt.datetime(2024, 1, 1, hour))


def test_embed_queue_only_for_changed_text(spark):
    src, queue, ckpt = (scratch_path(spark, f"saves-{x}") for x in ("src", "queue", "ckpt"))
    store = st.entity_store(spark, scratch_path(spark, "saves-seen"))
    arrivals = [
        ([_save(1, "a"), _save(1, "a"), _save(1, "a", store_id=1), _save(1, "a", entity_type="category")], 3),
        ([_save(2, "a"), _save(1, "a", store_id=1)], 0),                    # unchanged; delivered again
        ([_save(4, "c"), _save(3, "b")], 1),                                # the last save of a batch counts
        ([_save(3, "b"), _save(2, "x", entity_id=2, active=False), _save(2, "", entity_id=3)], 0),
        ([_save(5, "a"), _save(5, "x", entity_id=2)], 2),                   # back to an earlier text; switched on
        ([_save(6, "a", active=False)], 0),
        ([_save(7, "a")], 1),                                               # off and on again
    ]
    total = 0
    for rows, new in arrivals:
        spark.createDataFrame(rows, SAVE).coalesce(1).write.mode("append").parquet(src)
        stream = st.file_stream(spark, src, spark.createDataFrame([], SAVE).schema)
        got = st.stream_embed_queue(stream, store, queue, ckpt, dt.datetime(2024, 1, 2)).collect()
        total += new
        assert len(got) == len({r.task_id for r in got}) == total, rows
    seen = {tuple(r)[:3]: r.changed_at.hour for r in store.read("seen").collect()}
    assert seen == {("product", 1, 0): 7, ("product", 1, 1): 1, ("category", 1, 0): 1,
                    ("product", 2, 0): 5, ("product", 3, 0): 2}


def test_embed_queue_killed_between_tasks_and_state(spark, monkeypatch):
    src, queue, ckpt = (scratch_path(spark, f"killed-{x}") for x in ("src", "queue", "ckpt"))
    store = st.entity_store(spark, scratch_path(spark, "killed-seen"))
    spark.createDataFrame([_save(1, "a"), _save(1, "b", 2)], SAVE).write.parquet(src)

    def run():
        stream = st.file_stream(spark, src, spark.createDataFrame([], SAVE).schema)
        return st.stream_embed_queue(stream, store, queue, ckpt, dt.datetime(2024, 1, 2))

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda state: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(Exception):
            run()
    assert store.read("seen").count() == 0
    assert run().count() == run().count() == 2
    assert store.read("seen").count() == 2


def test_embed_queue_equals_batch_twin(spark, small):
    got = QUERIES["stream_embed_queue"](spark, small)
    assert got.count() == got.select("entity_type", "entity_id", "store_id").distinct().count()
    twin = QUERIES["queue_all"](spark, small)
    for store in (0, 1):
        mine = sorted(map(str, got.where(F.col("store_id") == store).drop("store_id").collect()))
        assert mine == sorted(map(str, twin.drop("store_id").collect()))


def test_stream_vector_upsert_is_order_free(spark, small):
    a = sorted(map(tuple, QUERIES["stream_vector_upsert"](spark, small).collect()))
    b = sorted(map(tuple, QUERIES["vector_upsert"](spark, small).collect()))
    assert a == b


def test_embed_queue_shuffles_no_texts_and_queues_a_double_save_once(spark):
    src, queue, ckpt = (scratch_path(spark, f"double-{x}") for x in ("src", "queue", "ckpt"))
    saves = spark.createDataFrame([
        _save(1, "a"), _save(1, "a"), _save(2, "b", 2), _save(2, "c", None), _save(3, "", 4)], SAVE)
    assert not {"text", "c"} & set(st._last_saves(saves).columns)
    saves.coalesce(1).write.parquet(src)
    store = st.entity_store(spark, scratch_path(spark, "double-seen"))
    got = st.stream_embed_queue(st.file_stream(spark, src, saves.schema), store, queue, ckpt, dt.datetime(2024, 1, 2))
    texts = [r.c for r in got.select(F.get_json_object("messages", "$[0].content").alias("c")).collect()]
    assert len(texts) == 3 and {t[0] for t in texts} == {"a", "b", "c"}


def test_screened_files_follow_the_cores(spark, small, monkeypatch):
    read = []
    monkeypatch.setattr(st, "file_stream", lambda s, path, schema, n=None: read.append((path, n)) or s.read.schema(
        schema).parquet(path))
    monkeypatch.setattr(st, "run_available_now", lambda v, out, ckpt: v.write.parquet(out) or out)
    QUERIES["stream_screen"](spark, small)
    (path, files), cores = read[0], spark.sparkContext.defaultParallelism
    assert files == cores and len(glob.glob(f"{path.replace('file:', '')}/part-*")) == 4 * cores


def test_files_of_a_day_do_not_grow_with_the_writing_tasks(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1 + i % 3, i % 24),) for i in range(96)], "ts timestamp_ntz")
    path = st.write_day_files(rows.repartition(16), "ts", scratch_path(spark, "days")).replace("file:", "")
    assert [len(glob.glob(f"{path}/day=2024-01-0{d}/part-*")) for d in (1, 2, 3)] == [1, 1, 1]
    assert spark.read.parquet(path).count() == 96
