import datetime as dt
import itertools

from pyspark.sql import functions as F

from tokenloom.operators import tasks as tk
from tokenloom.sources import fixtures as fx
from tokenloom.sources.dims import price_dim

AS_OF = dt.datetime(2024, 1, 31, 0, 5)


def _log(spark, rows):
    """rows: (task_id, status, retries, max_retries, started_at, completed_at)"""
    df = spark.createDataFrame(rows, "task_id long, status string, retries int, max_retries int, "
                                     "started_at timestamp_ntz, completed_at timestamp_ntz")
    return df.select("task_id", F.lit("c").alias("consumer"), F.lit("a").alias("action"),
                     F.lit("completion").alias("task_type"), "status", F.lit("background").alias("priority"),
                     F.lit("openai").alias("platform"), F.lit("gpt-4o").alias("model"),
                     F.lit(None).cast("string").alias("response"),
                     F.lit(0).cast("bigint").alias("input_tokens"), F.lit(0).cast("bigint").alias("output_tokens"),
                     F.lit(0).cast("decimal(10,6)").alias("estimated_cost"),
                     F.lit("old").alias("error_message"), "retries", "max_retries",
                     F.lit(AS_OF - dt.timedelta(hours=1)).cast("timestamp_ntz").alias("created_at"),
                     "started_at", "completed_at")


def test_recover_timeouts_boundaries_read_old_values(spark):
    old = AS_OF - dt.timedelta(seconds=121)
    fresh = AS_OF - dt.timedelta(seconds=60)
    rows = [(1, "processing", 2, 3, old, None), (2, "processing", 3, 3, old, None),
            (3, "processing", 4, 3, old, None), (4, "processing", 0, 3, fresh, None),
            (5, "pending", 0, 3, None, None)]
    out = {r.task_id: r for r in tk.recover_timeouts(_log(spark, rows), AS_OF).collect()}
    assert (out[1].status, out[1].retries, out[1].completed_at) == ("pending", 3, None)
    assert (out[2].status, out[2].retries, out[2].completed_at) == ("failed", 4, AS_OF)
    assert (out[3].status, out[3].retries) == ("failed", 5)
    assert out[1].error_message == "Task timed out"
    assert (out[4].status, out[4].retries, out[4].error_message) == ("processing", 0, "old")
    assert out[5].status == "pending"
    twice = tk.recover_timeouts(tk.recover_timeouts(_log(spark, rows), AS_OF), AS_OF)
    assert sorted(twice.collect()) == sorted(tk.recover_timeouts(_log(spark, rows), AS_OF).collect())


def _fold(status, r, m, outcomes):
    """Row-by-row reference fold of (attempt, ok) outcomes."""
    err = None
    for attempt, ok in sorted(outcomes):
        if status not in ("pending", "processing"):
            break
        if ok:
            status = "complete"
        elif r < m:
            status, r, err = "pending", r + 1, f"e{attempt}"
        else:
            status, err = "failed", f"e{attempt}"
    return status, r, err


def test_replay_matches_row_by_row_fold(spark):
    cases, outs = [], []
    tid = 0
    for r, m in itertools.product(range(6), range(5)):
        for n in range(1, 5):
            for pattern in itertools.product([False, True], repeat=n):
                tid += 1
                cases.append((tid, "pending", r, m, None, None))
                outs += [(tid, a, ok) for a, ok in enumerate(pattern)]
    tasks = _log(spark, cases)
    o = spark.createDataFrame(outs, "task_id long, attempt int, ok boolean").select(
        "task_id", "attempt", "ok", F.lit("resp").alias("response"),
        F.lit(1).cast("bigint").alias("input_tokens"), F.lit(1).cast("bigint").alias("output_tokens"),
        F.lit("openai").alias("platform"), F.lit("gpt-4o").alias("model"),
        F.concat(F.lit("e"), F.col("attempt").cast("string")).alias("error"))
    o = o.unionByName(o)  # duplicated delivery must not change anything
    got = {r.task_id: (r.status, r.retries, r.error_message)
           for r in tk.replay_attempts(tasks, o, price_dim(spark), AS_OF).collect()}
    by_task = {}
    for t, a, ok in outs:
        by_task.setdefault(t, []).append((a, ok))
    bad = []
    for t, _, r, m, _, _ in cases:
        status, rr, err = _fold("pending", r, m, by_task[t])
        exp = (status, rr, err if err is not None else "old")
        if got[t] != exp:
            bad.append((t, r, m, by_task[t], got[t], exp))
    assert not bad, bad[:5]


def test_retention_keeps_open_rows_and_null_completion(spark):
    old = AS_OF - dt.timedelta(days=200)
    rows = [(1, "complete", 0, 3, old, old), (2, "pending", 0, 3, None, None),
            (3, "complete", 0, 3, old, None), (4, "cancelled", 0, 3, old, old),
            (5, "processing", 0, 3, old, None), (6, "failed", 0, 3, old, AS_OF)]
    kept = {r.task_id for r in tk.retention(_log(spark, rows), AS_OF).collect()}
    assert kept == {2, 3, 5, 6}


def test_next_batch_interactive_first_then_oldest(spark, small):
    t = fx.task_log(spark, small)
    got = [r.task_id for r in tk.next_batch(t, 5).collect()]
    exp = [r.task_id for r in t.where("status = 'pending'").orderBy(
        F.when(F.col("priority") == "interactive", 0).otherwise(1), "created_at", "task_id").limit(5).collect()]
    assert got == exp
    assert "TakeOrderedAndProject" in tk.next_batch(t, 5)._jdf.queryExecution().executedPlan().toString()


def test_exact_percentile_matches_builtin(spark, small):
    t = fx.task_log(spark, small)
    ours = {(r.platform, r.model): (r.p50_run_s, r.p95_run_s) for r in tk.latency(t).collect()}
    run = F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("completed_at")) / 1e6
    ref = t.where("platform IS NOT NULL AND started_at IS NOT NULL").groupBy("platform", "model").agg(
        F.percentile(run, 0.5).alias("p50"), F.percentile(run, 0.95).alias("p95")).collect()
    for r in ref:
        got = ours[(r.platform, r.model)]
        assert abs(got[0] - r.p50) < 1e-9 and abs(got[1] - r.p95) < 1e-9


def test_unknown_type_fails_with_message(spark, small):
    t = fx.task_log(spark, small).where("status = 'pending'").limit(3) \
        .withColumn("task_type", F.lit("video")).withColumn("retries", F.lit(3))
    o = tk.unknown_type_outcomes(t)
    out = tk.apply_outcomes(t, o, price_dim(spark), AS_OF).collect()
    assert all(r.status == "failed" and r.error_message == "Unknown task type: video" for r in out)


def test_next_batch_tie_on_created_at_prefers_interactive_then_id(spark):
    t0 = dt.datetime(2024, 1, 5, 10)
    rows = [(3, "background", t0), (2, "interactive", t0), (1, "background", t0), (4, "interactive",
                                                                                   t0 + dt.timedelta(hours=1))]
    df = spark.createDataFrame(rows, "task_id long, priority string, created_at timestamp_ntz") \
        .withColumn("status", F.lit("pending"))
    assert [r.task_id for r in tk.next_batch(df, 3).collect()] == [2, 4, 1]


def test_decode_tasks_bad_json_is_empty(spark):
    df = spark.createDataFrame([(1, '[{"role":"user","content":"x"}]', "{}"), (2, "not json", "{bad"),
                                (3, None, None)], "task_id long, messages string, context string")
    got = {r.task_id: (len(r.messages_array), dict(r.context_map)) for r in tk.decode_tasks(df).collect()}
    assert got == {1: (1, {}), 2: (0, {}), 3: (0, {})}


def test_task_table_schema_evolution_roundtrip(spark, small):
    from tokenloom.plans.sinks import append_tasks
    from tokenloom.session import scratch_path
    from tokenloom.sources.tables import read_tasks
    t = fx.task_log(spark, small)
    path = scratch_path(spark, "task-table")
    split = F.lit(dt.datetime(2024, 1, 15)).cast("timestamp_ntz")
    append_tasks(t.where(F.col("created_at") < split).drop("task_type"), path)   # written before the column
    append_tasks(t.where(F.col("created_at") >= split), path)
    back = read_tasks(spark, path)
    assert back.count() == t.count()
    old = back.where(F.col("created_at") < split)
    assert old.where("task_type <> 'completion'").count() == 0
    new_types = {r.task_type for r in back.where(F.col("created_at") >= split).select("task_type").distinct().collect()}
    assert new_types == {"completion", "embedding", "image"}
    plan = read_tasks(spark, path).where(F.col("created_date") == F.lit(dt.date(2024, 1, 20)))._jdf \
        .queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_date" in plan


def test_infer_by_type_dispatches_and_reports_unknown(spark, small):
    from tokenloom.operators import infer as inf

    class Chat(inf.StubProvider):
        def complete(self, messages, options):
            return "chat", 1, 1

    t = fx.task_log(spark, small).where("status = 'pending'") \
        .withColumn("task_type", F.when(F.col("task_id") % 17 == 3, F.lit("video")).otherwise(F.col("task_type")))
    out = inf.infer_by_type(t, {"completion": Chat, "embedding": inf.StubProvider, "image": inf.StubProvider})
    got = {r.task_id: r for r in out.collect()}
    types = {r.task_id: r.task_type for r in t.collect()}
    assert set(got) == set(types)
    for tid, ty in types.items():
        if ty == "completion":
            assert got[tid].response == "chat"
        elif ty == "video":
            assert not got[tid].ok and got[tid].error == "Unknown task type: video"
        elif ty == "embedding":
            assert got[tid].response.startswith("[")


def test_embeddings_are_sent_in_batches(spark, small):
    from tokenloom.operators import infer as inf
    calls = spark.sparkContext.accumulator(0)

    class Counting(inf.StubProvider):
        def embed(self, texts, options):
            calls.add(1)
            return super().embed(texts, options)

    t = fx.task_log(spark, small).where("task_type = 'embedding'").coalesce(1)
    n = t.count()
    out = inf.infer_batch(t, Counting, embed_batch_size=16).collect()
    assert len(out) == n and all(r.ok and len(r.vector) == 4 for r in out)
    assert calls.value < n / 4     # grouped per (platform, model), 16 texts per call


def test_batched_embedding_keeps_billed_tokens(spark):
    """Tokens differ from characters; batching must not change them."""
    from tokenloom.operators import infer as inf

    class ThreeEach(inf.StubProvider):
        def embed(self, texts, options):
            return super().embed(texts, options)[0], 3 * len(texts)

    class Listed(inf.StubProvider):
        def embed(self, texts, options):
            return super().embed(texts, options)[0], [len(t) % 5 + 1 for t in texts]

    msgs = ['[{"role": "user", "content": "%s"}]' % ("x" * 400) for _ in range(5)]
    t = spark.createDataFrame([(i, "embedding", m, 0) for i, m in enumerate(msgs)],
                              "task_id long, task_type string, messages string, retries int")
    for provider in (ThreeEach, Listed):
        got = [{r.task_id: r.input_tokens for r in inf.infer_batch(t, provider, embed_batch_size=n).collect()} for n in (1, 4)]
        assert got[0] == got[1] == {i: 3 if provider is ThreeEach else 1 for i in range(5)}
    assert inf._tokens_per_text(10, ["aa", "bbbb", "c"]) == [3, 6, 1]


def test_latency_of_tasks_without_model(spark):
    import datetime as dt

    from tokenloom.operators.tasks import latency
    at = dt.datetime(2024, 1, 1)
    rows = [("p", None, 0, at, at, at + dt.timedelta(seconds=s)) for s in (1, 2, 2, 5)]
    t = spark.createDataFrame(rows, "platform string, model string, retries int, created_at timestamp_ntz, "
                                    "started_at timestamp_ntz, completed_at timestamp_ntz")
    r = latency(t).first()
    assert (r.p50_run_s, round(r.p95_run_s, 6)) == (2.0, 4.55)
