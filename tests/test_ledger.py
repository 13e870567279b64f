"""Attempt ledger against a row-by-row fold: twice, in parts, in any order."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import ledger as lg
from tokenloom.operators import tasks as tk
from tokenloom.plans.tasklog import TaskLog
from tokenloom.schemas import TASK_SCHEMA
from tokenloom.session import scratch_path
from tokenloom.sources import fixtures as fx
from tokenloom.sources.dims import price_dim

AS_OF = dt.datetime(2024, 2, 1)
AT = dt.datetime(2024, 1, 1)
OUT = ("task_id long, attempt int, ok boolean, response string, input_tokens long, output_tokens long, "
       "platform string, model string, error string")
STATE = ["task_id", "status", "retries", "error_message", "completed_at", "response", "input_tokens",
         "output_tokens", "platform", "model", "estimated_cost"]


def log(spark, cases):
    """(task_id, status, retries, max_retries, error) rows."""
    rows = [(i, "c", "a", "completion", s, "background", None, "wanted", None, "[]", "{}", None, None, None, 0, 0,
             None, e, r, m, None, 0, AT, None, AT if s in ("complete", "failed", "cancelled") else None)
            for i, s, r, m, e in cases]
    rows = [tuple(0 if f.name == "estimated_cost" else v for f, v in zip(TASK_SCHEMA.fields, row)) for row in rows]
    kind = ", ".join(f"{f.name} {'int' if f.name == 'estimated_cost' else f.dataType.simpleString()}"
                     for f in TASK_SCHEMA.fields)
    return spark.createDataFrame(rows, kind).withColumn("estimated_cost", F.col("estimated_cost").cast("decimal(10,6)"))


def outcome(task, attempt, ok):
    return (task, attempt, ok, f"r{attempt}" if ok else None, 10 + attempt if ok else None, 5 if ok else None,
            "openai" if ok else None, "gpt-4o" if ok else None, None if ok else f"e{attempt}")


def fold_by_hand(status, r, m, error, attempts):
    """The data model's own transitions, one attempt after the other."""
    won = None
    if status not in ("pending", "processing") or not attempts:
        return status, r, error, None
    status = "pending"
    for a, ok in sorted(attempts):
        if ok:
            status, won = "complete", a
        elif r < m:
            status, r, error = "pending", r + 1, f"e{a}"
        else:
            status, error = "failed", f"e{a}"
        if status != "pending":
            break
    return status, r, error, won


def state(df):
    return {r.task_id: tuple(r)[1:] for r in df.select(*STATE).collect()}


def all_cases():
    cases, outs, i = [], [], 0
    for r, m in itertools.product(range(4), range(4)):
        for n in range(1, 5):
            for pattern in itertools.product([False, True], repeat=n):
                i += 1
                cases.append((i, "pending" if i % 2 else "processing", r, m, "before"))
                outs += [outcome(i, a + 1, ok) for a, ok in enumerate(pattern)]
    cases += [(10_001, "complete", 0, 3, None), (10_002, "cancelled", 0, 3, None), (10_003, "pending", 0, 3, None)]
    return cases, outs + [outcome(10_001, 1, False), outcome(10_002, 1, True), outcome(77_777, 1, True)]


def test_any_split_and_order_equals_one_fold_and_the_hand_fold(spark):
    cases, outs = all_cases()
    tasks, prices = log(spark, cases), price_dim(spark)
    batch = spark.createDataFrame(outs, OUT)
    once = state(tk.replay_attempts(tasks, batch, prices, AS_OF))
    by_task = {}
    for o in outs:
        by_task.setdefault(o[0], []).append((o[1], o[2]))
    for i, s, r, m, e in cases:
        status, retries, error, won = fold_by_hand(s, r, m, e, by_task.get(i, []))
        got = once[i]
        assert (got[0], got[1], got[2]) == (status, retries, error), (i, s, r, m, by_task.get(i))
        if won:
            assert got[4:8] == (f"r{won}", 10 + won, 5, "openai") and got[3] == AS_OF and got[9] > 0
        elif s in ("pending", "processing"):
            assert got[4:9] == (None, 0, 0, None, "wanted")
    random.seed(1)
    order = list(range(len(outs)))
    random.shuffle(order)
    part = [random.randrange(4) for _ in outs]
    led = lg.empty_ledger(spark)
    for p in (0, 1, 2, 3, 1, 0):                # parts in random order, two of them again
        sub = spark.createDataFrame([outs[j] for j in order if part[j] == p], OUT)
        tasks, led = lg.fold_once(tasks, led, sub, prices, AS_OF)
        tasks, led = tasks.checkpoint(), led.checkpoint()
    assert state(tasks) == once
    again, led2 = lg.fold_once(tasks, led, batch, prices, AS_OF + dt.timedelta(days=9))
    assert state(again) == once                 # later replay: nothing moves, not even completed_at
    assert sorted(map(str, led2.collect())) == sorted(map(str, led.collect()))
    assert led.selectExpr("max(size(entries))").first()[0] <= 3 + 2


def test_same_failure_twice_counts_once(spark):
    tasks, led = log(spark, [(1, "pending", 0, 3, None)]), lg.empty_ledger(spark)
    fail = spark.createDataFrame([outcome(1, 1, False)], OUT)
    for _ in range(3):
        tasks, led = lg.fold_once(tasks, led, fail, price_dim(spark), AS_OF)
    assert state(tasks)[1][:3] == ("pending", 1, "e1")


def test_timeouts_between_folds_start_a_new_epoch(spark):
    prices, led = price_dim(spark), lg.empty_ledger(spark)
    tasks = log(spark, [(1, "pending", 0, 3, None), (2, "pending", 0, 1, None)])
    first = spark.createDataFrame([outcome(1, 1, False), outcome(2, 1, False)], OUT)
    tasks, led = lg.fold_once(tasks, led, first, prices, AS_OF)
    # Both run again and time out: task 1 is queued with 2 retries, task 2 is over its budget.
    running = tasks.withColumn("status", F.lit("processing")).withColumn("started_at", F.lit(AT).cast("timestamp_ntz"))
    tasks = tk.recover_timeouts(running, AS_OF)
    assert {k: v[:3] for k, v in state(tasks).items()} == {1: ("pending", 2, tk.TIMEOUT_MESSAGE),
                                                           2: ("failed", 2, tk.TIMEOUT_MESSAGE)}
    late = spark.createDataFrame([outcome(1, 1, False), outcome(2, 1, False), outcome(2, 2, True)], OUT)
    tasks, led = lg.fold_once(tasks, led, late, prices, AS_OF)         # replays must not move either
    assert {k: v[:3] for k, v in state(tasks).items()} == {1: ("pending", 2, tk.TIMEOUT_MESSAGE),
                                                           2: ("failed", 2, tk.TIMEOUT_MESSAGE)}
    tasks, led = lg.fold_once(tasks, led, spark.createDataFrame([outcome(1, 3, True)], OUT), prices, AS_OF)
    assert state(tasks)[1][:3] == ("complete", 2, tk.TIMEOUT_MESSAGE)


def test_cancelled_after_a_fold_stays_cancelled(spark):
    prices = price_dim(spark)
    tasks, led = lg.fold_once(log(spark, [(1, "pending", 0, 3, None)]), lg.empty_ledger(spark),
                              spark.createDataFrame([outcome(1, 1, False)], OUT), prices, AS_OF)
    cancelled = tasks.withColumn("status", F.lit("cancelled"))
    tasks, _ = lg.fold_once(cancelled, led, spark.createDataFrame([outcome(1, 2, True)], OUT), prices, AS_OF)
    assert state(tasks)[1][:2] == ("cancelled", 1)


def test_two_successes_of_one_attempt_give_one_result(spark):
    tasks = log(spark, [(1, "pending", 0, 3, None)])
    two = [(1, 1, True, x, 1, 1, "openai", "gpt-4o", None) for x in ("b", "a")]
    got = {state(tk.replay_attempts(tasks, spark.createDataFrame(p, OUT).repartition(3), price_dim(spark), AS_OF))[1]
           for p in (two, two[::-1])}
    assert len(got) == 1 and next(iter(got))[4] == "b"


def test_empty_batch_and_null_ids(spark):
    tasks = log(spark, [(1, "pending", 0, 3, None)])
    none = spark.createDataFrame([], OUT)
    odd = spark.createDataFrame([(None, 1, True, "x", 1, 1, "p", "m", None), (1, 1, None, None, None, None, None, None, "?")],
                                OUT)
    assert state(lg.fold_once(tasks, lg.empty_ledger(spark), none, price_dim(spark), AS_OF)[0]) == state(tasks)
    got = lg.fold_once(tasks, lg.empty_ledger(spark), odd, price_dim(spark), AS_OF)[0]
    assert state(got)[1][:3] == ("pending", 1, "?")      # a result that says neither counts as a failure


def test_only_open_rows_are_shuffled(spark, small):
    t = fx.task_log(spark, small)
    out = tk.replay_attempts(t, fx.attempts(t), price_dim(spark), AS_OF)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    closed = plan.split("Union")[1]
    assert "Join" in closed                                # the open branch
    assert "Join" not in closed[closed.rindex("NOT"):]     # the closed branch passes through


def test_task_log_store(spark, small):
    t = fx.task_log(spark, small)
    a, prices = fx.attempts(t), price_dim(spark)
    store = TaskLog.create(spark, scratch_path(spark, "log"), t, max_rows=200)
    assert store.append(t) and store.tasks().count() == t.count()               # known ids add nothing
    v = store.fold(a.where("attempt >= 1"), prices, AS_OF, "p", 1)
    assert store.fold(a.where("attempt >= 1"), prices, AS_OF, "p", 1) == v      # delivered again
    store.fold(a.where("attempt < 1"), prices, AS_OF, "p", 2)
    assert state(store.tasks()) == state(tk.replay_attempts(t, a, prices, AS_OF))
    assert state(store.tasks(1)) == state(t)
    with pytest.raises(ValueError, match="more than once"):
        TaskLog.create(spark, scratch_path(spark, "log"), t.unionByName(t))


def test_killed_fold_is_run_again(spark, small, monkeypatch):
    from tokenloom.plans import versioned as vd
    t = fx.task_log(spark, small)
    a, prices = fx.attempts(t), price_dim(spark)
    store = TaskLog.create(spark, scratch_path(spark, "log"), t)
    with monkeypatch.context() as m:
        m.setattr(vd.VersionedStore, "_commit", lambda self, s: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            store.fold(a, prices, AS_OF, "p", 1)
    assert state(store.tasks()) == state(t) and store.ledger().count() == 0
    store.fold(a, prices, AS_OF, "p", 1)
    assert state(store.tasks()) == state(tk.replay_attempts(t, a, prices, AS_OF))


def test_append_leaves_stored_rows_where_they_are(spark, small):
    t = fx.task_log(spark, small)
    old, new = t.where("task_id % 3 > 0"), t.where("task_id % 3 = 0")
    log_ = TaskLog.create(spark, scratch_path(spark, "grow"), old, max_rows=400)
    before = log_.store.state()
    log_.append(new.unionByName(new).unionByName(old))                  # ids twice, and known ones
    after = log_.store.state()
    assert state(log_.tasks()) == state(t) and state(log_.tasks(1)) == state(old)
    for bucket, tables in before.folders.items():
        first, *further = after.folders[bucket]["tasks"].splitlines()
        assert first == tables["tasks"] and len(further) == 1
    assert log_.append(t) == after.version                              # nothing new: nothing is written
    assert sum(after.rows.values()) == t.count()
    log_.fold(fx.attempts(t), price_dim(spark), AS_OF)                  # reads and rewrites both folders
    assert log_.tasks().count() == t.count()
