"""Replay-safe fold of provider outcomes into the task log.

Deliveries are at least once: a batch may come twice, in parts, late or out of
order.  Beside the log stands a ledger with one row per task that has had an
outcome: the row's values before the first one (``base``), the attempts that
count (``entries``: the earliest failures, up to one more than the retry budget,
and the earliest success - bounded whatever arrives) and the state they led to.
Folding merges new attempts into the entries and replays them over ``base``, so
the result depends on the set of attempts alone: folding a batch twice, or in any
split and order, equals folding it once.

Only open rows and tasks named by the batch are shuffled.  Closed rows pass
through; those that a late attempt changes are patched through a join with the
(size-checked) list of patches.

A row whose retries or status changed outside the fold (a timeout, a reset)
starts a new epoch from its present values; attempts up to the highest one seen
before (``floor``) are dropped from then on.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.functions.dates import ntz
from tokenloom.operators.usage import estimate_cost
from tokenloom.operators.util import bounded_broadcast, written
from tokenloom.schemas import STATUS_COMPLETE, STATUS_FAILED, STATUS_PENDING, STATUS_PROCESSING

OPEN = (STATUS_PENDING, STATUS_PROCESSING)
PAYLOAD = ["response", "input_tokens", "output_tokens", "platform", "model", "error"]
# What a fold may change in a task row, and so what ``base`` remembers.
RESULT = ["error_message", "completed_at", "response", "input_tokens", "output_tokens", "platform", "model",
          "estimated_cost"]
ENTRY = ("struct<attempt:int,ok:boolean,response:string,input_tokens:bigint,output_tokens:bigint,platform:string,"
         "model:string,error:string>")
BASE = ("struct<error_message:string,completed_at:timestamp_ntz,response:string,input_tokens:bigint,"
        "output_tokens:bigint,platform:string,model:string,estimated_cost:decimal(10,6)>")
LEDGER_SCHEMA = (f"task_id bigint, base_retries int, max_retries int, base {BASE}, floor int, status string, "
                 f"retries int, entries array<{ENTRY}>")


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER_SCHEMA)


def first_deliveries(outcomes: DataFrame) -> DataFrame:
    """One row per (task_id, attempt): a success if there is one, and of several
    alike always the same (the greatest) one."""
    one = F.struct(F.coalesce("ok", F.lit(False)).alias("ok"), *PAYLOAD)
    return outcomes.groupBy("task_id", F.col("attempt").cast("int").alias("attempt")) \
        .agg(F.max(one).alias("o")).select("task_id", "attempt", "o.*")


def _heads(tasks: DataFrame, ledger: DataFrame | None, news: DataFrame) -> DataFrame:
    """One row per task that the batch names and that may change: its base
    values, retry budget and the entries known so far."""
    ids = news.select("task_id").distinct()
    opened = tasks.where(F.col("status").isin(*OPEN)).select(
        "task_id", F.col("retries").alias("row_retries"), F.col("max_retries").alias("row_max"),
        F.struct(*RESULT).cast(BASE).alias("row_base"), F.lit(True).alias("is_open"))
    if ledger is None:
        return ids.join(opened, "task_id").select(
            "task_id", F.col("row_retries").alias("r"), F.col("row_max").alias("m"), F.col("row_base").alias("base"),
            F.lit(None).cast("int").alias("floor"), F.array().cast(f"array<{ENTRY}>").alias("old"),
            F.lit(None).cast("string").alias("old_status"), "is_open", F.lit(True).alias("fresh"))
    known = ledger.withColumnsRenamed({"max_retries": "l_max", "status": "l_status", "retries": "l_retries",
                                       "base": "l_base", "floor": "l_floor"})
    h = ids.join(known, "task_id", "left").join(opened, "task_id", "left")
    closed_by_fold = F.col("l_status").isin(STATUS_COMPLETE, STATUS_FAILED)
    is_open = F.coalesce("is_open", F.lit(False))
    fresh = is_open & (F.col("l_status").isNull() | closed_by_fold | (F.col("row_retries") != F.col("l_retries")))
    seen = F.greatest(F.col("l_floor"), F.array_max(F.transform("entries", lambda e: e["attempt"])))
    return h.where(is_open | closed_by_fold).select(
        "task_id", F.when(fresh, F.col("row_retries")).otherwise(F.col("base_retries")).alias("r"),
        F.coalesce("row_max", "l_max").alias("m"),
        F.when(fresh, F.col("row_base")).otherwise(F.col("l_base")).alias("base"),
        F.when(fresh, seen).otherwise(F.col("l_floor")).alias("floor"),
        F.when(fresh, F.array().cast(f"array<{ENTRY}>")).otherwise(F.col("entries")).alias("old"),
        F.col("l_status").alias("old_status"), is_open.alias("is_open"), fresh.alias("fresh"))


def _replayed(heads: DataFrame, news: DataFrame) -> DataFrame:
    """Heads with their merged entries and what these lead to."""
    one = F.struct("attempt", "ok", *PAYLOAD).cast(ENTRY)
    budget = (F.greatest(F.col("m") - F.col("r"), F.lit(0)) + 1).alias("needed")
    stored = heads.select("task_id", budget, F.inline("old"))
    stored = stored.select("task_id", "needed", "attempt", F.struct(F.lit(0).alias("late"), one.alias("e")).alias("e"))
    fresh = news.join(heads.select("task_id", budget, "floor"), "task_id") \
        .where(F.col("floor").isNull() | (F.col("attempt") > F.col("floor"))) \
        .select("task_id", "needed", "attempt", F.struct(F.lit(1).alias("late"), one.alias("e")).alias("e"))
    e = stored.unionByName(fresh).groupBy("task_id", "needed", "attempt").agg(
        F.min_by("e.e", "e.late").alias("e")).select("task_id", "needed", "attempt", "e", "e.ok", "e.error")
    per_task = Window.partitionBy("task_id")
    e = e.withColumn("first_ok", F.min(F.when(F.col("ok"), F.col("attempt"))).over(per_task)) \
        .withColumn("fail_no", F.when(~F.col("ok"), F.row_number().over(per_task.orderBy("ok", "attempt"))))
    counts = (F.col("fail_no") <= F.col("needed")) & \
        (F.col("first_ok").isNull() | (F.col("attempt") < F.col("first_ok")))
    keep = (F.col("fail_no") <= F.col("needed")) | (F.col("attempt") == F.col("first_ok"))
    agg = e.groupBy("task_id").agg(
        F.array_sort(F.collect_list(F.when(keep, F.col("e")))).alias("entries"),
        F.count(F.when(counts, 1)).cast("int").alias("f"),
        F.min_by("e", F.when(F.col("ok"), F.col("attempt"))).alias("win"),
        F.max_by("error", F.when(counts, F.col("fail_no"))).alias("last_error"))
    return heads.join(agg, "task_id").where(F.col("fresh") | (F.col("entries") != F.col("old")))


def _patches(state: DataFrame, prices: DataFrame, as_of: dt.datetime) -> DataFrame:
    """New values of every task that changes (``n_`` columns) and its ledger row."""
    r, m, f = F.col("r"), F.col("m"), F.col("f")
    success = F.col("win").isNotNull() & ((f == 0) | (r + f <= m))
    failed = ~success & (f > 0) & (r + f > m)

    def pick(won: Column, name: str) -> Column:
        return F.when(success, won).otherwise(F.col("base")[name]).alias(f"n_{name}")

    out = state.select(
        "task_id", "old_status", "is_open", "r", "m", "base", "floor", "entries",
        F.when(success, STATUS_COMPLETE).when(failed, STATUS_FAILED).otherwise(STATUS_PENDING).alias("n_status"),
        F.least(r + f, F.greatest(r, m)).cast("int").alias("n_retries"),
        F.when(f > 0, F.col("last_error")).otherwise(F.col("base.error_message")).alias("n_error_message"),
        F.when(success | failed, ntz(as_of)).otherwise(F.col("base.completed_at")).alias("n_completed_at"),
        pick(F.col("win.response"), "response"),
        pick(F.coalesce("win.input_tokens", F.lit(0)).cast("bigint"), "input_tokens"),
        pick(F.coalesce("win.output_tokens", F.lit(0)).cast("bigint"), "output_tokens"),
        pick(F.col("win.platform"), "platform"), pick(F.col("win.model"), "model"), success.alias("won"))
    priced = estimate_cost(out.withColumnsRenamed({"n_platform": "platform", "n_model": "model"}), prices,
                           "n_input_tokens", "n_output_tokens", "cost")
    cost = F.when(F.col("won"), F.col("cost")).otherwise(F.col("base.estimated_cost")).cast("decimal(10,6)")
    return priced.withColumnsRenamed({"platform": "n_platform", "model": "n_model"}) \
        .withColumn("n_estimated_cost", cost).drop("cost", "won")


def _patched(tasks: DataFrame, patches: DataFrame) -> DataFrame:
    """Task rows with their patch's values, where there is one."""
    values = patches.select(F.col("task_id").alias("p_id"), F.col("old_status").alias("p_old"),
                            *[c for c in patches.columns if c.startswith("n_")])
    hit = F.col("p_id").isNotNull()
    joined = tasks.join(values, F.col("task_id") == F.col("p_id"), "left")
    stays = F.col("status") == F.col("n_status")

    def new(name: str) -> Column:
        if name not in ("status", "retries", *RESULT):
            return F.col(name)
        value = F.col(f"n_{name}")
        if name == "completed_at":   # a closed row that stays as it was closed keeps its time
            value = F.when(stays & F.col("status").isin(STATUS_COMPLETE, STATUS_FAILED), F.col(name)).otherwise(value)
        return F.when(hit, value).otherwise(F.col(name)).alias(name)

    return joined.select(*[new(c) for c in tasks.columns])


def fold_once(tasks: DataFrame, ledger: DataFrame | None, outcomes: DataFrame, prices: DataFrame,
              as_of: dt.datetime) -> tuple[DataFrame, DataFrame | None]:
    """(new task log, new ledger).  Without a ledger the fold trusts that no
    outcome of the batch was folded before, and returns none."""
    news = first_deliveries(outcomes)
    patches = _patches(_replayed(_heads(tasks, ledger, news), news), prices, as_of)
    is_open = F.col("status").isin(*OPEN)
    open_rows, closed_rows = tasks.where(is_open), tasks.where(~F.coalesce(is_open, F.lit(False)))
    if ledger is None:
        return _patched(open_rows, patches).unionByName(closed_rows), None
    patches = written(patches, "fold-patches")
    late = patches.where(~F.col("is_open"))
    # A closed row takes a patch only if it is still as the ledger closed it.
    late_rows = bounded_broadcast(late.withColumnsRenamed({"task_id": "_id", "old_status": "_was"})
                                  .select("_id", "_was"))
    settled = closed_rows.join(late_rows, (F.col("task_id") == F.col("_id")) & (F.col("status") == F.col("_was")),
                               "left")
    touched = _patched(settled.where(F.col("_id").isNotNull()).select(*tasks.columns), late)
    untouched = settled.where(F.col("_id").isNull()).select(*tasks.columns)
    new_tasks = _patched(open_rows, patches.where("is_open")).unionByName(touched).unionByName(untouched)
    rows = patches.select("task_id", F.col("r").alias("base_retries"), F.col("m").alias("max_retries"), "base",
                          "floor", F.col("n_status").alias("status"), F.col("n_retries").alias("retries"), "entries")
    new_ledger = ledger.join(patches.select("task_id"), "task_id", "left_anti").unionByName(rows)
    return new_tasks, new_ledger.select(*ledger.columns)
