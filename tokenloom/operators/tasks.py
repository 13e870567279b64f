"""Task-log operators: projections, state transitions and reports.

All transitions are whole-table functions: they take the task log (and a
batch of provider outcomes where relevant) and return the new task log,
reading only old values on the right-hand side.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.dates import ntz
from tokenloom.operators.ledger import fold_once
from tokenloom.operators.util import bounded_broadcast, exact_percentiles
from tokenloom.schemas import (DEFAULT_BATCH_SIZE, DEFAULT_CRON, DEFAULT_MAX_RETRIES,
                               DEFAULT_RETENTION_DAYS, DEFAULT_TIMEOUT_SECONDS, MESSAGES_TYPE,
                               TASK_TYPES, TERMINAL_STATUSES)
from tokenloom.sources.dims import ERROR_PREFIXES_DOC, TYPE_CAPABILITY

TIMEOUT_MESSAGE = "Task timed out"


def _ts(value: dt.datetime) -> Column:
    return ntz(value)


# -- scans and projections ---------------------------------------------------

def decode_tasks(tasks: DataFrame) -> DataFrame:
    """Decode JSON columns: bad or missing JSON becomes an empty list / map."""
    msgs = F.coalesce(F.from_json("messages", MESSAGES_TYPE), F.array().cast(MESSAGES_TYPE))
    ctx = F.coalesce(F.from_json("context", "map<string,string>"),
                     F.create_map().cast("map<string,string>"))
    return tasks.withColumn("messages_array", msgs).withColumn("context_map", ctx)


def normalize_task_type(tasks: DataFrame) -> DataFrame:
    """Null/empty type -> completion (old rows had no ``task_type`` column)."""
    if "task_type" not in tasks.columns:
        tasks = tasks.withColumn("task_type", F.lit(None).cast("string"))
    t = F.col("task_type")
    return tasks.withColumn("task_type", F.when(t.isNull() | (t == ""), F.lit("completion")).otherwise(t))


def task_predicates(tasks: DataFrame) -> DataFrame:
    s = F.col("status")
    return tasks.select("task_id", (s == "pending").alias("is_pending"),
                        (s == "complete").alias("is_complete"), (s == "failed").alias("is_failed"))


def pending_tasks(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("status") == "pending")


def pending_embed_count(tasks: DataFrame) -> DataFrame:
    return pending_tasks(tasks).where(F.col("task_type") == "embedding") \
        .agg(F.count("*").alias("pending_embeddings"))


def next_batch(tasks: DataFrame, size: int = DEFAULT_BATCH_SIZE) -> DataFrame:
    """Interactive first, then oldest; ``task_id`` breaks ties.  A top-k, not a sort."""
    order = F.when(F.col("priority") == "interactive", 0).otherwise(1)
    return pending_tasks(tasks).withColumn("priority_order", order) \
        .orderBy("priority_order", "created_at", "task_id").limit(size)


def task_grid(tasks: DataFrame, statuses=None, platform=None, created_from=None, created_to=None,
              min_cost=None, page: int | None = None, page_size: int = 20) -> DataFrame:
    """Filtered task list, newest first (optionally one page of it)."""
    cond = F.lit(True)
    if statuses:
        cond = cond & F.col("status").isin(list(statuses))
    if platform:
        cond = cond & (F.col("platform") == platform)
    if created_from:
        cond = cond & (F.col("created_at") >= _ts(created_from))
    if created_to:
        cond = cond & (F.col("created_at") < _ts(created_to))
    if min_cost is not None:
        cond = cond & (F.col("estimated_cost") >= F.lit(min_cost))
    out = tasks.where(cond).select(
        "task_id", "consumer", "action", "task_type", "status", "priority", "platform", "model",
        "input_tokens", "output_tokens", "estimated_cost", "created_at") \
        .orderBy(F.col("created_at").desc(), F.col("task_id").desc())
    if page is not None:
        out = out.offset(page * page_size).limit(page_size)
    return out


def usage_grid(usage: DataFrame, platform=None, date_from=None) -> DataFrame:
    cond = F.lit(True)
    if platform:
        cond = cond & (F.col("platform") == platform)
    if date_from:
        cond = cond & (F.col("period_date") >= F.lit(date_from))
    return usage.where(cond).orderBy(F.col("period_date").desc(), "consumer", "platform", "model",
                                     "store_id")


def _falsy(c: Column) -> Column:
    return c.isNull() | (c == "") | (c == "0")


def task_status(tasks: DataFrame, requested_ids: DataFrame) -> DataFrame:
    """Status payload for requested ids (semi join; broadcast when the id list is small)."""
    ids = bounded_broadcast(requested_ids.select("task_id").distinct(), 1_000_000)
    t = tasks.join(ids, "task_id", "left_semi")
    return t.select(
        "task_id", "status", "task_type",
        F.when(F.col("status") == "complete", F.col("response")).alias("response"),
        F.when(_falsy(F.col("error_message")), F.lit(None).cast("string"))
        .otherwise(F.col("error_message")).alias("error_message"),
        "completed_at")


def _preview(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def task_detail(tasks: DataFrame, keep: list[str] | tuple = ()) -> DataFrame:
    """Detail preview: messages cut at 500 characters, responses at 2000,
    embedding responses shown as dimension count + first 8 values."""
    d = decode_tasks(tasks)
    msgs = F.transform("messages_array", lambda m: F.struct(
        m["role"].alias("role"), _preview(F.coalesce(m["content"], F.lit("")), 500).alias("content")))
    vec = F.from_json("response", "array<double>")
    is_vec = F.col("task_type") == "embedding"
    return d.select(
        "task_id", "task_type", "status", *keep,
        msgs.alias("message_preview"),
        F.when(~is_vec, _preview(F.col("response"), 2000)).alias("response_preview"),
        F.when(is_vec, F.size(vec)).alias("vector_dimensions"),
        F.when(is_vec, F.slice(vec, 1, 8)).alias("vector_head"),
        F.format_number(F.col("estimated_cost").cast("double"), 6).alias("cost_text"))


# -- transitions -------------------------------------------------------------

def recover_timeouts(tasks: DataFrame, as_of: dt.datetime,
                     timeout_seconds: int = DEFAULT_TIMEOUT_SECONDS) -> DataFrame:
    """Processing rows started before ``as_of - timeout``: re-queue or fail.

    Every right-hand side reads the old row (standard SQL ``UPDATE``).
    """
    cutoff = _ts(as_of - dt.timedelta(seconds=timeout_seconds))
    hit = (F.col("status") == "processing") & (F.col("started_at") < cutoff)
    hit = F.coalesce(hit, F.lit(False))
    exhausted = F.col("retries") >= F.col("max_retries")
    return tasks.select(
        *[c for c in tasks.columns if c not in
          ("status", "retries", "error_message", "completed_at")],
        F.when(hit, F.when(exhausted, "failed").otherwise("pending")).otherwise(F.col("status"))
        .alias("status"),
        F.when(hit, F.col("retries") + 1).otherwise(F.col("retries")).alias("retries"),
        F.when(hit, F.lit(TIMEOUT_MESSAGE)).otherwise(F.col("error_message")).alias("error_message"),
        F.when(hit, F.when(exhausted, _ts(as_of))).otherwise(F.col("completed_at"))
        .alias("completed_at"),
    ).select(*tasks.columns)


def unknown_type_outcomes(tasks: DataFrame, attempt: int = 1) -> DataFrame:
    """Open tasks whose type is not one of the three known ones fail with a message."""
    t = normalize_task_type(tasks)
    bad = t.where(F.col("status").isin("pending", "processing") & ~F.col("task_type").isin(*TASK_TYPES))
    return bad.select("task_id", F.lit(attempt).alias("attempt"), F.lit(False).alias("ok"),
                      F.lit(None).cast("string").alias("response"),
                      F.lit(None).cast("bigint").alias("input_tokens"),
                      F.lit(None).cast("bigint").alias("output_tokens"),
                      F.lit(None).cast("string").alias("platform"),
                      F.lit(None).cast("string").alias("model"),
                      F.concat(F.lit("Unknown task type: "), F.col("task_type")).alias("error"))


def replay_attempts(tasks: DataFrame, outcomes: DataFrame, prices: DataFrame,
                    as_of: dt.datetime) -> DataFrame:
    """Fold any number of attempts per task into the task log in one pass.

    With r = retries, m = max_retries and f = failures before the first
    success (all failures if none): success counts when f = 0 or r + f <= m;
    otherwise the task fails iff f > 0 and r + f > m, else it stays pending;
    retries become least(r + f, greatest(r, m)).  Only pending/processing
    rows change, and only they are shuffled.  Duplicate (task_id, attempt) rows
    (task retries) collapse.  Folding the same batch again needs the attempt
    ledger: see ``ledger.fold_once`` and ``plans.tasklog``.
    """
    return fold_once(tasks, None, outcomes, prices, as_of)[0]


def apply_outcomes(tasks: DataFrame, outcomes: DataFrame, prices: DataFrame,
                   as_of: dt.datetime) -> DataFrame:
    """Success -> complete (cost priced, earlier error kept); failure -> retry
    (pending, retries + 1) while retries < max_retries, else failed."""
    return replay_attempts(tasks, outcomes, prices, as_of)


def retention(tasks: DataFrame, as_of: dt.datetime, days: int = DEFAULT_RETENTION_DAYS) -> DataFrame:
    """Keep everything except terminal rows completed before ``as_of - days``."""
    cutoff = _ts(as_of - dt.timedelta(days=days))
    drop = F.col("status").isin(*TERMINAL_STATUSES) & (F.col("completed_at") < cutoff)
    return tasks.where(~F.coalesce(drop, F.lit(False)))


def schema_evolve(old_tasks: DataFrame, new_tasks: DataFrame) -> DataFrame:
    """Union logs written before and after ``task_type`` existed."""
    both = old_tasks.unionByName(new_tasks, allowMissingColumns=True)
    return normalize_task_type(both)


# -- reports -----------------------------------------------------------------

def _seconds_between(a: str, b: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.col(a), F.col(b)) / F.lit(1_000_000.0)


def latency(tasks: DataFrame, exact: bool = True) -> DataFrame:
    """Wait and run time per platform/model, with p50/p95 of run time.

    ``exact`` uses distributed ranking (same numbers as ``percentile_cont``);
    otherwise a mergeable sketch (``percentile_approx``).
    """
    t = tasks.where(F.col("platform").isNotNull() & F.col("started_at").isNotNull()) \
        .withColumn("wait_s", _seconds_between("created_at", "started_at")) \
        .withColumn("run_s", _seconds_between("started_at", "completed_at"))
    base = t.groupBy("platform", "model").agg(
        F.count("*").alias("tasks"), F.avg("wait_s").alias("avg_wait_s"),
        F.avg("run_s").alias("avg_run_s"), F.avg("retries").alias("avg_retries"))
    if exact:
        pct = exact_percentiles(t, ["platform", "model"], "run_s", {"p50_run_s": 0.5, "p95_run_s": 0.95})
    else:
        pct = t.groupBy("platform", "model").agg(
            F.percentile_approx("run_s", 0.5, 10000).cast("double").alias("p50_run_s"),
            F.percentile_approx("run_s", 0.95, 10000).cast("double").alias("p95_run_s"))
    # A task without model is a group of its own: match null keys too.
    pct = pct.withColumnsRenamed({"platform": "_platform", "model": "_model"})
    same = F.col("platform").eqNullSafe(F.col("_platform")) & F.col("model").eqNullSafe(F.col("_model"))
    return base.join(pct, same, "left").drop("_platform", "_model")


def backlog(tasks: DataFrame, as_of: dt.datetime) -> DataFrame:
    return tasks.groupBy("status", "task_type", "priority").agg(
        F.count("*").alias("tasks"),
        F.min("created_at").alias("oldest_created_at"),
        F.timestamp_diff("SECOND", F.min("created_at"), _ts(as_of)).alias("oldest_age_s"))


def eta_minutes(tasks: DataFrame, per_run: int = DEFAULT_BATCH_SIZE, cron: str = DEFAULT_CRON) -> DataFrame:
    """Minutes to drain the pending queue per task type at the sweep rate."""
    every = F.regexp_extract(F.lit(cron), r"^\*/(\d+)", 1)
    interval = F.when(every == "", F.lit(2)).otherwise(every.cast("int"))
    per_minute = F.lit(float(per_run or DEFAULT_BATCH_SIZE)) / F.greatest(F.lit(1), interval)
    counts = pending_tasks(tasks).groupBy("task_type").agg(F.count("*").alias("pending"))
    return counts.withColumn("eta_minutes",
                             F.ceil(F.col("pending") / F.greatest(F.lit(0.01), per_minute)).cast("bigint"))


def capability_check(tasks: DataFrame, providers: DataFrame) -> DataFrame:
    """Tasks whose provider lacks the capability their type needs (or is unknown)."""
    need = F.create_map(*[F.lit(x) for pair in TYPE_CAPABILITY for x in pair])
    t = normalize_task_type(tasks).where(F.col("platform").isNotNull()) \
        .withColumn("capability", need[F.col("task_type")])
    prov = bounded_broadcast(providers.select(F.col("code").alias("platform"), "capabilities"), 10_000)
    j = t.join(prov, "platform", "left")
    reason = (F.when(F.col("capabilities").isNull(), F.lit("unknown provider"))
              .when(F.col("capability").isNull(), F.lit("unknown task type"))
              .when(~F.array_contains("capabilities", F.col("capability")),
                    F.concat(F.lit("provider lacks "), F.col("capability"))))
    return j.select("task_id", "platform", "task_type", reason.alias("reason")) \
        .where(F.col("reason").isNotNull())


def error_breakdown(tasks: DataFrame) -> DataFrame:
    """Failures by error class (mapped provider prefix, timeout, other) and platform."""
    msg = F.col("error_message")
    cls = F.lit("other")
    for prefix in reversed(ERROR_PREFIXES_DOC):
        cls = F.when(msg.startswith(prefix + " ("), F.lit(prefix)).otherwise(cls)
    cls = F.when(msg == TIMEOUT_MESSAGE, F.lit("timeout")).otherwise(cls)
    return tasks.where(msg.isNotNull() & (msg != "")) \
        .groupBy(cls.alias("error_class"), "platform").agg(F.count("*").alias("tasks"))


def enqueue(requests: DataFrame, consumer: Column | str, action: Column | str = "complete",
            task_type: str = "completion", priority: str = "background", store_id: int = 0,
            created_at: dt.datetime | None = None) -> DataFrame:
    """Task rows with the data model's defaults from (task_id, messages, ...) requests."""
    def lit_or(c):
        return c if isinstance(c, Column) else F.lit(c)
    cols = requests.columns
    pick = lambda name, default: F.col(name) if name in cols else default
    return requests.select(
        F.col("task_id").cast("bigint").alias("task_id"),
        lit_or(consumer).alias("consumer"), lit_or(action).alias("action"),
        F.coalesce(pick("task_type", F.lit(None).cast("string")), F.lit(task_type)).alias("task_type"),
        F.lit("pending").alias("status"),
        F.coalesce(pick("priority", F.lit(None).cast("string")), F.lit(priority)).alias("priority"),
        pick("platform", F.lit(None).cast("string")).alias("platform"),
        pick("model", F.lit(None).cast("string")).alias("model"),
        pick("system_prompt", F.lit(None).cast("string")).alias("system_prompt"),
        pick("messages", F.lit(None).cast("string")).alias("messages"),
        pick("context", F.lit(None).cast("string")).alias("context"),
        F.lit(None).cast("string").alias("response"),
        pick("callback_class", F.lit(None).cast("string")).alias("callback_class"),
        pick("callback_method", F.lit(None).cast("string")).alias("callback_method"),
        F.lit(0).cast("bigint").alias("input_tokens"), F.lit(0).cast("bigint").alias("output_tokens"),
        F.lit(0).cast("decimal(10,6)").alias("estimated_cost"),
        F.lit(None).cast("string").alias("error_message"),
        F.lit(0).alias("retries"), F.lit(DEFAULT_MAX_RETRIES).alias("max_retries"),
        F.lit(None).cast("bigint").alias("admin_user_id"),
        F.coalesce(pick("store_id", F.lit(None).cast("int")), F.lit(store_id)).cast("int").alias("store_id"),
        (_ts(created_at) if created_at else F.localtimestamp()).alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("started_at"),
        F.lit(None).cast("timestamp_ntz").alias("completed_at"))
