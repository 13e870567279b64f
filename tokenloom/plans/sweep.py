"""The whole sweep over a stored task log, with effects that happen once.

recover timeouts -> run the pending tasks -> sanitise -> fold -> save embeddings ->
call back.  A sweep has a number; running the same number again after a failure
picks up where it stopped:

* the outcomes are written under the sweep's number before anything uses them, so
  the provider is not asked again for tasks that it has answered;
* recovery and fold carry the number, so the log takes each of them once;
* embeddings are saved by a keyed upsert in which a repeated row changes nothing,
  and their effects are marked done afterwards;
* callbacks are claimed in the log before they are made and marked with their
  result afterwards.  One whose sweep dies between the two stays "claimed" and is
  reported, not repeated.  (Spark may still run a lost task's calls again: a
  callback gets the task id and should accept the same id twice.)
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.operators import guard
from tokenloom.operators import tasks as tk
from tokenloom.operators.infer import fire, infer_batch
from tokenloom.operators.util import written
from tokenloom.operators.vectors import save_condition
from tokenloom.plans.tasklog import CALL_BACK, CLAIMED, DONE, DUE, SAVE_VECTOR, TaskLog
from tokenloom.plans.vectorstore import merge_vectors
from tokenloom.plans.versioned import VersionedStore
from tokenloom.schemas import DEFAULT_TIMEOUT_SECONDS, OUTCOME_SCHEMA


def _outcomes(log: TaskLog, number: int, run: Callable[[], DataFrame]) -> DataFrame:
    """The sweep's outcomes: written once, read on every later call."""
    spark, path = log.spark, f"{log.store.root}/outcomes/{number}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        run().write.mode("overwrite").parquet(path)
    return spark.read.schema(OUTCOME_SCHEMA).parquet(path)


def sanitised(outcomes: DataFrame, tasks: DataFrame, is_html: bool = False) -> DataFrame:
    """Answers of completion tasks through the output sanitiser (others have no
    text to clean); ``is_html`` as the consumer asks for it."""
    kinds = tk.normalize_task_type(tasks).select("task_id", (F.col("task_type") == "completion").alias("is_text"))
    clean = guard.sanitize(outcomes.withColumn("clean", F.col("response")), "clean", is_html=is_html)
    return clean.join(kinds, "task_id").withColumn(
        "response", F.when(F.col("is_text"), F.col("clean")).otherwise(F.col("response"))).select(*outcomes.columns)


def run_pending(log: TaskLog, provider_factory, batch_size: int | None = None, target_dims: int = 0,
                is_html: bool = False) -> DataFrame:
    """Outcomes of all pending tasks (or the next ``batch_size``), unknown types failed."""
    pending = tk.normalize_task_type(log.tasks().where(F.col("status") == "pending"))
    chosen = tk.next_batch(pending, batch_size) if batch_size else pending
    return sanitised(infer_batch(chosen, provider_factory, target_dims), chosen, is_html)


def save_embeddings(log: TaskLog, vectors: VersionedStore) -> None:
    """Carry out the due vector effects: one keyed upsert, then marked done."""
    due = written(log.effects().where((F.col("kind") == SAVE_VECTOR) & (F.col("state") == DUE)), "due-vectors")
    tasks = log.store.lookup("tasks", due)
    keys = save_condition(tasks).where("save").select("task_id", "entity_type", F.col("entity_id").cast("bigint"))
    vector = F.coalesce(F.from_json("response", "array<float>"), F.array().cast("array<float>"))
    rows = tasks.join(keys, "task_id").select(
        "entity_type", "entity_id", "store_id", "platform", "model", F.size(vector).cast("bigint").alias("dimensions"),
        vector.alias("vector"), F.col("completed_at").alias("created_at"), F.col("completed_at").alias("updated_at"),
        F.col("task_id").alias("seq"))
    merge_vectors(vectors, rows)
    log.mark(due, DONE)


def call_back(log: TaskLog, registry: dict[str, dict[str, Callable]]) -> None:
    """Carry out the due callbacks: claimed, made, marked with what came of them."""
    due = written(log.effects().where((F.col("kind") == CALL_BACK) & (F.col("state") == DUE))
                  .select("task_id", "kind"), "due-callbacks")
    log.mark(due, CLAIMED)
    rows = log.store.lookup("tasks", due).select("task_id", "callback_class", "callback_method", "response")
    results = written(fire(rows, registry), "callback-results")
    log.mark(results.select("task_id", F.lit(CALL_BACK).alias("kind"), F.col("callback_status").alias("detail")), DONE)


def sweep(log: TaskLog, vectors: VersionedStore, provider_factory, registry: dict[str, dict[str, Callable]],
          prices: DataFrame, as_of: dt.datetime, number: int, batch_size: int | None = None,
          timeout_seconds: int = DEFAULT_TIMEOUT_SECONDS, target_dims: int = 0, is_html: bool = False) -> None:
    """One sweep (``number`` grows from sweep to sweep)."""
    log.recover(as_of, timeout_seconds, "recover", number)
    outcomes = _outcomes(log, number, lambda: run_pending(log, provider_factory, batch_size, target_dims, is_html))
    log.fold(outcomes, prices, as_of, "sweep", number)
    save_embeddings(log, vectors)
    call_back(log, registry)
