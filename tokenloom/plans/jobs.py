"""End-to-end jobs composed from the operators (each a DataFrame function)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from pyspark.sql import functions as F

from tokenloom.functions.dates import ntz
from tokenloom.operators import entities as en
from tokenloom.operators import guard, tasks as tk, usage
from tokenloom.operators.infer import infer_batch
from tokenloom.operators.vectors import save_condition, upsert_vectors
from tokenloom.session import checkpoint_root
from tokenloom.schemas import DEFAULT_TIMEOUT_SECONDS


def queue_sweep(tasks: DataFrame, provider_factory, prices: DataFrame, as_of: dt.datetime,
                batch_size: int | None = None, timeout_seconds: int = DEFAULT_TIMEOUT_SECONDS,
                target_dims: int = 0) -> tuple[DataFrame, DataFrame]:
    """Recover timed-out tasks, pick the next batch, run it, fold the outcomes.

    Returns (new task log, outcomes); every pending task runs, in parallel,
    unless ``batch_size`` limits the sweep.  The outcomes are written before
    they are folded, so the provider is called once per task however often the
    two results are read.
    """
    recovered = tk.recover_timeouts(tasks, as_of, timeout_seconds)
    chosen = tk.next_batch(recovered, batch_size) if batch_size else tk.pending_tasks(recovered)
    checkpoint_root(tasks.sparkSession)
    outcomes = infer_batch(chosen, provider_factory, target_dims).checkpoint(eager=True)
    return tk.apply_outcomes(recovered, outcomes, prices, as_of), outcomes


def sync_calls(conversations: DataFrame, provider_factory, prices: DataFrame, as_of: dt.datetime,
               system_prompt: str | None = None, blocklist=None, consumer: str = "_direct",
               store_id: int = 0, detect_pii: bool = True) -> DataFrame:
    """The synchronous path for a whole batch of conversations: screen the user
    turns, send the safe conversations (one request each), flag personal data
    in the answers and price every call.  Returns one call row per
    conversation sent (aggregate it with ``usage.call_usage``)."""
    verdict = guard.conversation_screen(conversations, blocklist)
    safe = conversations.join(verdict.where("safe").select("conv_id"), "conv_id", "left_semi")
    prompts = en.normalize_messages(safe, system_prompt)
    requests = prompts.select(F.col("conv_id").alias("task_id"), F.lit("completion").alias("task_type"),
                              F.to_json("messages").alias("messages"), F.lit(0).alias("retries"))
    out = infer_batch(requests, provider_factory)
    if detect_pii:
        out = guard.pii_flag(out, "response")
    calls = out.select(
        F.col("task_id").alias("conv_id"), "ok", "response", "error", "platform", "model",
        F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"),
        F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"),
        *(["pii_types"] if detect_pii else []),
        F.lit(consumer).alias("consumer"), F.lit(store_id).alias("store_id"),
        ntz(as_of).alias("called_at"))
    return usage.estimate_cost(calls, prices)


def embed_entities(products: DataFrame, categories: DataFrame, vectors: DataFrame, provider_factory,
                   prices: DataFrame, as_of: dt.datetime, store_id: int = 0,
                   target_dims: int = 0) -> tuple[DataFrame, DataFrame]:
    """Queue-all, run every embedding task, fold the outcomes into the task
    rows and store the vectors (returns (tasks, vector table)).

    Queued tasks and provider outcomes are each checkpointed once: both the
    task fold and the vector upsert read them, and recomputing the outcomes
    would call the provider twice.
    """
    checkpoint_root(products.sparkSession)
    # The queued rows stand in for the written task table (as a sweep reads
    # it): fixed once, so text preparation is not redone by later branches.
    tasks = en.queue_all(products, categories, store_id=store_id, created_at=as_of).checkpoint(eager=True)
    outcomes = infer_batch(tasks, provider_factory, target_dims).checkpoint(eager=True)
    done = tk.apply_outcomes(tasks, outcomes, prices, as_of)
    targets = save_condition(tasks).where("save")
    fresh = outcomes.where("ok").join(targets, "task_id").select(
        "entity_type", F.col("entity_id").cast("bigint").alias("entity_id"),
        F.lit(store_id).alias("store_id"), "platform", "model",
        F.size("vector").cast("bigint").alias("dimensions"), F.col("vector").cast("array<float>").alias("vector"),
        ntz(as_of).alias("created_at"), ntz(as_of).alias("updated_at"), F.lit(0).alias("seq"))
    return done, upsert_vectors(vectors, fresh)
