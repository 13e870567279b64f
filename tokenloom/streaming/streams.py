"""Streaming jobs: usage counters, timeout detection (stream-stream interval
join), screening, per-minute rate limits, embedding queue and vector upsert.

Each builder takes a streaming DataFrame and returns one; the ``run_*``
helpers start a query with ``trigger(availableNow=True)`` and a checkpoint
under the shared ``spark.checkpoint.dir``.  Sinks are idempotent per batch
id, so a retried micro-batch overwrites its own output.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.dates import ntz
from tokenloom.operators import entities as en
from tokenloom.operators import guard, usage
from tokenloom.operators.util import bounded_broadcast, written
from tokenloom.plans.vectorstore import create_vectors, merge_vectors, read_vectors
from tokenloom.plans.versioned import MAX_ROWS, VersionedStore
from tokenloom.schemas import USAGE_KEY, USAGE_SCHEMA, VECTOR_KEY
from tokenloom.session import scratch_path

EPOCH = dt.datetime(1970, 1, 1)


def _epoch_ntz() -> Column:
    return ntz(EPOCH)


def ntz_to_instant(c: Column) -> Column:
    """Wall-clock time read as UTC -> TIMESTAMP (watermarks need TIMESTAMP),
    independent of the session time zone."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", _epoch_ntz(), c))


def instant_to_ntz(c: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), _epoch_ntz())


# -- sources ---------------------------------------------------------------------

def write_day_files(df: DataFrame, time_col: str, path: str, gather: bool = True) -> str:
    """Split a table into one folder per day (the shape of an arriving log).

    A day's rows are gathered, so that files follow the rows of a day (one per
    advisory partition size) and not the number of writing tasks; ``gather=False``
    leaves wide rows where they are."""
    days = df.withColumn("day", F.to_date(time_col))
    if gather:
        days = days.hint("rebalance", "day")
    days.write.mode("overwrite").option("compression", "zstd").partitionBy("day").parquet(path)
    return path


def file_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


# -- running -----------------------------------------------------------------------

def run_available_now(stream: DataFrame, out_path: str, checkpoint: str, mode: str = "append") -> str:
    q = (stream.writeStream.format("parquet").outputMode(mode)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out_path))
    q.awaitTermination()
    return out_path


def run_batches(stream: DataFrame, handle, checkpoint: str, mode: str = "update") -> None:
    """``foreachBatch`` with ``handle(batch_df, batch_id)``; handlers must be idempotent."""
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
         .foreachBatch(handle).trigger(availableNow=True).start())
    q.awaitTermination()


# -- jobs ----------------------------------------------------------------------------

def usage_store(spark: SparkSession, root: str, max_rows: int = MAX_ROWS) -> VersionedStore:
    """An empty usage table for ``stream_usage``."""
    return VersionedStore.create(spark, root, {"usage": spark.createDataFrame([], USAGE_SCHEMA)}, USAGE_KEY, max_rows)


def stream_usage(priced_calls: DataFrame, store: VersionedStore, checkpoint: str, source: str = "calls") -> DataFrame:
    """Per-call counters by (consumer, platform, model, store, day), kept in ``store``.

    Every micro-batch is rolled up and added to the stored counters in one
    commit that carries the batch number, so a batch that is run again adds
    nothing.  There is no watermark and no stream state: a row that arrives
    however late is counted on its day.  ``source`` stands for one checkpoint."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        part = written(usage.call_usage(batch), "usage-batch")
        store.merge(part, lambda now: {"usage": usage.usage_merge(now["usage"], part)}, source, batch_id)

    run_batches(priced_calls, handle, checkpoint, "append")
    return store.read("usage")


def stream_timeouts(starts: DataFrame, finishes: DataFrame, timeout_seconds: int = 120,
                    delay: str = "10 minutes") -> DataFrame:
    """Left-outer interval join of start and finish events: a start with no
    finish within ``timeout_seconds`` is a timeout (emitted once both
    watermarks pass the interval)."""
    s = starts.select(F.col("task_id").alias("s_task_id"), ntz_to_instant(F.col("started_at")).alias("s_at")) \
        .withWatermark("s_at", delay)
    f = finishes.select(F.col("task_id").alias("f_task_id"), ntz_to_instant(F.col("completed_at")).alias("f_at")) \
        .withWatermark("f_at", delay)
    cond = (F.col("s_task_id") == F.col("f_task_id")) & (F.col("f_at") >= F.col("s_at")) & \
        (F.col("f_at") <= F.col("s_at") + F.expr(f"INTERVAL {int(timeout_seconds)} SECONDS"))
    j = s.join(f, cond, "leftOuter")
    return j.where(F.col("f_task_id").isNull()).select(
        F.col("s_task_id").alias("task_id"), instant_to_ntz(F.col("s_at")).alias("started_at"))


def stream_screen(texts: DataFrame, text_col: str = "text", blocklist: list[str] | None = None,
                  detect_pii: bool = True) -> DataFrame:
    """Every text with its verdict and, if wanted, the kinds of personal data in it."""
    screened = guard.validate(texts, text_col, blocklist)
    return guard.pii_flag(screened, text_col) if detect_pii else screened


def rate_store(spark: SparkSession, root: str, max_rows: int = MAX_ROWS) -> VersionedStore:
    """An empty per-minute request table for ``stream_rate_limit``."""
    empty = spark.createDataFrame([], "minute_start timestamp_ntz, requests long")
    return VersionedStore.create(spark, root, {"minutes": empty}, ["minute_start"], max_rows)


def stream_rate_limit(requests: DataFrame, time_col: str, limit: int, store: VersionedStore, checkpoint: str,
                      source: str = "requests") -> DataFrame:
    """Requests per minute with an over-limit flag, known as soon as the
    micro-batch that crosses the limit is in (added like ``stream_usage``)."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        part = written(batch.groupBy(F.date_trunc("minute", time_col).cast("timestamp_ntz").alias("minute_start"))
                       .agg(F.count("*").alias("requests")), "requests-batch")

        def add(now: dict[str, DataFrame]) -> dict[str, DataFrame]:
            return {"minutes": now["minutes"].unionByName(part).groupBy("minute_start")
                    .agg(F.sum("requests").alias("requests"))}

        store.merge(part, add, source, batch_id)

    run_batches(requests, handle, checkpoint, "append")
    over = F.lit(False) if limit <= 0 else F.col("requests") > F.lit(limit)
    return store.read("minutes").select("minute_start", "requests", over.alias("over_limit"))


def entity_store(spark: SparkSession, root: str, max_rows: int = MAX_ROWS) -> VersionedStore:
    """An empty table of what was last seen of every entity, for ``stream_embed_queue``."""
    seen = spark.createDataFrame([], "entity_type string, entity_id long, store_id int, "
                                     "changed_at timestamp_ntz, saved long, fingerprint string")
    return VersionedStore.create(spark, root, {"seen": seen}, VECTOR_KEY, max_rows)


_CONTENT = ["name", "short_description", "description", "active"]
_ORDER = ["changed_at", "saved"]


def _last_saves(changes: DataFrame) -> DataFrame:
    """The latest save per entity and store: its place in the order (saves of one time are
    ordered by a hash of their content), its text's fingerprint and how often it came.
    Texts stay where they are; the shuffled rows are narrow."""
    saves = en.change_text(changes.withColumn("saved", F.xxhash64(*_CONTENT)))
    mark = F.when(F.col("text") == "", "").otherwise(F.sha2("text", 256))
    marked = saves.select(*VECTOR_KEY, *_ORDER, mark.alias("fingerprint"))
    per_save = marked.groupBy(*VECTOR_KEY, *_ORDER).agg(F.max("fingerprint").alias("fingerprint"),
                                                        F.count("*").alias("came"))
    last = F.max_by(F.struct(*_ORDER, "fingerprint", "came"), F.struct(*_ORDER))
    return per_save.groupBy(*VECTOR_KEY).agg(last.alias("s")).select(*VECTOR_KEY, "s.*")


def _texts_of(changes: DataFrame, last: DataFrame) -> DataFrame:
    """The texts of the saves listed in ``last`` (null-safe), once each."""
    named = last.select(*[F.col(c).alias(f"_{c}") for c in [*VECTOR_KEY, *_ORDER]], "came")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*VECTOR_KEY, *_ORDER]])
    rows = changes.withColumn("saved", F.xxhash64(*_CONTENT)).join(bounded_broadcast(named), same)
    if not last.where("came > 1").isEmpty():    # delivered more than once within the batch
        rows = rows.where("came = 1").unionByName(rows.where("came > 1").dropDuplicates([*VECTOR_KEY, *_ORDER]))
    return en.change_text(rows).select(*VECTOR_KEY, *_ORDER, "text")


def stream_embed_queue(changes: DataFrame, store: VersionedStore, queue: str, checkpoint: str,
                       created_at: dt.datetime | None = None, source: str = "changes") -> DataFrame:
    """Entity saves (``entities.entity_changes``) -> embedding tasks.

    A save queues a task if its text is not empty and differs from what was last
    seen of the entity in its store.  So a repeated delivery, a save that changes
    nothing and one older than the last seen queue nothing; an entity that was
    switched off is queued again when it is back.  Within a micro-batch the last
    save counts.  Tasks of batch n lie in ``queue/batch=n``; they count once the
    batch is committed with the entities' new state, so a batch that is run again
    after a failure neither loses nor doubles a task.  Returns the committed tasks."""
    spark = changes.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        if store.state().applied.get(source, -1) >= batch_id:
            return
        last = written(_last_saves(batch), "last-saves")
        before = store.lookup("seen", last).select(
            *VECTOR_KEY, F.struct("changed_at", "saved").alias("old"), F.col("fingerprint").alias("old_mark"))
        newer = F.col("old").isNull() | (F.struct("changed_at", "saved") > F.col("old"))
        fresh = written(last.join(before, VECTOR_KEY, "left").where(
            newer & (F.col("fingerprint") != "") & ~F.col("fingerprint").eqNullSafe(F.col("old_mark")))
            .select(*last.columns), "fresh-saves")
        number = F.xxhash64(*VECTOR_KEY, "changed_at", "saved")
        en.embed_tasks(_texts_of(batch, fresh), F.col("store_id"), created_at, number) \
            .write.mode("overwrite").option("compression", "zstd").parquet(f"{queue}/batch={batch_id}")
        state = last.drop("came")

        def keep(now: dict[str, DataFrame]) -> dict[str, DataFrame]:
            row, order = F.struct("changed_at", "saved", "fingerprint"), F.struct("changed_at", "saved")
            return {"seen": now["seen"].unionByName(state).groupBy(*VECTOR_KEY)
                    .agg(F.max_by(row, order).alias("s")).select(*VECTOR_KEY, "s.*")}

        store.merge(state, keep, source, batch_id)

    run_batches(changes, handle, checkpoint, "append")
    none = spark.createDataFrame([], "entity_type string, entity_id long, store_id int, text string")
    schema = en.embed_tasks(none, F.col("store_id"), created_at, F.lit(0)).schema
    done = store.state().applied.get(source, -1)
    if done < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{queue}/batch={n}" for n in range(done + 1)])


def stream_vector_upsert(spark: SparkSession, base: DataFrame, updates: DataFrame, label: str = "vectors",
                         max_rows: int = MAX_ROWS) -> DataFrame:
    """Merge a stream of vector versions into a versioned vector table; each
    micro-batch rewrites only the buckets it touches and is applied once, also
    when it is run again after a failure."""
    store = create_vectors(spark, scratch_path(spark, f"{label}-table"), base, max_rows)

    def handle(batch: DataFrame, batch_id: int) -> None:
        merge_vectors(store, batch, label, batch_id)

    run_batches(updates, handle, scratch_path(spark, f"{label}-ckpt"), mode="append")
    return read_vectors(store)
