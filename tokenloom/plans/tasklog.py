"""The task log, its attempt ledger and its effects as one versioned store.

The three tables are keyed by ``task_id`` and change in the same commit, so a fold
that is killed and run again, or whose batch is delivered again, has its effect
once.  Only the buckets of the batch's tasks are read and rewritten.

Completing a task has effects outside the log: saving an embedding, calling back.
The fold only notes them as due, in its own commit; whoever carries them out reads
the due rows and marks them (see ``plans.sweep``).  A task has an effect of a kind
once, however often or in whatever parts its outcomes arrive."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators.ledger import empty_ledger, fold_once
from tokenloom.operators.tasks import recover_timeouts
from tokenloom.operators.util import written
from tokenloom.operators.vectors import save_condition
from tokenloom.plans.versioned import MAX_ROWS, VersionedStore
from tokenloom.schemas import DEFAULT_TIMEOUT_SECONDS, STATUS_COMPLETE, STATUS_PROCESSING

EFFECTS_SCHEMA = "task_id bigint, kind string, attempt int, state string, detail string"
SAVE_VECTOR, CALL_BACK = "vector", "callback"
DUE, CLAIMED, DONE = "due", "claimed", "done"


def _given(c: Column) -> Column:
    return c.isNotNull() & ~c.isin("", "0")


def with_due_effects(tasks: DataFrame, ledger: DataFrame, effects: DataFrame) -> DataFrame:
    """``effects`` and a due row for each effect of a completed task not yet in it."""
    won = ledger.where(F.col("status") == STATUS_COMPLETE).select("task_id", F.array_min(F.transform(
        F.filter("entries", lambda e: e["ok"]), lambda e: e["attempt"])).alias("attempt"))
    done = tasks.where(F.col("status") == STATUS_COMPLETE)
    saves = save_condition(done).where("save").select("task_id", F.lit(SAVE_VECTOR).alias("kind"))
    calls = done.where(_given(F.col("callback_class")) & _given(F.col("callback_method"))) \
        .select("task_id", F.lit(CALL_BACK).alias("kind"))
    new = saves.unionByName(calls).join(won, "task_id") \
        .join(effects.select("task_id", "kind"), ["task_id", "kind"], "left_anti")
    return effects.unionByName(new.select("task_id", "kind", "attempt", F.lit(DUE).alias("state"),
                                          F.lit(None).cast("string").alias("detail")))


class TaskLog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store = spark, VersionedStore(spark, root)

    @classmethod
    def create(cls, spark: SparkSession, root: str, tasks: DataFrame, max_rows: int = MAX_ROWS) -> TaskLog:
        """A new log.  Task ids must be unique: repeated ones are an error."""
        tasks = written(tasks, "new-log", "zstd")
        repeated = tasks.groupBy("task_id").count().where("count > 1").limit(1).collect()
        if repeated:
            raise ValueError(f"task_id {repeated[0][0]} occurs more than once")
        VersionedStore.create(spark, root, {"tasks": tasks, "ledger": empty_ledger(spark),
                                            "effects": spark.createDataFrame([], EFFECTS_SCHEMA)},
                              ["task_id"], max_rows)
        return cls(spark, root)

    def tasks(self, version: int | None = None) -> DataFrame:
        return self.store.read("tasks", version)

    def ledger(self, version: int | None = None) -> DataFrame:
        return self.store.read("ledger", version)

    def effects(self, version: int | None = None) -> DataFrame:
        return self.store.read("effects", version)

    def append(self, tasks: DataFrame) -> int:
        """Add task rows; an id that the log already has, or that occurs twice in
        the batch, is left as it is (queueing the same run again adds nothing)."""
        tasks = written(tasks, "arriving-tasks", "zstd")
        ids = tasks.groupBy("task_id").agg(F.count("*").alias("came"))
        known = self.store.stored("tasks", ids).select("task_id")
        fresh = written(ids.join(known, "task_id", "left_anti"), "fresh-tasks")
        if fresh.isEmpty():
            return self.store.state().version
        rows = tasks
        if fresh.count() < ids.count():
            rows = rows.join(known, "task_id", "left_anti")
        if not fresh.where("came > 1").isEmpty():
            rows = rows.dropDuplicates(["task_id"])
        return self.store.append("tasks", rows, fresh)

    def fold(self, outcomes: DataFrame, prices: DataFrame, as_of: dt.datetime, source: str | None = None,
             batch: int | None = None) -> int:
        """Fold a batch of provider outcomes (see ``ledger.fold_once``) and note
        the effects of the tasks it completes."""
        def combine(now: dict[str, DataFrame]) -> dict[str, DataFrame]:
            tasks, ledger = fold_once(now["tasks"], now["ledger"], outcomes, prices, as_of)
            return {"tasks": tasks, "ledger": ledger,   # the effects follow from the rows as they are stored
                    "effects": lambda new: with_due_effects(new["tasks"], new["ledger"], now["effects"])}

        return self.store.merge(outcomes.where(F.col("task_id").isNotNull()), combine, source, batch)

    def recover(self, as_of: dt.datetime, timeout_seconds: int = DEFAULT_TIMEOUT_SECONDS,
                source: str | None = None, batch: int | None = None) -> int:
        """Queue again (or fail) the tasks that ran out of time."""
        running = self.tasks().where(F.col("status") == STATUS_PROCESSING).select("task_id")
        return self.store.merge(running, lambda now: {
            **now, "tasks": recover_timeouts(now["tasks"], as_of, timeout_seconds)}, source, batch)

    def mark(self, rows: DataFrame, state: str) -> int:
        """Set the state (and ``detail``, if ``rows`` has it) of effects (task_id, kind)."""
        detail = F.col("detail") if "detail" in rows.columns else F.lit(None).cast("string")
        news = rows.select("task_id", "kind", detail.alias("n_detail"), F.lit(state).alias("n_state"))

        def combine(now: dict[str, DataFrame]) -> dict[str, DataFrame]:
            joined = now["effects"].join(news, ["task_id", "kind"], "left")
            return {**now, "effects": joined.select(
                "task_id", "kind", "attempt", F.coalesce("n_state", "state").alias("state"),
                F.coalesce("n_detail", "detail").alias("detail"))}

        return self.store.merge(rows, combine)
