"""Cost and usage analytics over the task log and the synchronous call log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.dates import ntz
from tokenloom.functions.cost import cost_expr
from tokenloom.operators.util import bounded_broadcast
from tokenloom.schemas import USAGE_KEY

PRICE_ROWS_BOUND = 100_000


def _day_bounds(day: dt.date) -> tuple[Column, Column]:
    start = dt.datetime.combine(day, dt.time())
    return ntz(start), ntz(start + dt.timedelta(days=1))


def estimate_cost(df: DataFrame, prices: DataFrame, in_col: str = "input_tokens",
                  out_col: str = "output_tokens", out: str = "estimated_cost") -> DataFrame:
    """Left join to the price list on (platform, model); no price -> 0.

    The price list is a dimension: it is broadcast once its row count is
    proven small, else joined by shuffle.
    """
    dim = bounded_broadcast(prices.select("platform", "model", "price_in", "price_out"),
                            PRICE_ROWS_BOUND)
    cols = [c for c in df.columns if c != out]
    joined = df.select(*cols).join(dim, ["platform", "model"], "left")
    priced = joined.withColumn(out, cost_expr(F.col(in_col), F.col(out_col),
                                              F.col("price_in"), F.col("price_out")))
    return priced.select(*cols, out)


def unpriced_models(usage_events: DataFrame, prices: DataFrame) -> DataFrame:
    """(platform, model) pairs in use that the price list does not know."""
    used = (usage_events.where(F.col("platform").isNotNull())
            .groupBy("platform", "model")
            .agg(F.count("*").alias("request_count"),
                 F.sum("input_tokens").alias("input_tokens"),
                 F.sum("output_tokens").alias("output_tokens")))
    dim = bounded_broadcast(prices.select("platform", "model"), PRICE_ROWS_BOUND)
    return used.join(dim, ["platform", "model"], "left_anti")


def eligible_calls(tasks: DataFrame, day: dt.date) -> DataFrame:
    """Completed tasks of one day with a platform (half-open range on completed_at)."""
    lo, hi = _day_bounds(day)
    return tasks.where((F.col("status") == "complete") & F.col("platform").isNotNull()
                       & (F.col("completed_at") >= lo) & (F.col("completed_at") < hi))


def _rollup(events: DataFrame, time_col: str) -> DataFrame:
    return (events.groupBy("consumer", "platform", "model", "store_id",
                           F.to_date(time_col).alias("period_date"))
            .agg(F.count("*").alias("request_count"),
                 F.sum("input_tokens").alias("input_tokens"),
                 F.sum("output_tokens").alias("output_tokens"),
                 F.sum("estimated_cost").alias("estimated_cost")))


def daily_usage(priced_tasks: DataFrame, day: dt.date | None = None) -> DataFrame:
    """Per (consumer, platform, model, store, completion day): count and sums.

    ``day=None`` recomputes every day present; a day gives the nightly
    rollup of that day only.
    """
    done = priced_tasks.where((F.col("status") == "complete") & F.col("platform").isNotNull()
                              & F.col("completed_at").isNotNull())
    if day is not None:
        done = eligible_calls(done, day)
    return _rollup(done, "completed_at")


def call_usage(priced_calls: DataFrame) -> DataFrame:
    """The same counters from the synchronous call log, keyed by call date."""
    return _rollup(priced_calls.where(F.col("platform").isNotNull()), "called_at")


def usage_events(priced_tasks: DataFrame, priced_calls: DataFrame) -> DataFrame:
    """Both writers as one event stream: tasks at completion, calls at call time."""
    cols = ["consumer", "platform", "model", "store_id", "input_tokens", "output_tokens",
            "estimated_cost"]
    tasks = priced_tasks.where(F.col("status") == "complete").select(
        F.lit("task").alias("source"), F.col("task_id").cast("string").alias("event_id"),
        F.col("completed_at").alias("event_time"), *cols)
    calls = priced_calls.select(F.lit("call").alias("source"), F.col("call_id").alias("event_id"),
                                F.col("called_at").alias("event_time"), *cols)
    return tasks.unionByName(calls).where(F.col("event_time").isNotNull())


def usage_all(priced_tasks: DataFrame, priced_calls: DataFrame) -> DataFrame:
    events = usage_events(priced_tasks, priced_calls).where(F.col("platform").isNotNull())
    return _rollup(events, "event_time")


def usage_merge(existing: DataFrame, increment: DataFrame) -> DataFrame:
    """Additive keyed upsert: counters of equal keys are added."""
    cols = ["request_count", "input_tokens", "output_tokens", "estimated_cost"]
    both = existing.select(*USAGE_KEY, *cols).unionByName(increment.select(*USAGE_KEY, *cols))
    return both.groupBy(*USAGE_KEY).agg(*[F.sum(c).alias(c) for c in cols])


def today_tokens(usage: DataFrame, as_of: dt.datetime) -> DataFrame:
    day = F.lit(as_of.date())
    return usage.where(F.col("period_date") == day).agg(
        F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0))
        .cast("bigint").alias("total_tokens"))


def month_cost(usage: DataFrame, as_of: dt.datetime) -> DataFrame:
    first = F.lit(as_of.date().replace(day=1))
    return usage.where(F.col("period_date") >= first).agg(
        F.coalesce(F.sum("estimated_cost"), F.lit(0).cast("decimal(20,6)")).alias("month_cost"))


def usage_range(usage: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    return usage.where(F.col("period_date").between(F.lit(start), F.lit(end)))


def usage_summary(usage: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Totals by platform and model with subtotals (``rollup`` + ``grouping_id``)."""
    return (usage_range(usage, start, end)
            .rollup("platform", "model")
            .agg(F.grouping_id().alias("grouping_level"),
                 F.sum("request_count").alias("request_count"),
                 F.sum("input_tokens").alias("input_tokens"),
                 F.sum("output_tokens").alias("output_tokens"),
                 F.sum("estimated_cost").alias("estimated_cost")))


def token_reconcile(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Keys whose stored counters differ from a recount (double runs, lost updates)."""
    cols = ["request_count", "input_tokens", "output_tokens", "estimated_cost"]
    s = stored.select(*USAGE_KEY, *[F.col(c).alias("stored_" + c) for c in cols])
    r = recomputed.select(*USAGE_KEY, *[F.col(c).alias("actual_" + c) for c in cols])
    j = s.join(r, USAGE_KEY, "full_outer")
    diffs = [(F.coalesce(F.col("stored_" + c), F.lit(0)) - F.coalesce(F.col("actual_" + c), F.lit(0)))
             .alias("diff_" + c) for c in cols]
    out = j.select(*USAGE_KEY, *diffs)
    return out.where(" OR ".join(f"diff_{c} <> 0" for c in cols))


def entity_counts(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Enabled products and active non-root categories, counted in one pass."""
    flags = products.select((F.col("status") == 1).alias("p"), F.lit(None).cast("boolean").alias("c")) \
        .unionByName(categories.select(F.lit(None).cast("boolean").alias("p"),
                                       (F.col("is_active") & (F.col("level") > 1)).alias("c")))
    return flags.agg(F.count(F.when(F.col("p"), 1)).alias("enabled_products"),
                     F.count(F.when(F.col("c"), 1)).alias("active_categories"))
