"""Budgets and limits: daily token limit, monthly cost cap, rate and size limits.

A limit of 0 means unlimited.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.operators.util import bounded_broadcast, running_total
from tokenloom.schemas import DEFAULT_MAX_TOKENS_PER_REQUEST, DEFAULT_RATE_LIMIT_PER_MINUTE


def budget_daily_tokens(usage: DataFrame, limit: int) -> DataFrame:
    day = usage.groupBy("period_date").agg(
        F.sum(F.col("input_tokens") + F.col("output_tokens")).cast("bigint").alias("total_tokens"))
    over = F.lit(False) if limit <= 0 else F.col("total_tokens") > F.lit(limit)
    return day.withColumn("over_limit", over)


def budget_month_running(usage: DataFrame, cap: float) -> DataFrame:
    """Month-to-date cost per day and whether the cap is crossed.

    Two levels: the usage table is first reduced to one row per day (tiny),
    and only that table is windowed per month.
    """
    daily = usage.groupBy("period_date").agg(F.sum("estimated_cost").alias("day_cost"))
    w = (Window.partitionBy(F.trunc("period_date", "MM")).orderBy("period_date")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    mtd = daily.withColumn("month_to_date", F.sum("day_cost").over(w))
    crossed = F.lit(False) if cap <= 0 else F.col("month_to_date") > F.lit(cap)
    return mtd.withColumn("over_cap", crossed)


def _no_crossings(events: DataFrame) -> DataFrame:
    return events.select(F.lit(None).cast("date").alias("month"), "source", "event_id", "event_time",
                         F.lit(None).cast("decimal(38,6)").alias("running_cost")).limit(0)


def cap_crossing_calls(events: DataFrame, cap: float, slices: int | None = None,
                       rows_per_slice: int | None = None) -> DataFrame:
    """Per month, the first usage event whose running month cost exceeds ``cap``.

    ``events``: (source, event_id, event_time, estimated_cost, ...), costs >= 0.
    Two levels: a tiny per-day table finds the day on which each month's
    running cost passes the cap and the budget left at its start; only that
    day's events get an exact, distributed running sum (``running_total``,
    range-partitioned so even a day holding a third of all rows is split).
    """
    if cap <= 0:
        return _no_crossings(events)
    ev = events.select("source", "event_id", "event_time", "estimated_cost",
                       F.to_date("event_time").alias("day")) \
        .withColumn("month", F.trunc("day", "MM"))
    daily = ev.groupBy("month", "day").agg(F.sum("estimated_cost").alias("day_cost"))
    before_w = Window.partitionBy("month").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    daily = daily.withColumn("cost_before", F.coalesce(F.sum("day_cost").over(before_w), F.lit(0)))
    crossing = daily.where((F.col("cost_before") <= F.lit(cap))
                           & (F.col("cost_before") + F.col("day_cost") > F.lit(cap))) \
        .select("month", "day", "cost_before").collect()
    # At most one crossing day per month (the running cost is monotone): a
    # result bounded by the number of months, used as a literal filter that
    # runs before the range shuffle.
    if not crossing:
        return _no_crossings(events)
    days = [r.day for r in crossing]
    offsets = F.create_map(*[x for r in crossing for x in (F.lit(r.day), F.lit(r.cost_before))])
    day_events = ev.where(F.col("day").isin(days)).withColumn("cost_before", offsets[F.col("day")])
    run = running_total(day_events, "estimated_cost", ["event_time", "source", "event_id"], ["month"],
                        out="cost_in_day", slices=slices, rows_per_slice=rows_per_slice)
    run = run.withColumn("running_cost", F.col("cost_before") + F.col("cost_in_day"))
    over = run.where(F.col("running_cost") > F.lit(cap))
    first = over.groupBy("month").agg(
        F.min_by(F.struct("event_time", "source", "event_id", "running_cost"),
                 F.struct("event_time", "source", "event_id")).alias("x"))
    return first.select("month", "x.source", "x.event_id", "x.event_time", "x.running_cost")


def cancel_over_cap(tasks: DataFrame, crossings: DataFrame) -> DataFrame:
    """Pending tasks created at or after their month's cap crossing become cancelled."""
    cross = bounded_broadcast(crossings.select("month", F.col("event_time").alias("crossed_at")), 10_000)
    t = tasks.withColumn("month", F.trunc(F.to_date("created_at"), "MM"))
    j = t.join(cross, "month", "left")
    hit = (F.col("status") == "pending") & F.col("crossed_at").isNotNull() & \
        (F.col("created_at") >= F.col("crossed_at"))
    return j.withColumn("status", F.when(hit, F.lit("cancelled")).otherwise(F.col("status"))) \
        .drop("month", "crossed_at")


def rate_limit(requests: DataFrame, time_col: str, limit: int = DEFAULT_RATE_LIMIT_PER_MINUTE,
               by: list[str] | tuple = ()) -> DataFrame:
    """Requests per tumbling minute (optionally per ``by`` keys) with an over-limit flag."""
    per_min = requests.groupBy(F.window(time_col, "1 minute").start.alias("minute_start"), *by) \
        .agg(F.count("*").alias("requests"))
    over = F.lit(False) if limit <= 0 else F.col("requests") > F.lit(limit)
    return per_min.withColumn("over_limit", over)


def oversized_requests(requests: DataFrame, max_tokens: int = DEFAULT_MAX_TOKENS_PER_REQUEST) -> DataFrame:
    if max_tokens <= 0:
        return requests.limit(0)
    return requests.where(F.col("output_tokens") > F.lit(max_tokens))
