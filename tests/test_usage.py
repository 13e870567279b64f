import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tokenloom.catalog import priced_tasks
from tokenloom.operators import usage
from tokenloom.sources.dims import price_dim

TASK_COLS = "task_id long, consumer string, platform string, model string, store_id int, status string, " \
            "input_tokens long, output_tokens long, completed_at timestamp_ntz"


def _tasks(spark, rows):
    return spark.createDataFrame(rows, TASK_COLS)


def test_cost_rounds_once_per_task(spark):
    rows = [(1, "c", "openai", "gpt-4o-mini", 0, "complete", 1, 0, dt.datetime(2024, 1, 2, 1)),
            (2, "c", "openai", "gpt-4o", 0, "complete", 1000, 1000, dt.datetime(2024, 1, 2, 2)),
            (3, "c", "mistral", "mistral-large-latest", 0, "complete", 99, 99, dt.datetime(2024, 1, 2, 3)),
            (4, "c", None, None, 0, "complete", 5, 5, dt.datetime(2024, 1, 2, 4))]
    got = {r.task_id: r.estimated_cost for r in
           usage.estimate_cost(_tasks(spark, rows), price_dim(spark)).collect()}
    assert got[1] == Decimal("0.000000")          # 0.00000015 rounds to 0
    assert got[2] == Decimal("0.012500")
    assert got[3] == Decimal("0.000000")          # unpriced model -> 0
    assert got[4] == Decimal("0.000000")


def test_daily_usage_skips_platformless_and_other_days(spark):
    rows = [(1, "c", "openai", "gpt-4o", 1, "complete", 10, 20, dt.datetime(2024, 1, 30, 23, 59, 59, 999999)),
            (2, "c", "openai", "gpt-4o", 1, "complete", 1, 2, dt.datetime(2024, 1, 31, 0, 0, 0)),
            (3, "c", None, None, 1, "complete", 1, 2, dt.datetime(2024, 1, 30, 12)),
            (4, "c", "openai", "gpt-4o", 1, "failed", 1, 2, dt.datetime(2024, 1, 30, 12))]
    priced = usage.estimate_cost(_tasks(spark, rows), price_dim(spark))
    day = usage.daily_usage(priced, dt.date(2024, 1, 30)).collect()
    assert len(day) == 1 and day[0].request_count == 1 and day[0].input_tokens == 10
    assert day[0].period_date == dt.date(2024, 1, 30)


def test_rollup_invariant_under_repartitioning_and_split_merges(spark, small):
    t = priced_tasks(spark, small)
    whole = usage.daily_usage(t)
    again = usage.daily_usage(t.repartition(7, "task_id"))
    assert sorted(whole.collect()) == sorted(again.collect())
    a = usage.daily_usage(t.where(F.col("task_id") % 2 == 0))
    b = usage.daily_usage(t.where(F.col("task_id") % 2 == 1))
    merged = usage.usage_merge(a, b).select(whole.columns)
    assert sorted(merged.collect()) == sorted(whole.collect())


def test_today_and_month_on_empty_usage_are_zero(spark):
    empty = spark.createDataFrame([], "consumer string, platform string, model string, store_id int, "
                                      "period_date date, request_count long, input_tokens long, "
                                      "output_tokens long, estimated_cost decimal(20,6)")
    as_of = dt.datetime(2024, 1, 31, 0, 5)
    assert usage.today_tokens(empty, as_of).collect()[0].total_tokens == 0
    assert usage.month_cost(empty, as_of).collect()[0].month_cost == 0


def test_usage_table_rewrites_only_recomputed_days(spark, small):
    from tokenloom.catalog import usage_table
    from tokenloom.plans import sinks
    from tokenloom.session import scratch_path
    path = scratch_path(spark, "usage-sink")
    full = usage_table(spark, small)
    sinks.write_usage(full, path)
    day = dt.date(2024, 1, 15)
    redo = full.where(F.col("period_date") == F.lit(day)).withColumn("request_count", F.lit(0).cast("bigint"))
    sinks.write_usage(redo, path)
    back = sinks.read_usage(spark, path)
    assert back.count() == full.count()
    assert back.where(F.col("period_date") == F.lit(day)).agg(F.sum("request_count")).collect()[0][0] == 0
    other = back.where(F.col("period_date") != F.lit(day)).agg(F.sum("request_count")).collect()[0][0]
    assert other == full.where(F.col("period_date") != F.lit(day)).agg(F.sum("request_count")).collect()[0][0]
    plan = sinks.read_usage(spark, path, date_from=day)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period_date" in plan
