"""Property tests (hypothesis): merge algebra of usage counters, retention safety."""

import datetime as dt
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tokenloom.operators import tasks as tk
from tokenloom.operators import usage
from tokenloom.schemas import USAGE_SCHEMA

KEYS = st.tuples(st.sampled_from(["_direct", "cms_content"]), st.sampled_from(["openai", "google"]),
                 st.sampled_from(["m1", "m2"]), st.integers(0, 2),
                 st.dates(dt.date(2024, 1, 1), dt.date(2024, 1, 4)))
ROW = st.tuples(KEYS, st.integers(0, 5), st.integers(0, 10_000), st.integers(0, 10_000),
                st.integers(0, 10_000_000))
ROWS = st.lists(ROW, max_size=12)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _usage(spark, rows):
    data = [(*k, n, i, o, Decimal(c).scaleb(-6)) for k, n, i, o, c in rows]
    return spark.createDataFrame(data, USAGE_SCHEMA)


def _norm(df):
    return sorted(map(tuple, df.select(*[f.name for f in USAGE_SCHEMA.fields]).collect()))


@SETTINGS
@given(a=ROWS, b=ROWS, c=ROWS)
def test_usage_merge_is_associative_and_equals_union_rollup(spark, a, b, c):
    A, B, C = (_usage(spark, x) for x in (a, b, c))
    left = usage.usage_merge(usage.usage_merge(A, B), C)
    right = usage.usage_merge(A, usage.usage_merge(B, C))
    once = usage.usage_merge(A.unionByName(B), C)
    assert _norm(left) == _norm(right) == _norm(once)


STATUSES = st.sampled_from(["pending", "processing", "complete", "failed", "cancelled"])
TASK = st.tuples(STATUSES, st.one_of(st.none(), st.integers(0, 400)))


@SETTINGS
@given(rows=st.lists(TASK, max_size=20), days=st.integers(1, 120))
def test_retention_never_drops_open_or_recent_rows(spark, rows, days):
    as_of = dt.datetime(2024, 6, 1)
    data = [(i, s, None if age is None else as_of - dt.timedelta(days=age)) for i, (s, age) in enumerate(rows)]
    df = spark.createDataFrame(data, "task_id long, status string, completed_at timestamp_ntz")
    kept = {r.task_id for r in tk.retention(df, as_of, days).collect()}
    cutoff = as_of - dt.timedelta(days=days)
    for i, s, done in data:
        droppable = s in ("complete", "failed", "cancelled") and done is not None and done < cutoff
        assert (i in kept) == (not droppable)
