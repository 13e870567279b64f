"""Table schemas and enumerations of the task / usage / vector data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Task states, priorities and types as the data model names them.
STATUS_PENDING = "pending"
STATUS_PROCESSING = "processing"
STATUS_COMPLETE = "complete"
STATUS_FAILED = "failed"
STATUS_CANCELLED = "cancelled"
TERMINAL_STATUSES = (STATUS_COMPLETE, STATUS_FAILED, STATUS_CANCELLED)

PRIORITY_INTERACTIVE = "interactive"
PRIORITY_BACKGROUND = "background"

TYPE_COMPLETION = "completion"
TYPE_EMBEDDING = "embedding"
TYPE_IMAGE = "image"
TASK_TYPES = (TYPE_COMPLETION, TYPE_EMBEDDING, TYPE_IMAGE)

# Task defaults.
DEFAULT_MAX_RETRIES = 3
DEFAULT_TIMEOUT_SECONDS = 120
DEFAULT_BATCH_SIZE = 10
DEFAULT_RETENTION_DAYS = 90
DEFAULT_CRON = "*/2 * * * *"
DEFAULT_MAX_TOKENS_PER_REQUEST = 4096
DEFAULT_RATE_LIMIT_PER_MINUTE = 30

COST_TYPE = T.DecimalType(10, 6)
PRICE_TYPE = T.DecimalType(12, 8)

MESSAGE_TYPE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])
MESSAGES_TYPE = T.ArrayType(MESSAGE_TYPE)

TASK_SCHEMA = T.StructType([
    T.StructField("task_id", T.LongType(), False),
    T.StructField("consumer", T.StringType(), False),
    T.StructField("action", T.StringType(), False),
    T.StructField("task_type", T.StringType(), True),
    T.StructField("status", T.StringType(), False),
    T.StructField("priority", T.StringType(), False),
    T.StructField("platform", T.StringType(), True),
    T.StructField("model", T.StringType(), True),
    T.StructField("system_prompt", T.StringType(), True),
    T.StructField("messages", T.StringType(), True),
    T.StructField("context", T.StringType(), True),
    T.StructField("response", T.StringType(), True),
    T.StructField("callback_class", T.StringType(), True),
    T.StructField("callback_method", T.StringType(), True),
    T.StructField("input_tokens", T.LongType(), False),
    T.StructField("output_tokens", T.LongType(), False),
    T.StructField("estimated_cost", COST_TYPE, False),
    T.StructField("error_message", T.StringType(), True),
    T.StructField("retries", T.IntegerType(), False),
    T.StructField("max_retries", T.IntegerType(), False),
    T.StructField("admin_user_id", T.LongType(), True),
    T.StructField("store_id", T.IntegerType(), False),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("started_at", T.TimestampNTZType(), True),
    T.StructField("completed_at", T.TimestampNTZType(), True),
])

USAGE_KEY = ["consumer", "platform", "model", "store_id", "period_date"]
USAGE_SCHEMA = T.StructType([
    T.StructField("consumer", T.StringType(), False),
    T.StructField("platform", T.StringType(), False),
    T.StructField("model", T.StringType(), False),
    T.StructField("store_id", T.IntegerType(), False),
    T.StructField("period_date", T.DateType(), False),
    T.StructField("request_count", T.LongType(), False),
    T.StructField("input_tokens", T.LongType(), False),
    T.StructField("output_tokens", T.LongType(), False),
    T.StructField("estimated_cost", T.DecimalType(20, 6), False),
])

VECTOR_KEY = ["entity_type", "entity_id", "store_id"]
VECTOR_SCHEMA = T.StructType([
    T.StructField("entity_type", T.StringType(), False),
    T.StructField("entity_id", T.LongType(), False),
    T.StructField("store_id", T.IntegerType(), False),
    T.StructField("platform", T.StringType(), True),
    T.StructField("model", T.StringType(), True),
    T.StructField("dimensions", T.LongType(), True),
    T.StructField("vector", T.ArrayType(T.FloatType()), False),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("updated_at", T.TimestampNTZType(), False),
])

# One provider result for one attempt of one task.
OUTCOME_SCHEMA = T.StructType([
    T.StructField("task_id", T.LongType(), False),
    T.StructField("attempt", T.IntegerType(), False),
    T.StructField("ok", T.BooleanType(), False),
    T.StructField("response", T.StringType(), True),
    T.StructField("input_tokens", T.LongType(), True),
    T.StructField("output_tokens", T.LongType(), True),
    T.StructField("platform", T.StringType(), True),
    T.StructField("model", T.StringType(), True),
    T.StructField("error", T.StringType(), True),
    T.StructField("vector", T.ArrayType(T.FloatType()), True),
])

PRICE_SCHEMA = T.StructType([
    T.StructField("platform", T.StringType(), False),
    T.StructField("model", T.StringType(), False),
    T.StructField("price_in", PRICE_TYPE, False),
    T.StructField("price_out", PRICE_TYPE, False),
])

PROVIDER_SCHEMA = T.StructType([
    T.StructField("code", T.StringType(), False),
    T.StructField("label", T.StringType(), False),
    T.StructField("capabilities", T.StringType(), True),
    T.StructField("sort_order", T.IntegerType(), True),
])
