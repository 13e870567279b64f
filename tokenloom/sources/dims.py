"""Small dimension tables: the per-token price list and the provider registry.

Both are bounded constants (a handful of rows), so they are safe to
broadcast; callers may pass their own, newer tables instead.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.schemas import PRICE_SCHEMA, PROVIDER_SCHEMA

# USD per token (input, output) by platform and model.
PRICES = [
    ("openai", "gpt-4o", "0.0000025", "0.000010"),
    ("openai", "gpt-4o-mini", "0.00000015", "0.0000006"),
    ("openai", "gpt-4-turbo", "0.000010", "0.000030"),
    ("openai", "gpt-3.5-turbo", "0.0000005", "0.0000015"),
    ("anthropic", "claude-opus-4-20250514", "0.000015", "0.000075"),
    ("anthropic", "claude-sonnet-4-20250514", "0.000003", "0.000015"),
    ("anthropic", "claude-haiku-4-5-20251001", "0.00000025", "0.00000125"),
    ("google", "gemini-2.0-flash", "0.00000010", "0.00000040"),
    ("google", "gemini-1.5-pro", "0.0000035", "0.0000105"),
]

# Provider registry (code, label, capabilities, sort order).
PROVIDERS = [
    ("openai", "OpenAI", "chat,embed,image", 10),
    ("anthropic", "Anthropic (Claude)", "chat", 20),
    ("google", "Google (Gemini)", "chat,embed,image", 30),
    ("mistral", "Mistral AI", "chat,embed", 40),
    ("openrouter", "OpenRouter", "chat,image", 50),
    ("ollama", "Ollama (Local)", "chat,embed", 60),
    ("generic", "Generic (OpenAI-compatible)", "chat,embed,image", 70),
]

# Capability each task type needs.
TYPE_CAPABILITY = [("completion", "chat"), ("embedding", "embed"), ("image", "image")]


def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, Decimal):   # exact text; the schema cast makes it a decimal
        return "'" + format(v, "f") + "'"
    return str(v)


def _values_table(spark: SparkSession, rows, schema) -> DataFrame:
    """A JVM-local table (``LocalTableScan``) from literal rows, typed by ``schema``."""
    names = [f.name for f in schema.fields]
    body = ", ".join("(" + ", ".join(_sql_literal(v) for v in row) + ")" for row in rows)
    raw = spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def price_dim(spark: SparkSession, rows=None) -> DataFrame:
    rows = PRICES if rows is None else rows
    return _values_table(spark, [(p, m, Decimal(i), Decimal(o)) for p, m, i, o in rows], PRICE_SCHEMA)


def provider_dim(spark: SparkSession, rows=None) -> DataFrame:
    """Providers with ``capabilities`` as a trimmed array, ordered by sort order."""
    rows = PROVIDERS if rows is None else rows
    df = _values_table(spark, rows, PROVIDER_SCHEMA)
    return df.select(
        "code", "label",
        F.transform(F.split(F.coalesce("capabilities", F.lit("")), ","), lambda c: F.trim(c))
        .alias("capabilities"),
        F.coalesce("sort_order", F.lit(999)).alias("sort_order"),
    )


def providers_with_capability(providers: DataFrame, capability: str) -> DataFrame:
    return (providers.where(F.array_contains("capabilities", capability))
            .orderBy("sort_order", "code"))

# Prefixes used when provider errors are reported.
ERROR_PREFIXES_DOC = [
    "Authentication failed",
    "Rate limit exceeded",
    "Request blocked by content filter",
    "Model not found",
    "Prompt exceeds the model context size",
    "AI request failed",
]
