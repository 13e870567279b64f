"""Pluggable batch inference: the only place where Python runs per batch.

``infer_batch`` turns task rows into outcome rows with ``mapInPandas``: one
provider client per partition, Arrow batches in, one outcome per task out.
Provider errors become failed outcomes (never a failed job), so the task
log can retry them (``apply_outcomes``).  Spark may re-run a partition; the
(task_id, attempt) key makes repeated outcomes collapse downstream.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.schemas import OUTCOME_SCHEMA

# Default model per platform and per task type.
DEFAULT_MODELS = {
    "completion": {"openai": "gpt-4o", "anthropic": "claude-sonnet-4-6", "google": "gemini-2.0-flash",
                   "mistral": "mistral-large-latest", "openrouter": "openai/gpt-4o", "ollama": "llama3.2"},
    "embedding": {"openai": "text-embedding-3-small", "google": "text-embedding-004",
                  "mistral": "mistral-embed", "ollama": "nomic-embed-text"},
    "image": {"openai": "dall-e-3", "google": "imagen-3.0-generate-001"},
}
DEFAULT_PLATFORM = "openai"
OUTCOME_ROWS = 512      # outcomes handed on at a time

TASK_INPUT_COLS = ["task_id", "task_type", "platform", "model", "system_prompt", "messages", "context",
                   "retries"]


class Provider:
    """What a provider client implements (all methods see one task).

    A client that answers with another model or platform than it was asked for
    says so in ``last_model`` / ``last_platform``; the outcome is then booked and
    priced under those."""

    last_model: str | None = None
    last_platform: str | None = None

    def complete(self, messages: list[dict], options: dict) -> tuple[str, int, int]:
        raise NotImplementedError

    def embed(self, texts: list[str], options: dict) -> tuple[list[list[float]], int]:
        raise NotImplementedError

    def generate_image(self, prompt: str, options: dict) -> str:
        raise NotImplementedError


def _messages(raw) -> list[dict]:
    try:
        out = json.loads(raw) if raw else []
    except (TypeError, ValueError):
        return []
    return out if isinstance(out, list) else []


def _context(raw) -> dict:
    try:
        out = json.loads(raw) if raw else {}
    except (TypeError, ValueError):
        return {}
    return out if isinstance(out, dict) else {}


def _used(provider: Provider, outcome: dict) -> dict:
    """The outcome under the platform and model that really answered."""
    return {**outcome, "platform": getattr(provider, "last_platform", None) or outcome["platform"],
            "model": getattr(provider, "last_model", None) or outcome["model"]}


def _forget(provider: Provider) -> None:
    provider.last_model = provider.last_platform = None


def _run_one(provider: Provider, row, target_dims: int) -> dict:
    ttype = row.task_type or "completion"
    platform = row.platform or DEFAULT_PLATFORM
    model = row.model or DEFAULT_MODELS.get(ttype, {}).get(platform)
    base = {"task_id": int(row.task_id), "attempt": int(row.retries) + 1, "platform": platform, "model": model,
            "response": None, "input_tokens": None, "output_tokens": None, "error": None, "vector": None}
    msgs = _messages(row.messages)
    _forget(provider)
    try:
        if ttype == "completion":
            if row.system_prompt:
                msgs = [{"role": "system", "content": row.system_prompt}] + msgs
            msgs = [{"role": m.get("role") if m.get("role") in ("system", "assistant") else "user",
                     "content": m.get("content") or ""} for m in msgs if isinstance(m, dict)]
            text, tin, tout = provider.complete(msgs, {"model": model})
            return _used(provider, {**base, "ok": True, "response": text, "input_tokens": tin, "output_tokens": tout})
        if ttype == "embedding":
            text = (msgs[0].get("content") if msgs and isinstance(msgs[0], dict) else "") or ""
            opts = {"model": model, **({"dimensions": target_dims} if target_dims > 0 else {})}
            vecs, tin = provider.embed([text], opts)
            tin = _tokens_per_text(tin, [text])[0]
            vec = [float(x) for x in (vecs[0] if vecs else [])]
            return _used(provider, {**base, "ok": True, "response": json.dumps(vec), "input_tokens": tin,
                                    "output_tokens": 0, "vector": vec})
        if ttype == "image":
            prompt = (msgs[0].get("content") if msgs and isinstance(msgs[0], dict) else "") or ""
            url = provider.generate_image(prompt, {**_context(row.context), "model": model})
            return _used(provider, {**base, "ok": True, "response": url, "input_tokens": 0, "output_tokens": 0})
        raise ValueError(f"Unknown task type: {ttype}")
    except Exception as exc:  # noqa: BLE001 - every provider error becomes an outcome row
        return {**base, "ok": False, "platform": None, "model": None, "error": str(exc)}


def _embed_chunk(provider: Provider, rows: list, target_dims: int) -> list[dict]:
    """One provider call for many embedding tasks of the same model; if the
    call fails, each task is retried alone so one bad text fails only itself."""
    first = rows[0]
    platform = first.platform or DEFAULT_PLATFORM
    model = first.model or DEFAULT_MODELS["embedding"].get(platform)
    texts = []
    for r in rows:
        msgs = _messages(r.messages)
        texts.append((msgs[0].get("content") if msgs and isinstance(msgs[0], dict) else "") or "")
    opts = {"model": model, **({"dimensions": target_dims} if target_dims > 0 else {})}
    _forget(provider)
    try:
        vecs, tokens = provider.embed(texts, opts)
        if len(vecs) != len(rows):
            raise ValueError("provider returned a different number of vectors")
        counts = _tokens_per_text(tokens, texts)
    except Exception:  # noqa: BLE001 - isolate the failing text
        return [_run_one(provider, r, target_dims) for r in rows]
    out = []
    for r, count, vec in zip(rows, counts, vecs):
        vec = [float(x) for x in vec]
        out.append(_used(provider, {
            "task_id": int(r.task_id), "attempt": int(r.retries) + 1, "ok": True, "response": json.dumps(vec),
            "input_tokens": count, "output_tokens": 0, "platform": platform, "model": model, "error": None,
            "vector": vec}))
    return out


def _tokens_per_text(tokens, texts: list[str]) -> list[int]:
    """Billed tokens of each text: as reported when the provider lists them,
    else its total shared out by length in characters (largest remainder, so
    the sum is the reported total)."""
    if isinstance(tokens, (list, tuple)):
        if len(tokens) != len(texts):
            raise ValueError("provider returned a different number of token counts")
        return [int(t) for t in tokens]
    weights = [len(t) for t in texts]
    if not sum(weights):
        weights = [1] * len(texts)
    exact = [int(tokens) * w / sum(weights) for w in weights]
    counts = [int(x) for x in exact]
    for i in sorted(range(len(texts)), key=lambda i: (counts[i] - exact[i], i))[:int(tokens) - sum(counts)]:
        counts[i] += 1
    return counts


def _outcomes(provider: Provider, pdf: pd.DataFrame, target_dims: int, embed_batch_size: int) -> Iterator[dict]:
    groups: dict[tuple, list] = {}
    for r in pdf.itertuples(index=False):
        if (r.task_type or "completion") == "embedding" and embed_batch_size > 1:
            groups.setdefault((r.platform, r.model), []).append(r)
        else:
            yield _run_one(provider, r, target_dims)
    for group in groups.values():
        for i in range(0, len(group), embed_batch_size):
            yield from _embed_chunk(provider, group[i:i + embed_batch_size], target_dims)


def _frames(outcomes: Iterator[dict], names: list[str]) -> Iterator[pd.DataFrame]:
    """Outcomes in frames of ``OUTCOME_ROWS``, so that few vectors are held at a time."""
    while part := list(islice(outcomes, OUTCOME_ROWS)):
        yield pd.DataFrame(part, columns=names)


def infer_batch(tasks: DataFrame, provider_factory: Callable[[], Provider], target_dims: int = 0,
                embed_batch_size: int = 64) -> DataFrame:
    """One outcome per task row.  ``provider_factory`` runs once per partition
    on the executor (build HTTP clients there, not on the driver).

    Embedding tasks of one (platform, model) are sent ``embed_batch_size``
    texts per provider call instead of one call per text.  ``embed`` returns
    the vectors and either the tokens of each text or their total, which is
    then shared out so that its sum is kept.  A task holds one Arrow batch of
    requests and ``OUTCOME_ROWS`` outcomes, whose vectors are the larger part."""
    cols = [F.col(c) if c in tasks.columns else F.lit(None).cast("string").alias(c) for c in TASK_INPUT_COLS]
    names = [f.name for f in OUTCOME_SCHEMA.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = provider_factory()
        for pdf in batches:
            yield from _frames(_outcomes(provider, pdf, target_dims, embed_batch_size), names)

    return tasks.select(*cols).mapInPandas(run, OUTCOME_SCHEMA)


def infer_by_type(tasks: DataFrame, factories: dict[str, Callable[[], Provider]],
                  target_dims: int = 0) -> DataFrame:
    """Dispatch by task type: each type's rows go to its own provider factory
    (e.g. a chat client, an embedding client, an image client); the outcome
    sets are unioned.  Rows of a type without a factory fail with
    ``Unknown task type``."""
    ttype = F.coalesce(F.nullif(F.col("task_type"), F.lit("")), F.lit("completion"))
    typed = tasks.withColumn("task_type", ttype)
    parts = [infer_batch(typed.where(F.col("task_type") == t), f, target_dims) for t, f in factories.items()]
    known = list(factories)
    unknown = typed.where(~F.col("task_type").isin(known)).select(
        "task_id", (F.col("retries") + 1).cast("int").alias("attempt"), F.lit(False).alias("ok"),
        *[F.lit(None).cast(t).alias(c) for c, t in [("response", "string"), ("input_tokens", "bigint"),
                                                      ("output_tokens", "bigint"), ("platform", "string"),
                                                      ("model", "string")]],
        F.concat(F.lit("Unknown task type: "), F.col("task_type")).alias("error"),
        F.lit(None).cast("array<float>").alias("vector"))
    out = unknown
    for p in parts:
        out = out.unionByName(p)
    return out


def on_complete(before: DataFrame, after: DataFrame, registry: dict[str, dict[str, Callable]]) -> DataFrame:
    """Fire ``registry[callback_class][callback_method](task_id, response)`` for
    tasks that became complete (success only).  Unknown callbacks are
    reported per row, never fatal.  Returns one row per attempted call."""
    newly = after.alias("a").join(before.select("task_id", F.col("status").alias("old_status")), "task_id") \
        .where((F.col("status") == "complete") & (F.col("old_status") != "complete")
               & F.col("callback_class").isNotNull() & F.col("callback_method").isNotNull()) \
        .select("task_id", "callback_class", "callback_method", "response")
    return fire(newly, registry)


def fire(rows: DataFrame, registry: dict[str, dict[str, Callable]]) -> DataFrame:
    """Call back for every row (task_id, callback_class, callback_method, response)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                methods = registry.get(r.callback_class)
                if methods is None:
                    out.append((r.task_id, "unknown class"))
                elif r.callback_method not in methods:
                    out.append((r.task_id, "unknown method"))
                else:
                    try:
                        methods[r.callback_method](int(r.task_id), r.response)
                        out.append((r.task_id, "called"))
                    except Exception as exc:  # noqa: BLE001
                        out.append((r.task_id, f"error: {exc}"))
            yield pd.DataFrame(out, columns=["task_id", "callback_status"])

    return rows.mapInPandas(run, "task_id long, callback_status string")


class StubProvider(Provider):
    """Deterministic provider for tests and examples (no network).

    completion: ``echo:`` + last message, tokens = characters in / out;
    embedding: 4 numbers from the text length; image: a URL from the prompt
    length.  Any text containing ``FAIL`` raises, like a provider error."""

    def __init__(self, platform: str = "openai"):
        self.platform = platform

    def complete(self, messages, options):
        last = messages[-1]["content"] if messages else ""
        if "FAIL" in last:
            raise RuntimeError(f"AI request failed ({self.platform}): stub failure")
        text = "echo:" + last
        return text, sum(len(m["content"]) for m in messages), len(text)

    def embed(self, texts, options):
        vecs = [[float(len(t) % 7), float(len(t) % 11), float(len(t) % 13), 1.0] for t in texts]
        return vecs, sum(len(t) for t in texts)

    def generate_image(self, prompt, options):
        return f"https://img.invalid/{len(prompt)}.png"
