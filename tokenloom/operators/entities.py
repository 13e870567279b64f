"""Text preparation for embeddings: markup removal, entity text, embedding
task rows, message normalising and call-log parsing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import regex as rx
from tokenloom.operators.tasks import enqueue
from tokenloom.schemas import MESSAGES_TYPE

# Call-log line layout.
CALL_LOG_LINE = (r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\] consumer=(\S*) platform=(\S*) "
                 r"model=(\S*) in=(-?\d+) out=(-?\d+) cost=\$(-?\d+\.\d{6})\z")


def strip_tags(c: Column) -> Column:
    """Markup removal in one pass from left to right (``rx.markup_scan``).  Text
    between tags stays, also that of scripts; ``a < b`` is text, ``a <b`` is not."""
    return F.regexp_replace(c, rx.MARKUP, "")


def _join_parts(*parts: Column) -> Column:
    """Join the non-empty parts with one space and trim; ``'0'`` counts as empty."""
    arr = F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "") & (x != "0"))
    return F.btrim(F.array_join(arr, " "), F.lit(rx.TRIM_CHARS))


def enabled_products(products: DataFrame) -> DataFrame:
    return products.where(F.col("status") == 1)


def active_categories(categories: DataFrame) -> DataFrame:
    return categories.where(F.col("is_active") & (F.col("level") > 1))


def _non_empty(text: Column) -> Column:
    """Generator keeping the text only when it is non-empty.

    A plain ``where(text != '')`` is pushed below the projection and would
    evaluate the whole markup-removal chain twice per row; inside a
    generator the text is computed once.
    """
    return F.explode(F.filter(F.array(text), lambda t: t != ""))


def product_text(products: DataFrame) -> DataFrame:
    text = _join_parts(F.col("name"), strip_tags(F.col("short_description")),
                       strip_tags(F.col("description")))
    return products.select(F.lit("product").alias("entity_type"), "entity_id", _non_empty(text).alias("text"))


def category_text(categories: DataFrame) -> DataFrame:
    text = _join_parts(F.col("name"), strip_tags(F.col("description")))
    return categories.select(F.lit("category").alias("entity_type"), "entity_id", _non_empty(text).alias("text"))


def entity_changes(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Saves of both entity types in one shape (``store_id`` and ``changed_at`` kept);
    ``active`` tells whether the entity is to be embedded."""
    common = ["entity_id", "store_id", "name"]
    p = products.select(F.lit("product").alias("entity_type"), *common, "short_description", "description",
                        (F.col("status") == 1).alias("active"), "changed_at")
    c = categories.select(F.lit("category").alias("entity_type"), *common,
                          F.lit(None).cast("string").alias("short_description"), "description",
                          (F.col("is_active") & (F.col("level") > 1)).alias("active"), "changed_at")
    return p.unionByName(c)


def change_text(changes: DataFrame) -> DataFrame:
    """``text`` of each save; empty where there is nothing to embed."""
    text = _join_parts(F.col("name"), strip_tags(F.col("short_description")), strip_tags(F.col("description")))
    return changes.withColumn("text", F.when(F.col("active"), text).otherwise(F.lit("")))


def entity_text(products: DataFrame | None, categories: DataFrame | None) -> DataFrame:
    parts = []
    if products is not None:
        parts.append(product_text(enabled_products(products)))
    if categories is not None:
        parts.append(category_text(active_categories(categories)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


CONSUMER_BY_TYPE = {"product": "catalog_product", "category": "catalog_category"}


def embed_tasks(texts: DataFrame, store_id: int | Column = 0, created_at: dt.datetime | None = None,
                id_col: Column | None = None, run: str | None = None) -> DataFrame:
    """Embedding task rows for (entity_type, entity_id, text).

    ``task_id`` defaults to a 64-bit hash of the entity key and the queue run
    (its name, else its time): running the same job again produces the same ids,
    which a task log then ignores, and a later run produces new ones.
    """
    consumer = F.when(F.col("entity_type") == "product", "catalog_product") \
        .when(F.col("entity_type") == "category", "catalog_category") \
        .otherwise(F.concat(F.lit("catalog_"), F.col("entity_type")))
    name = run if run is not None else str(created_at or "")
    tid = id_col if id_col is not None else F.xxhash64("entity_type", "entity_id", F.lit(store_id), F.lit(name))
    req = texts.select(
        tid.alias("task_id"),
        consumer.alias("consumer"),
        F.lit("embedding").alias("task_type"),
        F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))))
        .alias("messages"),
        F.to_json(F.struct("entity_type", "entity_id")).alias("context"),
        F.lit(store_id).alias("store_id"))
    return enqueue(req, F.col("consumer"), "embed", task_type="embedding", store_id=store_id,
                   created_at=created_at)


def queue_all(products: DataFrame, categories: DataFrame, include_products: bool = True,
              include_categories: bool = True, store_id: int = 0,
              created_at: dt.datetime | None = None, run: str | None = None) -> DataFrame:
    texts = entity_text(products if include_products else None,
                        categories if include_categories else None)
    return embed_tasks(texts, store_id, created_at, run=run)


def missing_vectors(texts: DataFrame, vectors: DataFrame, tasks: DataFrame, store_id: int = 0) -> DataFrame:
    """Entities with text but, in this store, neither a stored vector nor an
    open embedding task (vectors are keyed by entity and store)."""
    have = vectors.where(F.col("store_id") == store_id).select("entity_type", "entity_id").distinct()
    ctx = F.from_json("context", "map<string,string>")
    queued = tasks.where(F.col("status").isin("pending", "processing")
                         & (F.col("task_type") == "embedding") & (F.col("store_id") == store_id)) \
        .select(F.try_element_at(ctx, F.lit("entity_type")).alias("entity_type"),
                F.try_element_at(ctx, F.lit("entity_id")).cast("bigint").alias("entity_id")) \
        .where(F.col("entity_id").isNotNull()).distinct()
    return texts.join(have, ["entity_type", "entity_id"], "left_anti") \
        .join(queued, ["entity_type", "entity_id"], "left_anti")


def normalize_messages(turns: DataFrame, system_prompt: str | None = None) -> DataFrame:
    """One ordered message list per conversation: roles other than system and
    assistant become user, missing content becomes '', and a non-empty system
    prompt is put first."""
    role = F.when(F.col("role").isin("system", "assistant"), F.col("role")).otherwise(F.lit("user"))
    packed = turns.select("conv_id", F.struct(F.col("turn"), role.alias("role"),
                                              F.coalesce("text", F.lit("")).alias("content")).alias("m"))
    grouped = packed.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    msgs = F.transform("ms", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    if system_prompt:
        sys_msg = F.array(F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")))
        msgs = F.concat(sys_msg, msgs)
    return grouped.select("conv_id", msgs.cast(MESSAGES_TYPE).alias("messages"))


def first_prompt(turns: DataFrame) -> DataFrame:
    """Content of the first message of each conversation ('' when empty)."""
    return turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("t")) \
        .select("conv_id", F.coalesce("t", F.lit("")).alias("first_prompt"))


def format_call_log(priced_calls: DataFrame) -> DataFrame:
    """Render calls as request-log lines."""
    line = F.concat(F.lit("["), F.date_format("called_at", "yyyy-MM-dd HH:mm:ss"), F.lit("] consumer="),
                    F.col("consumer"), F.lit(" platform="), F.coalesce("platform", F.lit("")),
                    F.lit(" model="), F.coalesce("model", F.lit("")),
                    F.lit(" in="), F.col("input_tokens").cast("string"),
                    F.lit(" out="), F.col("output_tokens").cast("string"),
                    F.lit(" cost=$"), F.col("estimated_cost").cast("string"))
    return priced_calls.select(line.alias("value"))


def parse_call_log(lines: DataFrame, col: str = "value") -> DataFrame:
    """Parse request-log lines into a call log; unparsable lines are kept with
    ``parsed = false`` so a caller can route them to a reject table.

    One anchored regex test per line; a line that passes has exactly eight
    space-separated fields, which are then cut out with ``split`` (no
    further regex work per field).
    """
    v = F.col(col)
    ok = v.rlike(CALL_LOG_LINE)
    parts = F.when(ok, F.split(v, " "))   # rejected lines are never split

    def field(i: int, prefix: int) -> Column:
        return F.when(F.col("parsed"), F.expr(f"substring(_parts[{i}], {prefix + 1})"))

    stamp = F.when(F.col("parsed"), F.concat(F.expr("substring(_parts[0], 2)"), F.lit(" "),
                                F.expr("substring(_parts[1], 1, 8)")))
    return lines.select(v.alias(col), ok.alias("parsed"), parts.alias("_parts")).select(
        "parsed",
        F.to_timestamp_ntz(stamp, F.lit("yyyy-MM-dd HH:mm:ss")).alias("called_at"),
        field(2, 9).alias("consumer"), F.nullif(field(3, 9), F.lit("")).alias("platform"),
        F.nullif(field(4, 6), F.lit("")).alias("model"),
        field(5, 3).cast("bigint").alias("input_tokens"), field(6, 4).cast("bigint").alias("output_tokens"),
        field(7, 6).cast("decimal(10,6)").alias("estimated_cost"),
        F.when(~F.col("parsed"), F.col(col)).alias("rejected_line"))
