"""Operator 12: interaction audit of five filters over all their orders.

Each document's filter failures are a five-bit mask, and what any order of the
filters does to a document depends on its mask alone.  So documents are counted
into cells (part, mask) - at most 32 a part, with their good and toxic labels -
and every cell folds across the order array: ``transform`` over the 120 orders,
``aggregate`` along the five steps of each, giving 600 structs weighted with the
cell's counts.  A part's cells are merged by elementwise sums of their 600
structs; the Shapley figures are sums over the merged array.

Filter E (identical to a smaller doc_id's text) needs no join of documents: rows
are counted by (text digest, part), keeping apart those at the group's smallest
id, and only the smallest id per digest meets those counts again - one row per
digest and part, however many copies a text has.  All aggregations combine
before they shuffle; texts are read once and never shuffled (the counts per text
and part are written to the shared folder).

Defined results: null text counts as empty; null source is the part '' (together
with empty sources).  A null doc_id is neither smaller than another nor has a
smaller one, and has no label.  Ties: rows with the same doc_id and text are not
smaller than each other, so neither fails E for the other.  Repeated rows each
count; a doc_id labelled more than once is good (toxic) if any of its rows says
so.  Very long texts are read whole.  An empty table gives no rows.  Extra columns
are not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import materialise, words_of

FILTERS = "ABCDE"
STEPS = len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MIN_WORDS = 50
DISTINCT_PERCENT = 65
UPPER_PERCENT = 5
MARKS = "[#$%&*|]"
COPY_BIT = 16
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_mask(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text and the mask of filters A to D."""
    t = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"),
                    F.coalesce("text", F.lit("")).alias("text"))
    t = t.select("doc_id", "part", "text", words_of(F.col("text")).alias("words"))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    upper = F.regexp_count("text", F.lit("[A-Z]"))
    fails = [n < MIN_WORDS, distinct * 100 < n * DISTINCT_PERCENT,
             upper * 100 > F.length("text") * UPPER_PERCENT, F.col("text").rlike(MARKS)]
    mask = F.lit(0)
    for bit, fail in enumerate(fails):
        mask = mask + F.when(fail, 1 << bit).otherwise(0)
    return t.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (all five filters), n, good, toxic: at most 32 rows a part."""
    says = labels.groupBy(F.col("doc_id").alias("l_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = text_mask(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    rows = rows.join(says, F.col("doc_id") == F.col("l_id"), "left").select(
        "doc_id", "part", "digest", "mask",
        F.struct("n", (F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
                 (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic")).alias("w"))

    def sums(weight: Column) -> list[Column]:
        return [F.coalesce(F.sum(weight[x]), F.lit(0)) for x in ("n", "good", "toxic")]

    no_id = F.when(F.col("doc_id").isNull(), F.col("w"))
    groups = rows.groupBy("digest", "part", "mask").agg(
        F.min("doc_id").alias("low"), F.min_by("w", "doc_id").alias("at_low"),
        F.struct(*[c.alias(x) for c, x in zip(sums(F.col("w")), ("n", "good", "toxic"))]).alias("all"),
        F.struct(*[c.alias(x) for c, x in zip(sums(no_id), ("n", "good", "toxic"))]).alias("free"))
    groups = materialise(groups, "audit-groups")   # read twice below; a few bytes per text
    # Texts of more than one part: the part that has the smallest id.
    first = groups.groupBy(F.col("digest").alias("d")).agg(F.min("low").alias("first"), F.count("*").alias("parts")) \
        .where("parts > 1")
    groups = groups.join(first, F.col("digest") == F.col("d"), "left")
    is_first = F.col("low") == F.coalesce("first", "low")
    free = {x: F.col("free")[x] + F.when(is_first, F.col("at_low")[x]).otherwise(0) for x in ("n", "good", "toxic")}
    split = F.array(
        F.struct(F.col("mask").alias("mask"), *[free[x].alias(x) for x in free]),
        F.struct((F.col("mask") + COPY_BIT).alias("mask"), *[(F.col("all")[x] - free[x]).alias(x) for x in free]))
    return groups.select("part", F.inline(split)).where("n > 0").groupBy("part", "mask") \
        .agg(*[F.sum(x).alias(x) for x in free])


def _fold(order: Column, fails: Column) -> Column:
    """The five weighted structs of one order for one cell."""
    only = F.size(F.filter(fails, lambda x: x)) == 1
    zero, n = F.lit(0).cast("long"), F.col("n")

    def step(state: Column, i: Column) -> Column:
        hit = F.element_at(fails, F.ascii(F.substr(order, i)) - ord("A") + 1)
        here = hit & ~state["gone"]
        gone = state["gone"] | hit
        weighted = [F.when(~gone, n), F.when(here, n), F.when(hit & state["gone"], n), F.when(hit & only, n),
                    F.when(here, F.col("good")), F.when(here, F.col("toxic"))]
        one = F.struct(order.alias("filter_order"), i.alias("step"),
                       *[F.coalesce(c, zero).alias(m) for c, m in zip(weighted, MEASURES)])
        return F.struct(gone.alias("gone"), F.concat(state["steps"], F.array(one)).alias("steps"))

    kind = "array<struct<filter_order:string,step:int," + ",".join(f"{m}:bigint" for m in MEASURES) + ">>"
    start = F.struct(F.lit(False).alias("gone"), F.array().cast(kind).alias("steps"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["steps"])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step (600 a part)."""
    fails = F.array(*[F.col("mask").bitwiseAND(1 << bit) != 0 for bit in range(STEPS)])
    orders = F.split(F.lit(" ".join(ORDERS)), " ")
    folded = cells(docs, labels).select("part", "mask", "n", "good", "toxic").select(
        "part", F.flatten(F.transform(orders, lambda o: _fold(o, fails))).alias("steps"))

    def add(a: Column, b: Column) -> Column:
        return F.struct(b["filter_order"].alias("filter_order"), b["step"].alias("step"),
                        *[(a[m] + b[m]).alias(m) for m in MEASURES])

    # At most 32 arrays of 600 structs are collected per part, by construction.
    listed = folded.groupBy("part").agg(F.collect_list("steps").alias("cells"))
    merged = listed.select("part", F.aggregate(
        F.slice("cells", 2, 1 << STEPS), F.element_at("cells", 1), lambda acc, c: F.zip_with(acc, c, add)).alias("steps"))

    def letter(s: Column) -> Column:
        return F.substr(s["filter_order"], s["step"], F.lit(1))

    shapley = F.transform(F.split(F.lit(FILTERS), ""), lambda f: F.aggregate(
        "steps", F.lit(0).cast("long"), lambda acc, s: acc + F.when(letter(s) == f, s["removed"]).otherwise(0)))
    merged = merged.select("part", "steps", shapley.alias("shapley"))
    return merged.select("part", "shapley", F.inline("steps")).select(
        "part", "filter_order", "step", *MEASURES,
        F.element_at("shapley", F.ascii(F.substr("filter_order", "step")) - ord("A") + 1).alias("shapley"))


def op12(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(docs, labels)


ORACLE_SQL = r"""
WITH says AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) toxic
  FROM labels GROUP BY doc_id),
d AS (
  SELECT doc_id, coalesce(source, '') part, coalesce(text, '') t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) low
  FROM documents),
m AS (
  SELECT part, coalesce(good, 0) good, coalesce(toxic, 0) toxic,
         (CASE WHEN len(words) < 50 THEN 1 ELSE 0 END)
       + (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END)
       + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END)
       + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
       + (CASE WHEN low < d.doc_id THEN 16 ELSE 0 END) mask
  FROM d LEFT JOIN says ON d.doc_id = says.doc_id),
c AS (SELECT part, mask, count(*) n, sum(good) good, sum(toxic) toxic FROM m GROUP BY part, mask),
f(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT a.l || b.l || c.l || d.l || e.l filter_order,
         [a.bit, b.bit, c.bit, d.bit, e.bit] bits
  FROM f a, f b, f c, f d, f e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (
  SELECT filter_order, step::INTEGER step, bits[step] bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER earlier
  FROM o, range(1, 6) r(step)),
x AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (bit | earlier) = 0 THEN n ELSE 0 END)::BIGINT kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END)::BIGINT redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END)::BIGINT toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT shapley
FROM x
"""
