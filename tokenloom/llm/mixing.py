"""Operator 7: mixing sources to target weights along a curriculum.

Targets: sources in code point order (null last) weigh 1, 2, 3, repeating, and
share all words by weight; no target exceeds ``MAX_REPEAT`` times its source,
the excess is reshared by weight until none does (a water level, found with one
small aggregate per step).

Curriculum: every source has a weight schedule over training time 0..1
(piecewise linear, ``SCHEDULES`` by weight class).  Its integral, scaled to the
source's target, is the source's cumulative word demand D(t).  Documents are
laid end to end within their source in a fixed pseudo-random order, again and
again until the target is reached; a document that starts at word c gets the
training position t with D(t) = c.  Sorting by position by range gives the
training order, in which each source is present as its schedule asks.

The offset of a document within its source comes from ``prefix_sums``, so a
source with a third of all rows is summed by many tasks.  The last piece of a
source may be a document's first words only, so its taken words equal the
whole part of its target exactly.

Defined results: null text has size 0; a document of size 0 is never taken and
a source of size 0 has target 0; equal and repeated rows are separate
documents, ordered by (hash of id and text, id); extra columns are kept by
``mix`` and ignored by ``assign``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import materialise, prefix_sums, smallest_row, word_count

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
SEED = 20240131
# Weight class -> knots (time, relative weight): light sources fade out,
# heavy ones fade in.
SCHEDULES = {1: ((0.0, 1.5), (1.0, 0.5)), 2: ((0.0, 1.0), (1.0, 1.0)), 3: ((0.0, 0.5), (0.6, 1.0), (1.0, 2.0))}


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, target from (source, size) rows."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")) \
        .withColumn("_last", F.col("source").isNull()).withColumn("one", F.lit(1).cast("long"))
    ranked = prefix_sums(per, "one", [], ["_last", "source"], "mix-sources", out="rank")
    weight = F.get(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS)).cast("int"))
    table = materialise(ranked.select("source", "source_size", weight.alias("weight")), "mix-weights")
    cap = F.col("source_size") * MAX_REPEAT
    total, weights = table.agg(F.sum("source_size"), F.sum("weight")).first()
    level = total / weights if weights else 0.0
    while True:     # each step caps at least one more source
        below = cap < F.col("weight") * F.lit(float(level))
        capped, free = table.agg(F.sum(F.when(below, cap)), F.sum(F.when(~below, F.col("weight")))).first()
        new = (total - (capped or 0)) / free if free else level
        if new <= level:
            break
        level = new
    return table.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(level))))


def invert_demand(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """Time at which the schedule's integral reaches ``share`` (0..1) of its whole."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    need, out, done = share * float(sum(areas)), None, 0.0
    for (t0, w0), (t1, w1), area in reversed(list(zip(knots, knots[1:], areas))):
        start = sum(areas) - done - area
        rest = F.greatest(need - F.lit(float(start)), F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        # rest = w0 x + slope x^2 / 2
        x = rest / F.lit(w0) if slope == 0 else \
            (F.sqrt(F.greatest(F.lit(w0 * w0) + rest * (2 * slope), F.lit(0.0))) - w0) / slope
        here = F.lit(t0) + x
        out = here if out is None else F.when(need < F.lit(float(start + area)), here).otherwise(out)
        done += area
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def assign(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source, key, source_size, target and
    ``pieces``: (epoch, words, position) for each time it is taken."""
    text = F.coalesce("text", F.lit(""))
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                        F.xxhash64(F.lit(SEED), F.col("doc_id"), text).alias("key"))
    placed = prefix_sums(sizes, "size", ["source"], ["key", "doc_id"], "mix-sizes")
    targets = materialise(source_targets(placed.select("source", "size")), "mix-targets") \
        .withColumnRenamed("source", "_source")
    d = placed.join(targets, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    pieces = []
    for epoch in range(MAX_REPEAT):
        at = F.col("offset") + F.col("source_size") * epoch
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target").cast("long") - at)).cast("long")
        share = at / F.greatest(F.col("target"), F.lit(1.0))
        position = F.coalesce(*[F.when(F.col("weight") == w, invert_demand(share, knots))
                                for w, knots in SCHEDULES.items()])
        pieces.append(F.struct(F.lit(epoch).alias("epoch"), words.alias("words"), position.alias("position")))
    return d.withColumn("pieces", F.filter(F.array(*pieces), lambda p: p["words"] > 0))


def op7(docs: DataFrame) -> DataFrame:
    """Contract columns in training order of first use; documents that the mix
    does not take follow, by their key."""
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    first = F.get(F.col("pieces"), F.lit(0))["position"]
    rest = F.lit(2.0) + F.col("key") / F.lit(2.0 ** 64)
    return assign(docs).select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"),
        F.size("pieces").alias("n_pieces"), first.alias("position"), F.coalesce(first, rest).alias("_order")) \
        .orderBy("_order", "doc_id").drop("_order")


def mix(docs: DataFrame) -> DataFrame:
    """The training mix: the documents' columns, one row per piece in training
    order.  A cut last piece stays whole when at least half of it is taken and
    is left out otherwise, so texts are never changed.  Rows that share id,
    source and text bring their pieces each, with the columns of the smallest."""
    pieces = assign(docs).select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("key").alias("_key"), "size",
        F.explode("pieces").alias("p")).where(F.col("p.words") * 2 >= F.col("size")) \
        .select("_id", "_source", "_key", F.col("p.position").alias("_position"), F.col("p.epoch").alias("_epoch"))
    pieces = materialise(pieces, "mix-pieces")
    # One row per (id, source, text): pieces then match many to one however
    # often a row is repeated.
    key = F.xxhash64(F.lit(SEED), F.col("doc_id"), F.coalesce("text", F.lit("")))
    rows = docs.groupBy(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), key.alias("_k")) \
        .agg(smallest_row(docs).alias("_row"))
    same = (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_d")) \
        & F.col("_source").eqNullSafe(F.col("_s"))
    return pieces.join(rows, same).orderBy("_position", "_id", "_epoch").select("_row.*")
