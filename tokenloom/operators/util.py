"""Building blocks shared by several operators.

* ``bounded_broadcast`` - broadcast a side only after proving its row count.
* ``running_total`` - exact running sum in a global order without letting one
  partition key (a hot day, a hot month) land in a single task.
* ``exact_percentiles`` - linear-interpolated percentiles built on the same
  distributed ranking (no per-group value buffers).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.session import checkpoint_root, scratch_path

DEFAULT_BROADCAST_ROWS = 1_000_000


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared scratch folder: computed once, and read
    again from there after an executor is lost (texts are worth "zstd")."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_bounded(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows (a distributed count)."""
    return df.count() <= max_rows


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` if its size is proven small, else ``df`` (shuffle join)."""
    return F.broadcast(df) if is_bounded(df, max_rows) else df


def _slice_count(df: DataFrame, slices: int | None, rows_per_slice: int | None = None) -> int:
    """Explicit ``slices``; else enough slices for ``rows_per_slice`` rows each
    (one count); else the session's shuffle partition count."""
    if slices:
        return slices
    conf = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), 1)
    if rows_per_slice:
        return max(conf, -(-df.count() // rows_per_slice))
    return conf


def running_total(df: DataFrame, value: str, order_cols: list[str],
                  partition_cols: list[str] | tuple = (), out: str = "running",
                  slices: int | None = None, rows_per_slice: int | None = None) -> DataFrame:
    """Add ``out`` = sum of ``value`` over rows up to this one, per ``partition_cols``.

    The rows are range-partitioned on ``partition_cols + order_cols`` so a
    single hot key is split over many slices (and checkpointed, which cuts
    the lineage).  Each slice computes a local
    running sum; a tiny table of slice totals (slices x keys rows) turns
    these into global offsets.  ``order_cols`` must define a total order.
    """
    pcols = list(partition_cols)
    keys = pcols + list(order_cols)
    checkpoint_root(df.sparkSession)
    # Slice ids depend on sampled range bounds, so they are fixed once with a
    # reliable checkpoint: both branches below (and any recomputation after
    # an executor loss) then see the same assignment.
    ranged = df.repartitionByRange(_slice_count(df, slices, rows_per_slice), *keys) \
        .withColumn("_slice", F.spark_partition_id()).checkpoint(eager=True)
    local_w = (Window.partitionBy("_slice", *pcols).orderBy(*order_cols)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranged.withColumn("_local", F.sum(value).over(local_w))
    totals = ranged.groupBy("_slice", *pcols).agg(F.sum(value).alias("_slice_total"))
    prior_w = (Window.partitionBy(*pcols).orderBy("_slice")
               .rowsBetween(Window.unboundedPreceding, -1)) if pcols else \
        Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_slice", *pcols,
                            F.sum("_slice_total").over(prior_w).alias("_offset"))
    # One row per slice and key: small beside the data, so adaptive execution
    # picks the join; keys may be null.
    offsets = offsets.select(F.col("_offset"), *[F.col(c).alias(f"_o_{c}") for c in ["_slice", *pcols]])
    match = F.col("_slice") == F.col("_o__slice")
    for c in pcols:
        match = match & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    joined = local.join(offsets, match, "left").drop(*[f"_o_{c}" for c in ["_slice", *pcols]])
    return joined.withColumn(out, F.col("_local") + F.coalesce(F.col("_offset"), F.lit(0))) \
        .drop("_slice", "_local", "_offset")


def exact_percentiles(df: DataFrame, group_cols: list[str], value_col: str,
                      percentiles: dict[str, float], slices: int | None = None,
                      rows_per_slice: int | None = None) -> DataFrame:
    """Per group, the percentile with linear interpolation between ranks.

    Equal to SQL ``percentile_cont`` / Spark ``percentile`` but never holds
    a group's values in one buffer: ranks come from ``running_total``.
    """
    # Equal values are one row with their count, so ties cost nothing and the
    # ranking shuffles distinct values only.
    data = df.select(*group_cols, F.col(value_col).cast("double").alias("_v")) \
        .where(F.col("_v").isNotNull()).groupBy(*group_cols, "_v").agg(F.count("*").alias("_same"))
    ranked = running_total(data, "_same", ["_v"], group_cols,
                           out="_last", slices=slices, rows_per_slice=rows_per_slice)
    counts = ranked.groupBy(*group_cols).agg(F.sum("_same").alias("_n"))
    specs = F.array(*[F.struct(F.lit(name).alias("pname"), F.lit(float(p)).alias("p"))
                      for name, p in percentiles.items()])
    targets = counts.select(*group_cols, "_n", F.explode(specs).alias("s")).select(
        *group_cols, "s.pname",
        (F.lit(1.0) + (F.col("_n") - 1) * F.col("s.p")).alias("_pos"))
    targets = targets.select(*group_cols, "pname", "_pos",
                             F.floor("_pos").cast("bigint").alias("_lo"),
                             F.ceil("_pos").cast("bigint").alias("_hi"))
    wanted = targets.select(*group_cols, "pname", "_pos", "_lo",
                            F.explode(F.array_distinct(F.array("_lo", "_hi"))).alias("_rank"))
    # Group keys may be null (a task without model): match them null-safely.
    wanted = wanted.select(*[F.col(c).alias(f"_w_{c}") for c in [*group_cols, "_rank"]], "pname", "_pos", "_lo")
    match = (F.col("_w__rank") <= F.col("_last")) & (F.col("_w__rank") > F.col("_last") - F.col("_same"))
    for c in group_cols:
        match = match & F.col(c).eqNullSafe(F.col(f"_w_{c}"))
    picked = ranked.join(bounded_broadcast(wanted), match, "inner")
    # One aggregation per group: for each percentile the value at the lower
    # rank, at the upper rank, and the interpolation position.
    aggs = []
    for name in percentiles:
        mine = F.col("pname") == name
        lo_v = F.max(F.when(mine & (F.col("_w__rank") == F.col("_lo")), F.col("_v")))
        hi_v = F.max(F.when(mine & (F.col("_w__rank") != F.col("_lo")), F.col("_v")))
        frac = F.max(F.when(mine, F.col("_pos") - F.col("_lo")))
        aggs.append((lo_v + frac * (F.coalesce(hi_v, lo_v) - lo_v)).alias(name))
    return picked.groupBy(*group_cols).agg(*aggs)
