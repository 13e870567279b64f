"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (registers pa.compute)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from tokenloom.session import scratch_path

# The white space that separates words everywhere in this subpackage.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def words_of(text: Column) -> Column:
    """Maximal runs of non-space characters, in order (null text: none)."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")) \
        .otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def word_count(text: Column) -> Column:
    """Number of words, without building the word array."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared scratch folder and reread: cuts the lineage at a
    table that every executor can read again after a loss."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def orderable(kind: DataType) -> bool:
    """Whether Spark can compare values of a type."""
    if isinstance(kind, StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return orderable(kind.elementType)
    return not isinstance(kind, (MapType, VariantType))


def smallest_row(df: DataFrame) -> Column:
    """Aggregate: the smallest row (as a struct of all columns).  Columns whose
    values can't be compared only decide, as JSON, after all others."""
    row = F.struct(*[df[c] for c in df.columns])
    rest = [f.name for f in df.schema.fields if not orderable(f.dataType)]
    if not rest:
        return F.min(row)
    order = [df[c] for c in df.columns if c not in rest]
    return F.min_by(row, F.struct(*order, F.to_json(F.struct(*[df[c] for c in rest]))))


def with_field(df: DataFrame, name: str, kind: str) -> str:
    """DDL of the frame's schema and one more column."""
    return df.schema.simpleString()[7:-1] + f",{name}:{kind}"


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch holding about ``max_bytes`` of ``column``
    (one row at least), so working memory follows neither batch nor table size."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0) \
        .to_numpy(zero_copy_only=False)
    if len(lengths) == 0:
        return
    group = (np.cumsum(lengths, dtype=np.int64) - lengths) // max_bytes
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for start, stop in zip(starts, [*starts[1:], len(lengths)]):
        yield batch.slice(int(start), int(stop - start))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (wrapping 64-bit arithmetic)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_sums(df: DataFrame, value: str, group: list[str], order: list[str], label: str,
                out: str = "offset") -> DataFrame:
    """Add ``out`` = sum of ``value`` (long, not null) over the group's earlier rows.

    Rows are dealt by range of (group, order), so a hot group spreads over many
    tasks; each task sums its own run and is written to the shared folder, and
    a table of one row per (task, group) supplies the offsets.  Null groups are
    a group.  ``order`` should be total up to fully equal rows."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, *order]
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys) \
        .withColumn("_slice", F.spark_partition_id())

    def local(batches):
        last, carry = None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            v = batch.column(value).to_numpy(zero_copy_only=False)
            before = np.cumsum(v) - v
            fresh = np.zeros(batch.num_rows, dtype=bool)
            for g in group:
                col = batch.column(g)
                if batch.num_rows > 1:
                    a, b = col.slice(0, batch.num_rows - 1), col.slice(1)
                    same = pa.compute.if_else(
                        pa.compute.or_(a.is_null(), b.is_null()),
                        pa.compute.and_(a.is_null(), b.is_null()), pa.compute.equal(a, b))
                    fresh[1:] |= ~same.to_numpy(zero_copy_only=False)
            first = tuple(batch.column(g)[0].as_py() for g in group)
            if first != last:
                carry = 0
            starts = np.flatnonzero(np.r_[True, fresh[1:]])
            run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, batch.num_rows]))
            base = before[starts].copy()
            base[0] -= carry
            result = before - base[run]
            last = tuple(batch.column(g)[batch.num_rows - 1].as_py() for g in group)
            carry = int(result[-1] + v[-1])
            yield batch.append_column("_before", pa.array(result.astype(np.int64)))

    schema = with_field(ranged, "_before", "long")
    runs = materialise(ranged.mapInArrow(local, schema), label)
    total = runs.groupBy("_slice", *group).agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    earlier = earlier.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(total.select(
        F.col("_slice").alias("_s"), *[F.col(g).alias(f"_g_{g}") for g in group],
        F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset")), label + "-offsets")
    match = F.col("_slice") == F.col("_s")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return runs.join(offsets, match, "left").select(
        *df.columns, (F.col("_before") + F.coalesce("_offset", F.lit(0))).alias(out))
