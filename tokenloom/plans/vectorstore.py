"""The keyed vector table as a versioned store (snapshots, splitting buckets).

The stored sequence of each winning version stays with the row, so merges order
versions exactly in whatever order batches arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators.vectors import upsert_vectors
from tokenloom.plans.versioned import MAX_ROWS, VersionedStore
from tokenloom.schemas import VECTOR_KEY

TABLE = "vectors"


def create_vectors(spark: SparkSession, root: str, vectors: DataFrame, max_rows: int = MAX_ROWS) -> VersionedStore:
    """Version 1 of a vector table (keys must be unique)."""
    seq = F.col("seq") if "seq" in vectors.columns else F.lit(-1)
    return VersionedStore.create(spark, root, {TABLE: vectors.withColumn("seq", seq.cast("bigint"))}, VECTOR_KEY,
                                 max_rows)


def merge_vectors(store: VersionedStore, batch: DataFrame, source: str | None = None,
                  number: int | None = None) -> int:
    """Keyed upsert of ``batch``; returns the version that holds it."""
    def combine(current: dict[str, DataFrame]) -> dict[str, DataFrame]:
        return {TABLE: upsert_vectors(current[TABLE], batch, keep_seq=True)}

    return store.merge(batch, combine, source, number)


def read_vectors(store: VersionedStore, version: int | None = None) -> DataFrame:
    return store.read(TABLE, version).drop("seq")
