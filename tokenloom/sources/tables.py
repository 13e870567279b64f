"""Readers for the parquet tables (column-pruned, filters pushed to the scan)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Scan one table; naming the columns keeps ``ReadSchema`` narrow."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Task table written by ``plans.sinks.append_tasks`` (partitioned by
    ``created_date``).  Files from before ``task_type`` existed are merged
    by schema and their type defaults to completion."""
    from pyspark.sql import functions as F
    df = spark.read.option("mergeSchema", "true").parquet(path)
    if "task_type" not in df.columns:
        df = df.withColumn("task_type", F.lit(None).cast("string"))
    return df.withColumn("task_type", F.when(F.col("task_type").isNull() | (F.col("task_type") == ""),
                                             F.lit("completion")).otherwise(F.col("task_type")))


def read_vector_json(spark: SparkSession, path: str) -> DataFrame:
    """Vector rows stored with the vector as JSON text; missing or malformed
    JSON decodes to an empty array."""
    from tokenloom.operators.vectors import decode_vectors
    return decode_vectors(spark.read.parquet(path))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread rows over at least the cluster's parallelism when the input has
    fewer partitions (a small file feeding CPU-heavy per-row work such as
    regex screening).  Large inputs already have more splits than cores, so
    for them this is a no-op and adds no shuffle."""
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want)
