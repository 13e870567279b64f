"""Table writers.  Keyed tables are never overwritten in place while being
read: a job writes a new snapshot folder (or overwrites only the partitions
it recomputed, with dynamic partition overwrite)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_usage(usage: DataFrame, path: str) -> None:
    """Usage table partitioned by ``period_date``; recomputed days replace
    their partitions (dynamic partition overwrite), other days stay."""
    usage.repartition("period_date").write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("period_date").parquet(path)


def read_usage(spark, path: str, date_from=None, date_to=None) -> DataFrame:
    """Scan the usage table; date bounds become partition filters."""
    df = spark.read.parquet(path)
    if date_from is not None:
        df = df.where(F.col("period_date") >= F.lit(date_from))
    if date_to is not None:
        df = df.where(F.col("period_date") <= F.lit(date_to))
    return df


def append_tasks(tasks: DataFrame, path: str) -> None:
    """Append task rows, partitioned by creation day."""
    tasks.withColumn("created_date", F.to_date("created_at")) \
        .write.mode("append").partitionBy("created_date").parquet(path)
