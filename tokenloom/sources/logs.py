"""Request-log files as a source: one line per call, parsed into a call log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators.entities import format_call_log, parse_call_log


def read_call_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Read log files (any number, split by Spark) -> (calls, rejected lines)."""
    parsed = parse_call_log(spark.read.text(path))
    calls = parsed.where("parsed").drop("parsed", "rejected_line")
    rejects = parsed.where(~F.col("parsed")).select(F.col("rejected_line").alias("value"))
    return calls, rejects


def write_call_log(priced_calls: DataFrame, path: str) -> None:
    """Render calls as log lines into text files (the inverse of ``read_call_log``)."""
    format_call_log(priced_calls).write.mode("overwrite").text(path)
