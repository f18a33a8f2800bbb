"""Event-time windows over operation streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def throughput(ops: DataFrame, size: str, lateness: str) -> DataFrame:
    """Counts and failures by half-open tumbling window of the time at which an operation was done; later ones than
    ``lateness`` are dropped."""
    return (
        ops.withWatermark("done", lateness)
        .groupBy(F.window("done", size))
        .agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).alias("retries"))
        .select(F.col("window.start").alias("start"), "succeeded", "failed", "retries")
    )


def sessions(ops: DataFrame, gap: str, lateness: str) -> DataFrame:
    """Bursts of each client's operations, parted by at least ``gap``."""
    return ops.withWatermark("done", lateness).groupBy("client", F.session_window("done", gap)).agg(F.count(F.lit(1)).alias("operations")).select("client", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "operations")
