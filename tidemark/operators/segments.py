"""Sorted segments: what each covers, which ones a read needs, and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import overlapping
from . import lww


def stats(log: DataFrame) -> DataFrame:
    """Bounds and counts of each segment, as kept in a manifest."""
    return log.groupBy("seg").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count(F.lit(1)).alias("records"), F.countDistinct("key").alias("keys"), F.max("seq").alias("max_seq"))


def overlaps(log: DataFrame) -> DataFrame:
    """Pairs of segments whose key ranges meet."""
    bounds = log.groupBy("seg").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    return overlapping(bounds, "seg", "lo", "hi")


def needed(log: DataFrame, low: str, high: str) -> DataFrame:
    """Segments that can hold a key from ``low`` to ``high``."""
    return stats(log).filter((F.col("min_key") <= high) & (F.col("max_key") >= low)).select("seg", "min_key", "max_key")


def newest_per_segment(log: DataFrame) -> DataFrame:
    """Each segment's newest version of each key."""
    won = log.groupBy("seg", "key").agg(F.max_by(F.struct("value", "op", "seq"), lww.newest_first(log)).alias("w"))
    return won.select("seg", "key", "w.value", "w.op", "w.seq")


def merge(log: DataFrame, drop_tombstones: bool) -> DataFrame:
    """One sorted run from all segments. Tombstones may go only if every segment takes part."""
    merged = lww.winners(log)
    return (merged.filter("op = 0") if drop_tombstones else merged).orderBy("key")


def amplification(log: DataFrame) -> DataFrame:
    """Records before and after a full compaction."""
    per_key = lww.winners(log)
    after = per_key.agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("op") == 0).alias("live"))
    before = log.agg(F.count(F.lit(1)).alias("records"), F.countDistinct("seg").alias("segments"))
    one = F.broadcast(after)  # a single row
    return before.crossJoin(one).select("records", "segments", "keys", "live", (F.col("segments") + 1).alias("read_amp"), F.round(F.col("records") / F.col("live"), 6).alias("space_amp"))
