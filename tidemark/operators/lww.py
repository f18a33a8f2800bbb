"""Reads over mutation logs: the newest version of a key wins, and a delete is a version.

A log has columns key, value, seq, op (0 put, 1 delete), and may have pos, the place
within a batch: where versions share a sequence number, the first one stays.
Keys compare as bytes. Every reduction is an aggregation with map-side
combining, so a hot key costs its tasks one row each in the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys of a multi-get that are broadcast; more are shuffled.
BROADCAST_KEYS = 100_000


def newest_first(log: DataFrame) -> Column:
    """What the winner of a key has the largest of: sequence, then (negated) place in its batch."""
    return F.struct(F.col("seq"), -F.col("pos")) if "pos" in log.columns else F.col("seq")


def winners(log: DataFrame) -> DataFrame:
    """The newest version of each key, deletes too: key, value, seq, op."""
    won = log.groupBy("key").agg(F.max_by(F.struct("value", "op", "seq"), newest_first(log)).alias("w"))
    return won.select("key", "w.value", "w.seq", "w.op")


def live_state(log: DataFrame) -> DataFrame:
    """key, value and seq of every key whose newest version is a put (of null, too)."""
    return winners(log).filter("op = 0").drop("op")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The live state after ``seq``. An extension: nothing reads old versions but this."""
    return live_state(log.filter(F.col("seq") <= seq))


def get(log: DataFrame, key: str) -> DataFrame:
    return live_state(log.filter(F.col("key") == key))


def scan(log: DataFrame, low: str, high: str) -> DataFrame:
    """Live keys from ``low`` to ``high``, both included, in order. Nothing if low > high."""
    return live_state(log.filter(F.col("key").between(low, high))).orderBy("key")


def multi_get(log: DataFrame, keys: DataFrame | Iterable[str]) -> DataFrame:
    """The live state of the given keys. A list of keys is bounded by the caller and is broadcast up to
    BROADCAST_KEYS; a frame of keys is joined as its size allows."""
    if not isinstance(keys, DataFrame):
        rows = [(k,) for k in set(keys)]
        frame = log.sparkSession.createDataFrame(rows, "key string")
        keys = F.broadcast(frame) if len(rows) <= BROADCAST_KEYS else frame
    return live_state(log.join(keys, "key", "left_semi"))


def present(keys: DataFrame, log: DataFrame) -> DataFrame:
    return keys.join(live_state(log), "key", "left_semi")


def missing(keys: DataFrame, log: DataFrame) -> DataFrame:
    return keys.join(live_state(log), "key", "left_anti")


def tombstones(log: DataFrame) -> DataFrame:
    return winners(log).filter("op = 1").select("key", "seq")


def history(log: DataFrame) -> DataFrame:
    """Every version with its age (1: the newest) among its key's: counted by blocks of the log, so that a hot key's
    versions aren't in one task. In batches, versions of one sequence number count from the last place to the first."""
    from ..functions.running import running_sum

    order = (F.col("seq").cast("decimal(38,0)") * (1 << 31) - F.col("pos")) if "pos" in log.columns else F.col("seq")
    counted = running_sum(log.withColumns({"_order": order, "_one": F.lit(1).cast("long")}), ["key"], "_order", "_one", "_n")
    total = log.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("_all"))
    met = counted.join(total, F.col("key").eqNullSafe(F.col("_key")))
    return met.withColumn("age", F.col("_all") - F.col("_n") + 1).select(*log.columns, "age")


def version_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("key").agg(F.count(F.lit(1)).alias("versions"), F.sum(F.col("op").cast("long")).alias("deletes"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def range_scans(log: DataFrame, windows: DataFrame) -> DataFrame:
    """For many windows (id, low, high) the live keys of each: one merge, then a range join."""
    from ..functions.ranges import point_in_interval

    return point_in_interval(live_state(log), "key", windows, "low", "high").select("id", "key", "value", "seq")
