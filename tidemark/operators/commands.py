"""The replicated command log: validation, exactly-once application, and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.running import before_max, previous
from ..schema import MAX_KEY_BYTES, MAX_VALUE_BYTES
from . import lww


def problem() -> Column:
    """Why a command is refused, or null; the first rule that fails."""
    key_size = F.octet_length(F.coalesce("key", F.lit("")))
    return (
        F.when(~F.coalesce(F.col("operation").isin("put", "delete"), F.lit(False)), "operation")
        .when((key_size < 1) | (key_size > MAX_KEY_BYTES), "key")
        .when(F.octet_length(F.coalesce("value", F.lit(""))) > MAX_VALUE_BYTES, "value")
        .when(F.coalesce("client_id", F.lit("")) == "", "client")
        .when(F.coalesce("request_seq", F.lit(0)) < 1, "request")
    )


def validate(commands: DataFrame) -> DataFrame:
    return commands.withColumn("problem", problem())


def applied(commands: DataFrame) -> DataFrame:
    """The commands that take effect: those whose request number is above all earlier ones of the client."""
    seen = before_max(commands, ["client_id"], "idx", "request_seq", "_before")
    return seen.filter(F.col("_before").isNull() | (F.col("request_seq") > F.col("_before"))).drop("_before")


def sessions(commands: DataFrame) -> DataFrame:
    """Each client's last request number and how many of its commands were retries."""
    kept = applied(commands).groupBy("client_id").agg(F.count(F.lit(1)).alias("applied"))
    every = commands.groupBy("client_id").agg(F.max("request_seq").alias("last_request"), F.count(F.lit(1)).alias("received"))
    return every.join(kept, "client_id").select("client_id", "last_request", "applied", (F.col("received") - F.col("applied")).alias("retries"))


def state(commands: DataFrame) -> DataFrame:
    """The live state after applying the commands exactly once."""
    log = applied(commands).select("key", "value", F.col("idx").alias("seq"), F.when(F.col("operation") == "delete", 1).otherwise(0).alias("op"))
    return lww.live_state(log)


def batch_state(batches: DataFrame) -> DataFrame:
    """The live state of batches (idx, pos, key, value, op): the newest batch wins, in a batch the first mutation."""
    return lww.live_state(batches.withColumn("seq", F.col("idx")))


def index_gaps(log: DataFrame, applied_index: int = 0) -> DataFrame:
    """Where the index doesn't go on by one: after which index, and how many are missing."""
    idx = log.filter(F.col("idx") > applied_index).select("idx").distinct()
    last = previous(idx, [], "idx", ["idx"]).withColumn("after", F.coalesce("prev_idx", F.lit(applied_index)))
    return last.filter(F.col("idx") != F.col("after") + 1).select("after", F.col("idx").alias("next"), (F.col("idx") - F.col("after") - 1).alias("lost"))


def replayed(log: DataFrame, last_seq: int) -> DataFrame:
    """What a replay takes from the tail: versions above the published sequence."""
    return log.filter(F.col("seq") > last_seq)


def renumbered(log: DataFrame, base: int) -> DataFrame:
    """A tail from before sequence numbers were kept, numbered on from ``base`` in file order (column place)."""
    from ..functions.running import running_sum

    return running_sum(log.withColumn("_one", F.lit(1).cast("long")), [], "place", "_one", "_n").withColumn("seq", F.col("_n") + base).drop("_one", "_n")
