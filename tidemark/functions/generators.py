"""Keys, values and workloads for load tests, made on the executors from a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def drawn(seed: int, *of: str) -> Column:
    """A 63-bit number that follows from the seed and the given columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 1)


def key(n: Column, prefix: str = "key", width: int = 9) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))


def value(size: int, seed: int, *of: str) -> Column:
    """``size`` characters that follow from the seed."""
    parts = [F.sha2(F.concat_ws(":", F.lit(f"{seed}:{i}"), *[F.col(c).cast("string") for c in of]), 256) for i in range(-(-size // 64))]
    return F.substring(F.concat(*parts), 1, size)


def sequential(spark: SparkSession, n: int, size: int = 64, seed: int = 1) -> DataFrame:
    """n puts of ascending keys."""
    return spark.range(n).select(key(F.col("id")).alias("key"), value(size, seed, "id").alias("value"), F.lit(0).alias("op"), F.col("id").alias("place"))


def random_keys(spark: SparkSession, n: int, size: int = 64, seed: int = 2) -> DataFrame:
    """n puts of keys drawn from ten times as many."""
    return spark.range(n).select(key(drawn(seed, "id") % (10 * n)).alias("key"), value(size, seed, "id").alias("value"), F.lit(0).alias("op"), F.col("id").alias("place"))


def hot_keys(spark: SparkSession, keys: int = 10, versions: int = 1000) -> DataFrame:
    """A few keys written over and over."""
    return spark.range(keys * versions).select(key(F.col("id") % keys, "hotkey", 2).alias("key"), F.concat(F.lit("val"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("value"), F.lit(0).alias("op"), F.col("id").alias("place"))


def half_deleted(spark: SparkSession, n: int, size: int = 64, seed: int = 6) -> DataFrame:
    """n puts, and then deletes of the half whose draws are even."""
    puts = sequential(spark, n, size, seed)
    gone = puts.filter(drawn(seed, "place") % 2 == 0)
    return puts.unionByName(gone.select("key", F.lit(None).cast("string").alias("value"), F.lit(1).alias("op"), (F.col("place") + n).alias("place")))


def lookups(spark: SparkSession, n: int, keys: int, seed: int = 4) -> DataFrame:
    """n keys to look up, half of which aren't there."""
    draw = drawn(seed, "id")
    return spark.range(n).select(F.when(draw % 2 == 0, key(F.shiftrightunsigned(draw, 1) % keys)).otherwise(key(F.col("id"), "missing")).alias("key"))


def windows(spark: SparkSession, n: int, keys: int, width: int = 100, seed: int = 8) -> DataFrame:
    """n scan windows (id, low, high) of ``width`` keys."""
    start = drawn(seed, "id") % F.greatest(F.lit(1), F.lit(keys - width))
    return spark.range(n).select("id", key(start).alias("low"), key(start + width - 1).alias("high"))
