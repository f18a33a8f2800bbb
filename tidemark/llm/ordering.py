"""The predecessor of every row in a total order, in one pass over the rows and without a global window.

Rows are dealt into ranges of the key, many to a partition. The row before a
range's first row is the last of the nearest filled range below, so just that
row (one for each range) is sent to a second place. Bounds come from a sketch
of the keys; they decide balance, never results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges dealt to each shuffle partition, so that hashing ranges to partitions comes out even.
RANGES_PER_PARTITION = 4


def range_of(key: Column, bounds: list, of_null: Column) -> Column:
    """How many bounds lie at or below ``key``, by binary search in an array literal; ``of_null`` for null keys."""
    if not bounds:
        return F.when(key.isNull(), of_null).otherwise(0)
    tree = lambda lo, hi: F.lit(lo) if lo == hi else F.when(key < bounds[mid := (lo + hi) // 2], tree(lo, mid)).otherwise(tree(mid + 1, hi))
    return F.when(key.isNull(), of_null).otherwise(tree(0, len(bounds)))


def dealt_in_order(df: DataFrame, key: str, ties: list[Column]) -> DataFrame:
    """``df`` with ``_range`` and ``_carried``, in partitions that hold whole ranges sorted by
    (range, carried first, key, ties). A carried row belongs to the range below; it is only there to be
    looked back at. Null keys stand before all others, dealt to ranges by their first tie, a hash. The order is a ring: the row before the first is the
    last. Every range that has rows has a carried row (equal rows may give equal ones)."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = parts * RANGES_PER_PARTITION
    found = df.stat.approxQuantile(key, [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    bounds = sorted({int(b) for b in found})
    hashed = F.least(F.floor((ties[0].cast("double") / 2.0**64 + 0.5) * n), F.lit(n - 1)) - n
    keyed = df.withColumn("_range", range_of(F.col(key), bounds, hashed).cast("int"))
    tied = [t.alias(f"t{i}") for i, t in enumerate(ties)]
    edges = keyed.groupBy("_range").agg(F.max(F.struct(F.col(key).alias("key"), *tied)).alias("last")).orderBy("_range").collect()  # a row for each range
    rows = [(edges[i - 1]["_range"], e["_range"], *edges[i - 1]["last"]) for i, e in enumerate(edges)]
    kinds = keyed.select(F.col(key).alias("key"), *tied).dtypes
    schema = "_from int, _to int, " + ", ".join(f"{k} {v}" for k, v in kinds)
    small = F.broadcast(spark.createDataFrame(rows, schema))  # as many rows as ranges: bounded by the partitions
    on = (F.col("_range") == F.col("_from")) & F.col(key).eqNullSafe(F.col("key"))
    for i, t in enumerate(ties):
        on &= t.eqNullSafe(F.col(f"t{i}"))
    carried = keyed.join(small, on, "inner").select(*df.columns, F.col("_to").alias("_range"), F.lit(True).alias("_carried"))
    all_rows = keyed.withColumn("_carried", F.lit(False)).unionByName(carried)
    return all_rows.repartition(parts, "_range").sortWithinPartitions("_range", F.col("_carried").desc(), F.col(key).asc_nulls_first(), *[t.asc_nulls_first() for t in ties])

