"""Joins on ranges, by cutting the key space at sampled points.

An interval is dealt to every cell that it touches, a point to its one cell;
rows then meet in an equi-join on the cell, so that no join is a nested loop.
Cells only decide where rows meet: results don't depend on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 256


def cut_points(points: DataFrame, column: str, cells: int = CELLS) -> list:
    """Up to ``cells`` - 1 values that split the column's rows about evenly: order statistics of the rows whose
    hashes are lowest. What comes to the driver is bounded by 16 rows a cell."""
    least = points.select(F.col(column).alias("p")).filter(F.col("p").isNotNull()).distinct().orderBy(F.xxhash64("p")).limit(16 * cells).collect()
    found = sorted(r["p"] for r in least)
    step = max(1, len(found) // cells)
    return found[step::step][: cells - 1]


def cell_of(value: Column, cuts: list) -> Column:
    """The number of cuts at or below the value, by binary search."""
    tree = lambda lo, hi: F.lit(lo) if lo == hi else F.when(value < F.lit(cuts[mid := (lo + hi) // 2]), tree(lo, mid)).otherwise(tree(mid + 1, hi))
    return tree(0, len(cuts))


def point_in_interval(points: DataFrame, point: str, intervals: DataFrame, low: str, high: str) -> DataFrame:
    """Pairs with low <= point <= high. Column names of both sides must differ."""
    cuts = cut_points(intervals, low)
    p = points.withColumn("_cell", cell_of(F.col(point), cuts))
    i = intervals.filter(F.col(low) <= F.col(high)).withColumn("_cell", F.explode(F.sequence(cell_of(F.col(low), cuts), cell_of(F.col(high), cuts))))
    return p.join(i, "_cell").filter(F.col(point).between(F.col(low), F.col(high))).drop("_cell")


def overlapping(intervals: DataFrame, ident: str, low: str, high: str) -> DataFrame:
    """Pairs (left_id, right_id), left_id < right_id, of intervals with a point in common (touching counts)."""
    cuts = cut_points(intervals, low)
    base = intervals.select(F.col(ident).alias("id"), F.col(low).alias("lo"), F.col(high).alias("hi")).withColumn("first", cell_of(F.col("lo"), cuts)).withColumn("last", cell_of(F.col("hi"), cuts))
    dealt = base.withColumn("_cell", F.explode(F.sequence("first", "last")))
    a = dealt.select("_cell", *[F.col(c).alias(f"a_{c}") for c in ("id", "lo", "hi", "first")])
    b = dealt.select("_cell", *[F.col(c).alias(f"b_{c}") for c in ("id", "lo", "hi", "first")])
    on = (F.col("a_id") < F.col("b_id")) & (F.col("a_lo") <= F.col("b_hi")) & (F.col("b_lo") <= F.col("a_hi"))
    met = a.join(b, "_cell").filter(on)
    once = met.filter(F.col("_cell") == F.greatest("a_first", "b_first"))  # a pair meets in several cells
    return once.select(F.col("a_id").alias("left_id"), F.col("b_id").alias("right_id"))
