"""Running aggregates along a log, without gathering a whole group in one task.

The log is cut into blocks at quantiles of its order column, whatever its values
are: positions, times or hashes. Each group's aggregate of every block is
computed with map-side combining; the blocks' prefixes follow from that small
table; within a block the running value starts from its prefix. A group that
holds a third of the log is thus spread over all its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import CELLS, cell_of

#: Rows of a block, about; beyond CELLS blocks they grow.
BLOCK = 1_000_000


def block_of(df: DataFrame, order: str, rows: int = BLOCK) -> Column:
    """The number of each row's block. One pass over the order column, which must be a number or a time, with sketches
    of bounded size; the cuts only decide where rows meet, not what results."""
    n, every = df.agg(F.count(order), F.percentile_approx(order, [k / CELLS for k in range(1, CELLS)], 100 * CELLS)).first()
    if n <= rows:
        return F.lit(0)
    step = max(1, CELLS // (n // rows + 1))
    cuts = every[step - 1 :: step]
    return F.coalesce(cell_of(F.col(order), sorted(set(cuts))), F.lit(-1))


def with_prefix(held: DataFrame, prefix: DataFrame, on: list[str], *columns: str, how: str = "inner") -> DataFrame:
    """``held`` with columns of ``prefix``; null groups are groups, too."""
    right = prefix.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(on)], *columns)
    cond = F.lit(True)
    for i, c in enumerate(on):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r{i}"))
    return held.join(right, cond, how).select(*held.columns, *columns)


def before_max(df: DataFrame, group: list[str], order: str, value: str, into: str, block: int = BLOCK) -> DataFrame:
    """``into``: the largest ``value`` of the group's rows before this one (null for the first)."""
    held = df.withColumn("_block", block_of(df, order, block))
    per_block = held.groupBy(*group, "_block").agg(F.max(value).alias("_m"))
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    prefix = per_block.select(*group, "_block", F.max("_m").over(earlier).alias("_before"))
    inner = Window.partitionBy(*group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = with_prefix(held, prefix, [*group, "_block"], "_before")
    return joined.withColumn(into, F.greatest(F.max(value).over(inner), F.col("_before"))).drop("_block", "_before")


def previous(df: DataFrame, group: list[str], order: str, columns: list[str], block: int = BLOCK) -> DataFrame:
    """``prev_<c>`` for each column: its value in the row before, within the group (null for the first)."""
    held = df.withColumn("_block", block_of(df, order, block))
    last = F.struct(order, *columns)
    per_block = held.groupBy(*group, "_block").agg(F.max_by(F.struct(*columns), F.col(order)).alias("_l")) if columns else held.groupBy(*group, "_block").agg(F.max(last).alias("_l"))
    by_block = Window.partitionBy(*group).orderBy("_block")
    edges = per_block.select(*group, "_block", F.lag("_l").over(by_block).alias("_edge"))
    inner = Window.partitionBy(*group, "_block").orderBy(order)
    out = with_prefix(held, edges, [*group, "_block"], "_edge")
    first = F.row_number().over(inner) == 1
    return out.withColumns({f"prev_{c}": F.when(first, F.col("_edge")[c]).otherwise(F.lag(c).over(inner)) for c in columns}).drop("_block", "_edge")


def running_sum(df: DataFrame, group: list[str], order: str, value: str, into: str, block: int = BLOCK) -> DataFrame:
    """``into``: the sum of ``value`` up to and with this row, within the group."""
    held = df.withColumn("_block", block_of(df, order, block))
    per_block = held.groupBy(*group, "_block").agg(F.sum(value).alias("_s"))
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    prefix = per_block.select(*group, "_block", F.sum("_s").over(earlier).alias("_before"))
    inner = Window.partitionBy(*group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = with_prefix(held, prefix, [*group, "_block"], "_before")
    return joined.withColumn(into, F.sum(value).over(inner) + F.coalesce("_before", F.lit(0))).drop("_block", "_before")


def carried(df: DataFrame, group: list[str], order: str, columns: list[str], block: int = BLOCK) -> DataFrame:
    """``last_<c>`` for each column: its last value that isn't null up to and with this row, within the group."""
    held = df.withColumn("_block", block_of(df, order, block))
    newest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_l{i}") for i, c in enumerate(columns)]
    per_block = held.groupBy(*group, "_block").agg(*newest)
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_e{i}" for i in range(len(columns))]
    prefix = per_block.select(*group, "_block", *[F.last(f"_l{i}", ignorenulls=True).over(earlier).alias(n) for i, n in enumerate(names)])
    inner = Window.partitionBy(*group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = with_prefix(held, prefix, [*group, "_block"], *names)
    return out.withColumns({f"last_{c}": F.coalesce(F.last(c, ignorenulls=True).over(inner), F.col(n)) for c, n in zip(columns, names, strict=True)}).drop("_block", *names)
