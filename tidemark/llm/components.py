"""Connected components of a graph of links, by alternating large-star and small-star steps.

Everything stays distributed: a step is an aggregation with map-side combining
and a join. A graph of up to FEW ends of links has no more than these in any task.
In a larger one a hub, which has more than one in SHARE of all ends, is met by a
broadcast: there are SHARE hubs at most, however large the graph, and no task gets
all of a hub's links. Each round is
written to the shared folder, which cuts the lineage, and read in as few parts as
its size asks for. (Kiveris et al., "Connected Components in
MapReduce and Beyond".)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table

MAX_ROUNDS = 100
#: A hub has more than one in so many of all ends of links.
SHARE = 200
#: Ends of links, 16 bytes each, that one task may get.
FEW = 4_000_000


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _least(ends: DataFrame) -> DataFrame:
    """The least ``v`` of each ``u``, and how many ends it has (u, m, n)."""
    return ends.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))


def _met(ends: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``ends`` with ``m``."""
    if total <= FEW:
        return ends.join(least.drop("n"), "u")
    hub = F.col("n") * SHARE > total
    hubs = least.filter(hub).drop("n")
    hot = ends.join(F.broadcast(hubs), "u")
    cold = ends.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.filter(~hub).drop("n"), "u")
    return hot.union(cold)


def connected_components(edges: DataFrame, tables: list[Table] | None = None) -> DataFrame:
    """``edges`` has long columns u and v. Returns node and label (the smallest node of its component) for every
    node that has an edge to another and isn't itself the smallest. The table that holds the result is added to
    ``tables``, to be dropped after use."""
    held = Table(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(held.df)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        e = held.df
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _met(both.filter("v > u"), _least(both), 2 * state[0]).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        low = _least(large)
        small = _met(large, low, state[0]).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        held, old = Table(small, "edges"), held
        old.drop()
        state, before = _state(held.df), state
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    if tables is not None:
        tables.append(held)
    return held.df.select(F.col("u").alias("node"), F.col("v").alias("label"))
