"""Registered queries of the engine and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from .plans import bench, chk, cmd, kv, net, raft, st

FAMILIES = (kv, cmd, raft, net, bench, chk, st)


def queries() -> dict[str, Callable]:
    return {name: q for family in FAMILIES for name, q in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}
