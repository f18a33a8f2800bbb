"""DuckDB SQL for spans of expressions, for the oracles of the span operators."""

from __future__ import annotations

#: One row for each document: r tells rows apart.
DOCS = "d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents)"


def found(name: str, kind: str, pattern: str, where: str = "true", source: str = "d") -> str:
    """A clause ``name`` with (r, kind, s, e, m): the matches of ``pattern`` with their code points from s to e that meet
    ``where``. The matches and what stands between them give the positions."""
    p = pattern.replace("'", "''")
    return f"""{name}_l AS (SELECT r, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM {source} WHERE regexp_matches(t, '{p}')),
{name}_i AS (SELECT r, m, g, unnest(range(1, len(m) + 1)) AS i FROM {name}_l),
{name}_s AS (SELECT r, m[i] AS m, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM {name}_i),
{name} AS (SELECT r, '{kind}' AS kind, s, s + length(m) AS e, m FROM {name}_s WHERE {where})"""


def joined(order: str) -> str:
    return f"string_agg(kind || ':' || s || ':' || e, ',' ORDER BY {order})"


def place(kinds: list[str]) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(kinds)) + " END"
