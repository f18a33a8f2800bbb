"""Queries over the command log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import commands
from ..sources import derived as D


def _flawed(spark, sf):
    """Commands some of which break a rule."""
    c = D.command_log(spark, sf)
    i = F.col("idx")
    return c.select(
        "idx",
        F.when(i % 11 == 0, "merge").when(i % 5 == 0, "delete").otherwise("put").alias("operation"),
        F.when(i % 13 == 0, "").when(i % 101 == 0, F.repeat(F.lit("k"), 16385)).otherwise(F.col("key")).alias("key"),
        F.when(i % 10 == 0, "").otherwise(F.col("value")).alias("value"),
        F.when(i % 17 == 0, F.lit(None)).otherwise(F.col("client_id")).alias("client_id"),
        F.when(i % 19 == 0, 0).otherwise(F.col("request_seq") + 1).alias("request_seq"),
    )


QUERIES = {
    "cmd_dedup": lambda s, d: commands.applied(D.command_log(s, d)).select("idx", "client_id", "request_seq"),
    "cmd_session_state": lambda s, d: commands.sessions(D.command_log(s, d)),
    "cmd_apply_state": lambda s, d: commands.state(D.command_log(s, d)),
    "cmd_validation": lambda s, d: commands.validate(_flawed(s, d)).groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count(F.lit(1)).alias("commands"), F.min("idx").alias("first_idx")),
}

_APPLIED = """b AS (SELECT *, max(request_seq) OVER (PARTITION BY client_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM cmd),
a AS (SELECT * FROM b WHERE m IS NULL OR request_seq > m)"""
_V = D.with_views
ORACLES = {
    "cmd_dedup": _V(_APPLIED + " SELECT idx, client_id, request_seq FROM a", "cmd"),
    "cmd_session_state": _V(_APPLIED + " SELECT c.client_id, max(c.request_seq) AS last_request, (SELECT count(*) FROM a WHERE a.client_id = c.client_id) AS applied, count(*) - (SELECT count(*) FROM a WHERE a.client_id = c.client_id) AS retries FROM cmd c GROUP BY c.client_id", "cmd"),
    "cmd_apply_state": _V(_APPLIED + ", r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx DESC) AS r FROM a) SELECT key, value, idx AS seq FROM r WHERE r = 1 AND operation = 'put'", "cmd"),
    "cmd_validation": _V("""f AS (SELECT idx, CASE WHEN idx % 11 = 0 THEN 'merge' WHEN idx % 5 = 0 THEN 'delete' ELSE 'put' END AS operation,
  CASE WHEN idx % 13 = 0 THEN '' WHEN idx % 101 = 0 THEN repeat('k', 16385) ELSE key END AS key, CASE WHEN idx % 10 = 0 THEN '' ELSE value END AS value,
  CASE WHEN idx % 17 = 0 THEN NULL ELSE client_id END AS client_id, CASE WHEN idx % 19 = 0 THEN 0 ELSE request_seq + 1 END AS request_seq FROM cmd),
p AS (SELECT idx, CASE WHEN operation NOT IN ('put', 'delete') THEN 'operation' WHEN strlen(key) NOT BETWEEN 1 AND 16384 THEN 'key'
  WHEN client_id IS NULL THEN 'client' WHEN request_seq < 1 THEN 'request' ELSE 'none' END AS problem FROM f)
SELECT problem, count(*) AS commands, min(idx) AS first_idx FROM p GROUP BY problem""", "cmd"),
}
