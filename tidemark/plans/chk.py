"""Queries of report checks and string predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks
from ..sources import derived as D


def _arms(spark, sf):
    """Declared arms with commits, and what was found: one missing, one undeclared, one of another commit."""
    base = D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    arm = F.concat(F.lit("arm"), F.col("id").cast("string"))
    sha = F.sha1(F.col("id").cast("string").cast("binary"))
    declared = base.filter("id % 7 <> 0").select(arm.alias("arm"), F.upper(sha).alias("commit"))
    found = base.filter("id % 5 <> 0").select(arm.alias("arm"), F.when(F.col("id") % 11 == 0, F.reverse(sha)).otherwise(F.concat(F.lit(" "), F.substring(sha, 1, 9))).alias("found"))
    return declared, found


def _fields(spark, sf):
    e = D.table(spark, sf, "events")
    return e.select(F.when(F.col("event_id") % 50 == 0, " ").otherwise(F.col("event_type")).alias("filesystem"), F.when(F.col("event_id") % 77 == 0, "unknown").when(F.col("event_id") % 91 == 0, " unknown").when(F.col("event_id") % 95 == 0, "\t").otherwise("linux").alias("os"), F.col("user_id").alias("cpu_count"))


def _lists():
    return F.concat_ws(",", F.col("event_type"), F.concat(F.lit("  "), F.col("user_id").cast("string"), F.lit(" ")), F.lit(""), F.lit(" "), F.col("event_id").cast("string"))

QUERIES = {
    "chk_privacy_scan": lambda s, d: checks.privacy(D.table(s, d, "documents"), "doc_id", "text"),
    "chk_required_fields": lambda s, d: checks.required(_fields(s, d), ["filesystem", "os", "cpu_count"]),
    "chk_arm_match": lambda s, d: checks.arm_match(*_arms(s, d)),
    "chk_list_parse": lambda s, d: D.table(s, d, "events").select("event_id", F.array_join(checks.parsed_list(_lists()), "|").alias("parts")),
    "chk_validity": lambda s, d: checks.validity(D.runs(s, d).withColumn("elections", F.when(F.col("rep") % 49 == 0, 1).otherwise(0)).withColumn("valid", F.when((F.col("arm") == "view") & (F.col("rep") % 7 == 0), F.lit(None)).otherwise(F.col("valid"))), "arm", "clients"),
    "chk_protocol": lambda s, d: D.table(s, d, "events").select("event_id", checks.protocol(F.col("event_id") % 7, F.when(F.col("event_id") % 11 > 0, F.col("event_id") % 40), F.col("event_id") % 6).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n")),
    "chk_failure_class": lambda s, d: D.table(s, d, "events").select(checks.failure_class(F.concat(F.lit("rpc: "), F.element_at(F.array(*map(F.lit, ("Deadline exceeded", "connection refused", "context canceled", "EOF"))), (F.col("event_id") % 4 + 1).cast("int")))).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n")),
    "chk_voters": lambda s, d: D.table(s, d, "events").select("event_id", F.coalesce(F.array_join(checks.normal_voters(F.array(F.col("user_id") % 5, F.col("event_id") % 5, F.col("event_id") % 3)), ","), F.lit("refused")).alias("voters")),
}

_V = D.with_views
ORACLES = {
    "chk_privacy_scan": r"""WITH f AS (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(text, '\b\d{1,3}(?:\.\d{1,3}){3}\b')), lambda x: list_max([CAST(p AS INT) FOR p IN string_split(x, '.')]) <= 255 AND NOT regexp_matches(x, '(^|\.)0\d')) AS v4,
  list_filter(list_distinct(regexp_extract_all(text, '[0-9A-Fa-f:]*:[0-9A-Fa-f:]*')), lambda x: regexp_full_match(x, '([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}') OR (regexp_full_match(x, '([0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4})*)?::([0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4})*)?') AND len(list_filter(string_split(x, ':'), lambda g: g <> '')) <= 7)) AS v6,
  list_distinct(regexp_extract_all(text, '(?:/home/|/Users/)[^/"\s\\]+|/root(?:/|"|$)')) AS h FROM documents),
g AS (SELECT doc_id, len(v4) AS ipv4, len(v6) AS ipv6, len(h) AS homes, len(list_filter(v4 || v6, lambda x: starts_with(x, '127.') OR x = '0.0.0.0' OR regexp_full_match(x, '[0:]*:0{0,3}[01]|::'))) AS loopback FROM f)
SELECT *, CASE WHEN ipv4 + ipv6 > loopback OR homes > 0 THEN 'FAIL' WHEN loopback > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM g""",
    "chk_required_fields": """WITH f AS (SELECT CASE WHEN event_id % 50 = 0 THEN ' ' ELSE event_type END AS filesystem, CASE WHEN event_id % 77 = 0 THEN 'unknown' WHEN event_id % 91 = 0 THEN ' unknown' WHEN event_id % 95 = 0 THEN chr(9) ELSE 'linux' END AS os, CAST(user_id AS VARCHAR) AS cpu_count FROM events),
u AS (SELECT 'filesystem' AS field, filesystem AS v FROM f UNION ALL SELECT 'os', os FROM f UNION ALL SELECT 'cpu_count', cpu_count FROM f)
SELECT field, count(*) FILTER (WHERE v IS NULL OR v = 'unknown' OR NOT regexp_matches(v, '\\S')) AS missing, CASE WHEN count(*) FILTER (WHERE v IS NULL OR v = 'unknown' OR NOT regexp_matches(v, '\\S')) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM u GROUP BY field""",
    "chk_arm_match": """WITH s AS (SELECT s_suppkey AS id, 'arm' || CAST(s_suppkey AS VARCHAR) AS arm, sha1(CAST(s_suppkey AS VARCHAR)) AS sha FROM supplier),
d AS (SELECT arm, sha AS c FROM s WHERE id % 7 <> 0), f AS (SELECT arm, CASE WHEN id % 11 = 0 THEN reverse(sha) ELSE left(sha, 9) END AS x FROM s WHERE id % 5 <> 0)
SELECT coalesce(d.arm, f.arm) AS arm, CASE WHEN x IS NULL THEN 'missing' WHEN c IS NULL THEN 'undeclared' WHEN starts_with(c, x) THEN 'ok' ELSE 'other commit' END AS status FROM d FULL JOIN f ON d.arm = f.arm""",
    "chk_list_parse": "SELECT event_id, event_type || '|' || CAST(user_id AS VARCHAR) || '|' || CAST(event_id AS VARCHAR) AS parts FROM events",
    "chk_validity": _V("v AS (SELECT arm, clients, CASE WHEN arm = 'view' AND rep % 7 = 0 THEN NULL ELSE valid END AS valid, CASE WHEN rep % 49 = 0 THEN 1 ELSE 0 END AS elections FROM runs), g AS (SELECT arm, clients, count(*) AS runs, count(valid) AS judged, count(*) FILTER (WHERE NOT valid) AS invalid, count(*) FILTER (WHERE NOT valid AND elections > 0) AS by_election FROM v GROUP BY arm, clients) SELECT *, CASE WHEN judged < runs OR by_election > 0 THEN 'FAIL' WHEN invalid > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM g", "runs"),
    "chk_protocol": "WITH p AS (SELECT event_id % 7 AS w, CASE WHEN event_id % 11 > 0 THEN event_id % 40 END AS d, event_id % 6 AS r FROM events) SELECT CASE WHEN d IS NULL THEN 'FAIL' WHEN w = 5 AND d = 30 AND r = 5 THEN 'PASS' ELSE 'WARN' END AS status, count(*) AS n FROM p GROUP BY 1",
    "chk_failure_class": "SELECT CASE WHEN event_id % 4 = 0 THEN 'deadline' ELSE 'other' END AS class, count(*) AS n FROM events GROUP BY 1",
    "chk_voters": "WITH v AS (SELECT event_id, [user_id % 5, event_id % 5, event_id % 3] AS v FROM events) SELECT event_id, CASE WHEN len(list_distinct(v)) = 3 AND list_min(v) > 0 THEN array_to_string(list_sort(v), ',') ELSE 'refused' END AS voters FROM v",
}
