"""Logs in the engine's shapes, derived from the star-schema tables that come as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mutation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, value, seq, op, seg) from events: a user's latest event is its value, errors are deletes."""
    error = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("key"),
        F.when(~error, F.col("props")).alias("value"),
        (F.col("event_id") + 1).alias("seq"),
        F.when(error, 1).otherwise(0).alias("op"),
        F.floor(F.col("event_id") / SEGMENT_ROWS).cast("long").alias("seg"),
    )


def banded_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like ``mutation_log`` with keys that grow with the sequence, so that segments cover separate ranges."""
    banded = F.lpad(F.floor(F.col("event_id") / 3).cast("long").cast("string"), 9, "0")
    log = table(spark, sf_dir, "events")
    return log.select(banded.alias("key"), F.when(F.col("event_type") != "error", F.col("props")).alias("value"), (F.col("event_id") + 1).alias("seq"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("op"), F.floor(F.col("event_id") / SEGMENT_ROWS).cast("long").alias("seg"))


def batch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, pos, key, value, op): batches of a hundred mutations that share one index."""
    error = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        (F.floor(F.col("event_id") / 100) + 1).cast("long").alias("idx"),
        (F.col("event_id") % 100).cast("int").alias("pos"),
        F.col("user_id").cast("string").alias("key"),
        F.when(~error, F.col("props")).alias("value"),
        F.when(error, 1).otherwise(0).alias("op"),
    )


def command_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, client_id, request_seq, key, value, operation) from events."""
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("idx"),
        F.col("user_id").cast("string").alias("client_id"),
        F.floor("value").cast("long").alias("request_seq"),
        (F.col("user_id") % 50).cast("string").alias("key"),
        F.col("props").alias("value"),
        F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("operation"),
    )


def replica_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, idx, term, bytes): three replicas' logs; the third has other terms at some indexes."""
    nodes = F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("node")
    return (
        table(spark, sf_dir, "events")
        .select(nodes, (F.col("event_id") + 1).alias("idx"), "event_id", "props")
        .select(
            F.col("node").cast("long").alias("node"),
            "idx",
            (1 + F.floor(F.col("event_id") / 2500) + F.when((F.col("node") == 3) & (F.col("idx") % 997 == 0), 1).otherwise(0)).cast("long").alias("term"),
            F.length("props").cast("long").alias("bytes"),
        )
    )


def match_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, peer, matched): how far each peer's log is known to match, by group."""
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("grp"), F.col("event_type").alias("peer")).agg(F.max("event_id").alias("matched"))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(client, done, latency, ok, attempts): a load generator's operations."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 4).alias("client"),
        F.col("ts").cast("timestamp").alias("done"),
        F.col("value").alias("latency"),
        (F.col("event_type") != "error").alias("ok"),
        (1 + F.col("event_id") % 3).alias("attempts"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arm, clients, rep, valid, throughput): benchmark runs, with an offset that sets some arms apart."""
    arm = F.col("event_type")
    offset = F.when(arm == "view", 1000.0).when(arm == "click", 0.0).otherwise(20.0)
    return table(spark, sf_dir, "events").select(
        arm.alias("arm"),
        F.element_at(F.array(F.lit(1), F.lit(4), F.lit(16)), (F.col("user_id") % 3 + 1).cast("int")).cast("long").alias("clients"),
        F.col("event_id").alias("rep"),
        (F.col("event_id") % 7 != 0).alias("valid"),
        (F.col("value") + offset).alias("throughput"),
        (F.col("value") / 4).alias("p50"),
        (F.col("value") / 2).alias("p99"),
        (F.col("event_id") % 17 / 16.0).alias("syncs"),
        (1.0 + F.col("event_id") % 5).alias("per_sync"),
        (2 + F.col("event_id") % 9 / 8.0).alias("appends"),
        (F.col("event_id") % 9 / 16.0).alias("ack_resends"),
        F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 4).cast("double").alias("send_deadline"),
        F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 2).cast("double").alias("send_other"),
        F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 4 > 1).alias("failover_ok"),
        (F.col("value") + 5).alias("failover_ms"),
        (F.col("value") + 1).alias("after_close_ms"),
        F.when(F.col("event_id") % 1000 == 0, "secondary").otherwise("official").alias("label"),
    )


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, boundary, origin, value): counter readings before (N) and after (others) a window."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_suppkey") % 3).alias("node"), F.when(F.col("l_returnflag") == "N", "before").otherwise("after").alias("boundary"), F.concat(F.lit("append_messages{origin="), F.lower("l_linestatus"), F.lit("}")).alias("name"))
        .agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("value"))
    )


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, tick, role, term, commit_index, last_index): successive statuses of three nodes."""
    role = F.when(F.col("event_type") == "error", "candidate").when(F.col("event_type") == "purchase", "leader").otherwise("follower")
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") % 3 + 1).alias("node"),
        F.col("event_id").alias("tick"),
        role.alias("role"),
        (1 + F.floor(F.col("event_id") / 2500)).cast("long").alias("term"),
        (F.col("event_id") - F.col("user_id") % 10).alias("commit_index"),
        (F.col("event_id") + F.col("user_id") % 7).alias("last_index"),
    )


# --- the same in DuckDB SQL, for oracles -------------------------------------

SQL = {
    "mlog": "mlog AS (SELECT CAST(user_id AS VARCHAR) AS key, CASE WHEN event_type <> 'error' THEN props END AS value, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS op, event_id // 1000 AS seg FROM events)",
    "banded": "banded AS (SELECT lpad(CAST(event_id // 3 AS VARCHAR), 9, '0') AS key, CASE WHEN event_type <> 'error' THEN props END AS value, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS op, event_id // 1000 AS seg FROM events)",
    "batches": "batches AS (SELECT event_id // 100 + 1 AS idx, event_id % 100 AS pos, CAST(user_id AS VARCHAR) AS key, CASE WHEN event_type <> 'error' THEN props END AS value, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS op FROM events)",
    "cmd": "cmd AS (SELECT event_id + 1 AS idx, CAST(user_id AS VARCHAR) AS client_id, CAST(floor(value) AS BIGINT) AS request_seq, CAST(user_id % 50 AS VARCHAR) AS key, props AS value, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS operation FROM events)",
    "rlog": "rlog AS (SELECT CAST(n.node AS BIGINT) AS node, event_id + 1 AS idx, 1 + event_id // 2500 + CASE WHEN n.node = 3 AND (event_id + 1) % 997 = 0 THEN 1 ELSE 0 END AS term, length(props) AS bytes FROM events, (VALUES (1), (2), (3)) AS n(node))",
    "matches": "matches AS (SELECT user_id % 50 AS grp, event_type AS peer, max(event_id) AS matched FROM events GROUP BY ALL)",
    "ops": "ops AS (SELECT user_id % 4 AS client, ts AS done, value AS latency, event_type <> 'error' AS ok, 1 + event_id % 3 AS attempts FROM events)",
    "runs": "runs AS (SELECT event_type AS arm, CAST([1, 4, 16][user_id % 3 + 1] AS BIGINT) AS clients, event_id AS rep, event_id % 7 <> 0 AS valid, value + CASE event_type WHEN 'view' THEN 1000.0 WHEN 'click' THEN 0.0 ELSE 20.0 END AS throughput, value / 4 AS p50, value / 2 AS p99, event_id % 17 / 16.0::DOUBLE AS syncs, 1.0::DOUBLE + event_id % 5 AS per_sync, 2 + event_id % 9 / 8.0::DOUBLE AS appends, event_id % 9 / 16.0::DOUBLE AS ack_resends, CAST(CASE WHEN event_id % 3 > 0 THEN event_id % 4 END AS DOUBLE) AS send_deadline, CAST(CASE WHEN event_id % 5 > 0 THEN event_id % 2 END AS DOUBLE) AS send_other, CASE WHEN event_id % 4 > 0 THEN event_id % 4 > 1 END AS failover_ok, value + 5 AS failover_ms, value + 1 AS after_close_ms, CASE WHEN event_id % 1000 = 0 THEN 'secondary' ELSE 'official' END AS label FROM events)",
    "counters": "counters AS (SELECT l_suppkey % 3 AS node, CASE WHEN l_returnflag = 'N' THEN 'before' ELSE 'after' END AS boundary, 'append_messages{origin=' || lower(l_linestatus) || '}' AS name, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS value FROM lineitem GROUP BY ALL)",
    "statuses": "statuses AS (SELECT event_id % 3 + 1 AS node, event_id AS tick, CASE event_type WHEN 'error' THEN 'candidate' WHEN 'purchase' THEN 'leader' ELSE 'follower' END AS role, 1 + event_id // 2500 AS term, event_id - user_id % 10 AS commit_index, event_id + user_id % 7 AS last_index FROM events)",
}


def with_views(sql: str, *views: str, recursive: bool = False) -> str:
    """``sql`` (which may begin with further "name AS (...)" clauses, then SELECT) after the views' clauses."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = sql.strip()
    glue = "\n" if body.upper().startswith("SELECT") else ",\n"
    return head + ",\n".join(SQL[v] for v in views) + glue + body
