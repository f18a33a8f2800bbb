"""Queries of benchmark analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats
from ..sources import derived as D

START, END, SECONDS = "2024-01-05 00:00:00", "2024-01-20 00:00:00", 1296000.0
BOUNDS = stats.exponential_bounds(1.0, 2.0, 9)


ARMS = ["click", "view", "purchase", "error", "signup", "absent"]


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols or [c for c, t in df.dtypes if t == "double"]})


def _some_runs(spark, sf):
    """Runs without those of the reference arm with 4 clients, and few of one arm with 16."""
    r = D.runs(spark, sf)
    return r.filter("NOT (arm = 'click' AND clients = 4) AND NOT (arm = 'view' AND clients = 16 AND rep > 60)")


def _ends(spark, sf):
    """Statuses at the start and end of runs of a thousand ticks; some runs lack a node's last one."""
    s = D.statuses(spark, sf).withColumn("run", F.floor(F.col("tick") / 1000).cast("long"))
    ends = s.groupBy("run", "node").agg(F.min_by(F.struct("term", "commit_index"), "tick").alias("a"), F.max_by(F.struct("term", "commit_index"), "tick").alias("z"))
    return ends.select("run", "node", "a.*"), ends.filter("NOT (run % 4 = 3 AND node = 2)").select("run", "node", "z.*")


def _probes(spark, sf):
    e, at = F.col("event_id"), F.col("ts").cast("timestamp")
    later = lambda n: F.timestamp_micros(F.unix_micros(at) + n)
    return D.table(spark, sf, "events").select(e.alias("probe"), at.alias("stop_start"), later(e % 977 * 250).alias("closed"), later(e % 977 * 250 + e % 89 * 500).alias("done"), F.when(F.col("event_type") == "error", "late").alias("error"))


QUERIES = {
    "bench_latency_percentiles": lambda s, d: stats.latency(D.operations(s, d), "client"),
    "bench_window": lambda s, d: stats.window(D.operations(s, d), START, END, SECONDS, "client"),
    "bench_describe": lambda s, d: _rounded(stats.describe(D.operations(s, d), ["client"], ["latency"], []), "latency_median"),
    "bench_validity": lambda s, d: stats.run_validity(D.statuses(s, d)),
    "bench_counter_deltas": lambda s, d: stats.counter_deltas(D.counters(s, d)),
    "bench_counter_rollup": lambda s, d: stats.counter_rollup(D.counters(s, d)),
    "bench_summarize": lambda s, d: _rounded(stats.summarize(D.runs(s, d))),
    "bench_cells": lambda s, d: _rounded(stats.in_declared_order(stats.cells(D.runs(s, d)), ARMS)),
    "bench_label": lambda s, d: stats.label(D.runs(s, d)),
    "bench_outcome": lambda s, d: stats.window_outcome(*_ends(s, d), "run"),
    "bench_result": lambda s, d: stats.result(D.table(s, d, "events").select("event_type", F.col("value").alias("latency"), F.lit(60.0).alias("wall")), "wall", "event_type"),
    "bench_sync_samples": lambda s, d: stats.sync_samples(D.operations(s, d), "latency", "client"),
    "bench_failover": lambda s, d: _rounded(stats.failover(_probes(s, d)).select("probe", "ok", "failover_ms", "close_ms", "after_close_ms")),
    "bench_sweep": lambda s, d: _rounded(stats.sweep(D.runs(s, d).select((F.col("rep") % 3).alias("duration"), "arm", "clients", F.col("rep").alias("repetition"), "ack_resends", "appends"))),
    "bench_compare": lambda s, d: stats.compare(_some_runs(s, d), ARMS),
    "bench_compare_pairs": lambda s, d: stats.pairwise(D.runs(s, d)),
    "bench_workload_summary": lambda s, d: stats.workloads(D.table(s, d, "events"), ["event_type"], "event_id"),
    "bench_share": lambda s, d: D.table(s, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 1e9).alias("none"), F.count_if(F.col("value") > 50).alias("part")).select("event_type", F.round(stats.share(F.col("none"), F.col("part")), 6).alias("share"), stats.share(F.col("part"), F.col("none")).alias("undefined")),
    "bench_histogram": lambda s, d: stats.histogram(D.operations(s, d), "latency", BOUNDS, "client").withColumn("le", F.when(F.col("le") == float("inf"), "inf").otherwise(F.col("le").cast("long").cast("string"))),
    "bench_histogram_quantile": lambda s, d: _rounded(stats.histogram_quantile(stats.histogram(D.operations(s, d), "latency", BOUNDS, "client"), 0.5, "client"), "quantile"),
    "bench_schedule": lambda s, d: stats.schedule(s, ["storm", "copy", "final"], [1, 4, 16], 5),
    "bench_leader_argmax": lambda s, d: stats.leader(D.statuses(s, d).withColumn("grp", F.col("tick") % 10), "grp"),
    "bench_counter_rate": lambda s, d: stats.counter_rate(D.table(s, d, "events").select((F.col("user_id") % 5).alias("node"), F.col("event_id").alias("tick"), F.floor("value").cast("long").alias("reading")), ["node"], "tick", "reading").groupBy("node").agg(F.sum("growth").alias("growth"), F.count_if(F.col("reading") < F.col("prev_reading")).alias("resets")),
}

_PCT = ", ".join(f"quantile_disc(latency, {q}) AS {n}" for n, q in stats.QUANTILES.items())
_THREE = lambda v, w: f"round(coalesce(median({v}) FILTER (WHERE {w}), 0), 6) AS {v}_median, round(coalesce(min({v}) FILTER (WHERE {w}), 0), 6) AS {v}_min, round(coalesce(max({v}) FILTER (WHERE {w}), 0), 6) AS {v}_max"
_RECORDED = "valid AND send_deadline IS NOT NULL AND send_other IS NOT NULL"
_CELLS = "count(*) FILTER (WHERE valid) AS valid_runs, count(*) FILTER (WHERE NOT valid) AS invalid_runs, count(*) FILTER (WHERE " + _RECORDED + ") AS send_recorded, " + ", ".join(_THREE(v, _RECORDED if v.startswith("send_") else "valid") for v in stats.CELL)
_ARMS = "[" + ", ".join(f"'{a}'" for a in ARMS) + "]"
_SOME = "sel AS (SELECT * FROM runs WHERE NOT (arm = 'click' AND clients = 4) AND NOT (arm = 'view' AND clients = 16 AND rep > 60))"
_CELL = "count(*) FILTER (WHERE valid) AS valid_runs, median(throughput) FILTER (WHERE valid) AS md, min(throughput) FILTER (WHERE valid) AS lo, max(throughput) FILTER (WHERE valid) AS hi"
_HIST = "h AS (" + " UNION ALL ".join([f"SELECT client, {b} AS le, count(*) FILTER (WHERE latency <= {b}) AS n FROM ops GROUP BY client" for b in BOUNDS] + ["SELECT client, CAST('inf' AS DOUBLE) AS le, count(*) AS n FROM ops GROUP BY client"]) + ")"
_V = D.with_views
ORACLES = {
    "bench_latency_percentiles": _V(f"SELECT client, {_PCT}, max(latency) AS max FROM ops WHERE ok GROUP BY client", "ops"),
    "bench_window": _V(f"SELECT client, count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE NOT ok) AS failed, CAST(sum(greatest(attempts - 1, 0)) AS BIGINT) AS retries, round(count(*) FILTER (WHERE ok) / {SECONDS}, 6) AS throughput FROM ops WHERE done >= TIMESTAMP '{START}' AND done < TIMESTAMP '{END}' GROUP BY client", "ops"),
    "bench_describe": _V("SELECT client, round(median(latency), 6) AS latency_median, min(latency) AS latency_min, max(latency) AS latency_max FROM ops GROUP BY client", "ops"),
    "bench_validity": _V("SELECT node, CASE WHEN arg_min(term, tick) = arg_max(term, tick) THEN 1 ELSE 0 END AS valid, greatest(0, arg_max(term, tick) - arg_min(term, tick)) AS elections, greatest(0, max(commit_index) - min(commit_index)) AS committed FROM statuses GROUP BY node", "statuses"),
    "bench_counter_deltas": _V("SELECT split_part(name, '{', 1) AS family, regexp_extract(name, 'origin=([^}]*)', 1) AS origin, sum(CASE boundary WHEN 'after' THEN value ELSE -value END) AS delta FROM counters GROUP BY ALL", "counters"),
    "bench_counter_rollup": _V("SELECT coalesce(CAST(node AS VARCHAR), 'all') AS node, coalesce(boundary, 'all') AS boundary, sum(value) AS total FROM counters GROUP BY ROLLUP (node, boundary)", "counters"),
    "bench_summarize": _V("SELECT clients, count(*) AS runs, count(*) FILTER (WHERE valid) AS valid_runs, count(*) FILTER (WHERE NOT valid) AS invalid_runs, count(*) FILTER (WHERE failover_ok) AS probes_ok, count(*) FILTER (WHERE NOT failover_ok) AS probes_failed, " + ", ".join([_THREE(v, "valid") for v in ("throughput", "p50", "p99")] + [_THREE(v, "failover_ok") for v in ("failover_ms", "after_close_ms")]) + " FROM runs GROUP BY clients", "runs"),
    "bench_cells": _V(f"SELECT arm, clients, {_CELLS}, CAST(list_position({_ARMS}, arm) AS BIGINT) AS place FROM runs GROUP BY arm, clients", "runs"),
    "bench_label": _V("SELECT CASE WHEN count(*) > 0 AND count(*) = count(*) FILTER (WHERE label = 'official') THEN 'official' ELSE 'secondary' END AS label FROM runs", "runs"),
    "bench_compare": _V(f"""{_SOME},
c AS (SELECT arm, clients, {_CELL}, median(appends) FILTER (WHERE valid) AS amd, min(appends) FILTER (WHERE valid) AS alo, max(appends) FILTER (WHERE valid) AS ahi, min(p99) FILTER (WHERE valid) AS plo, max(p99) FILTER (WHERE valid) AS phi FROM sel GROUP BY arm, clients),
g AS (SELECT clients, unnest({_ARMS}) AS arm FROM (SELECT DISTINCT clients FROM sel)),
j AS (SELECT g.arm, g.clients, coalesce(a.valid_runs, 0) AS an, coalesce(r.valid_runs, 0) AS rn, a.md AS amed, r.md AS rmed, a.amd AS aap, r.amd AS rap, a.lo, a.hi, r.lo AS rlo, r.hi AS rhi, a.alo, a.ahi, r.alo AS ralo, r.ahi AS rahi, a.plo, a.phi, r.plo AS rplo, r.phi AS rphi
  FROM g LEFT JOIN c a ON a.arm = g.arm AND a.clients = g.clients LEFT JOIN c r ON r.arm = 'click' AND r.clients = g.clients WHERE g.arm <> 'click')
SELECT arm, clients, rn AS base_runs, an AS other_runs, round(CASE WHEN an > 0 AND rn > 0 AND rmed <> 0 THEN amed / rmed ELSE 0 END, 6) AS ratio, round(CASE WHEN an > 0 AND rn > 0 AND rap <> 0 THEN aap / rap ELSE 0 END, 6) AS appends_ratio,
  CASE WHEN an >= 5 AND rn >= 5 THEN 0 ELSE 1 END AS insufficient, CASE WHEN an >= 5 AND rn >= 5 AND (hi < rlo OR rhi < lo) THEN 1 ELSE 0 END AS meaningful,
  CASE WHEN an >= 5 AND rn >= 5 AND (ahi < ralo OR rahi < alo) THEN 1 ELSE 0 END AS appends_meaningful, CASE WHEN an >= 5 AND rn >= 5 AND (phi < rplo OR rphi < plo) THEN 1 ELSE 0 END AS p99_meaningful FROM j""", "runs"),
    "bench_outcome": _V("""e AS (SELECT tick // 1000 AS run, node, arg_min(term, tick) AS st, arg_min(commit_index, tick) AS sc, CASE WHEN tick // 1000 % 4 = 3 AND node = 2 THEN NULL ELSE arg_max(term, tick) END AS et, CASE WHEN tick // 1000 % 4 = 3 AND node = 2 THEN NULL ELSE arg_max(commit_index, tick) END AS ec FROM statuses GROUP BY 1, 2),
r AS (SELECT run, count(st) AS n, count(et) AS m, min(node) FILTER (WHERE st <> et) AS bad, arg_min(st, node) FILTER (WHERE st <> et) AS b1, arg_min(et, node) FILTER (WHERE st <> et) AS b2, greatest(0, coalesce(max(et), 0) - coalesce(max(st), 0)) AS elections, greatest(0, coalesce(max(ec), 0) - coalesce(max(sc), 0)) AS committed FROM e GROUP BY run),
t AS (SELECT *, CASE WHEN n <> m THEN n || ' terms at the start, ' || m || ' at the end' WHEN bad IS NOT NULL THEN 'node ' || bad || ': term ' || b1 || ' to ' || b2 ELSE '' END AS reason FROM r)
SELECT run, reason = '' AS valid, reason, elections, committed FROM t""", "statuses"),
    "bench_result": f"SELECT event_type, count(*) AS operations, round(count(*) / 60.0, 6) AS per_second, {_PCT.replace('latency', 'value')}, max(value) AS max FROM events GROUP BY event_type",
    "bench_sync_samples": _V("SELECT client, count(latency) AS samples, quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.99) AS p99 FROM ops GROUP BY client", "ops"),
    "bench_failover": "SELECT event_id AS probe, event_type <> 'error' AS ok, round((event_id % 977 * 250 + event_id % 89 * 500) / 1000, 6) AS failover_ms, round(event_id % 977 * 250 / 1000, 6) AS close_ms, round(event_id % 89 * 500 / 1000, 6) AS after_close_ms FROM events",
    "bench_sweep": _V("SELECT rep % 3 AS duration, arm, clients, rep AS repetition, ack_resends, appends, round(CASE WHEN appends > 0 THEN ack_resends / appends END, 6) AS share FROM runs", "runs"),
    "bench_compare_pairs": _V(f"c AS (SELECT arm, clients, {_CELL} FROM runs GROUP BY arm, clients) SELECT a.clients, a.arm AS a, b.arm AS b, CASE WHEN a.hi < b.lo OR b.hi < a.lo THEN 1 ELSE 0 END AS meaningful FROM c a JOIN c b ON a.arm < b.arm AND a.clients = b.clients", "runs"),
    "bench_workload_summary": "SELECT event_type, min(event_id) AS first_seen, count(*) AS operations FROM events GROUP BY event_type",
    "bench_share": "WITH g AS (SELECT event_type, count(*) FILTER (WHERE value > 1e9) AS none, count(*) FILTER (WHERE value > 50) AS part FROM events GROUP BY event_type) SELECT event_type, round(CASE WHEN part > 0 THEN none / part END, 6) AS share, CASE WHEN none > 0 THEN part / none END AS undefined FROM g",
    "bench_histogram": _V(_HIST + " SELECT client, CASE WHEN isinf(le) THEN 'inf' ELSE CAST(CAST(le AS BIGINT) AS VARCHAR) END AS le, n FROM h", "ops"),
    "bench_histogram_quantile": _V(_HIST + ", b AS (SELECT client, le, n, lag(le, 1, 0) OVER (PARTITION BY client ORDER BY le) AS low, lag(n, 1, 0) OVER (PARTITION BY client ORDER BY le) AS before, max(n) OVER (PARTITION BY client) AS total FROM h) SELECT client, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (total * 0.5 - before) / (n - before) END, 6) AS quantile FROM b WHERE n >= total * 0.5 AND before < total * 0.5", "ops"),
    "bench_schedule": "SELECT (r.range - 1) * 9 + c.i * 3 + k.range + 1 AS slot, r.range AS repetition, CAST(c.clients AS BIGINT) AS clients, ['storm', 'copy', 'final'][(k.range + r.range - 1) % 3 + 1] AS arm FROM range(1, 6) r, (VALUES (0, 1), (1, 4), (2, 16)) c(i, clients), range(3) k",
    "bench_leader_argmax": _V("l AS (SELECT tick % 10 AS grp, node, term, tick, row_number() OVER (PARTITION BY tick % 10 ORDER BY term DESC, tick ASC) AS r FROM statuses WHERE role = 'leader') SELECT grp, node, term, tick FROM l WHERE r = 1", "statuses"),
    "bench_counter_rate": "WITH p AS (SELECT user_id % 5 AS node, CAST(floor(value) AS BIGINT) AS v, lag(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS b FROM events) SELECT node, CAST(sum(CASE WHEN v < b THEN v ELSE v - b END) AS BIGINT) AS growth, count(*) FILTER (WHERE v < b) AS resets FROM p GROUP BY node",
}
