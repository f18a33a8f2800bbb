"""Queries over mutation logs and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import commands, lww, raftlog, segments
from ..sources import derived as D

LIVE = """live AS (SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM mlog) WHERE r = 1 AND op = 0)"""
_KEYS = [str(k) for k in (3, 14, 15, 92, 65, 35, 100000)]


def _asked(spark):
    """Keys that half exist: every third number up to 900."""
    return spark.range(0, 900, 3).select(F.col("id").cast("string").alias("key"))


def _windows(spark, sf):
    """Overlapping windows of a hundred keys, over all keys of the banded log."""
    low = F.col("id") * 40
    ids = D.table(spark, sf, "events").select(F.floor(F.col("event_id") / 120).cast("long").alias("id")).distinct()
    return ids.select("id", F.lpad(low.cast("string"), 9, "0").alias("low"), F.lpad((low + 99).cast("string"), 9, "0").alias("high"))


def _wal_tail(spark, sf):
    log = D.mutation_log(spark, sf).withColumn("place", F.col("seq")).filter("seq > 4000")
    return commands.renumbered(log.drop("seq"), 4000)


QUERIES = {
    "kv_live_state": lambda s, d: lww.live_state(D.mutation_log(s, d)),
    "kv_get_point": lambda s, d: lww.get(D.mutation_log(s, d), "42"),
    "kv_multi_get": lambda s, d: lww.multi_get(D.mutation_log(s, d), _KEYS),
    "kv_scan_range": lambda s, d: lww.scan(D.mutation_log(s, d), "10", "25"),
    "kv_scan_reversed_bounds": lambda s, d: lww.scan(D.mutation_log(s, d), "25", "10"),
    "kv_scan_windows": lambda s, d: lww.range_scans(D.banded_log(s, d), _windows(s, d)),
    "kv_missing_keys": lambda s, d: lww.missing(_asked(s), D.mutation_log(s, d)),
    "kv_present_keys": lambda s, d: lww.present(_asked(s), D.mutation_log(s, d)),
    "kv_tombstones": lambda s, d: lww.tombstones(D.mutation_log(s, d)),
    "kv_as_of": lambda s, d: lww.as_of(D.mutation_log(s, d), 5000),
    "kv_history": lambda s, d: lww.history(D.mutation_log(s, d)).select("key", "seq", "op", "age"),
    "kv_version_counts": lambda s, d: lww.version_counts(D.mutation_log(s, d)),
    "kv_segment_stats": lambda s, d: segments.stats(D.mutation_log(s, d)),
    "kv_segment_overlap": lambda s, d: segments.overlaps(D.banded_log(s, d)),
    "kv_segment_prune": lambda s, d: segments.needed(D.banded_log(s, d), "000000600", "000001400"),
    "kv_partial_then_final_lww": lambda s, d: lww.live_state(segments.newest_per_segment(D.mutation_log(s, d))),
    "kv_compact_keep_tombstones": lambda s, d: segments.merge(D.mutation_log(s, d), False),
    "kv_compact_bottom": lambda s, d: segments.merge(D.mutation_log(s, d), True),
    "kv_compaction_ratio": lambda s, d: segments.amplification(D.mutation_log(s, d)),
    "kv_max_sequence": lambda s, d: D.mutation_log(s, d).agg(F.max("seq").alias("last_seq")),
    "kv_wal_replay_filter": lambda s, d: commands.replayed(D.mutation_log(s, d), 9000).select("key", "seq", "op"),
    "kv_wal_renumber": lambda s, d: _wal_tail(s, d).select("key", "place", "seq"),
    "kv_batch_first_wins": lambda s, d: commands.batch_state(D.batch_log(s, d)),
    "kv_index_gap_check": lambda s, d: commands.index_gaps(D.command_log(s, d).filter("idx % 97 <> 0 AND idx % 98 <> 0")),
    "kv_snapshot_sorted_check": lambda s, d: _unsorted(s, d),
    "kv_snapshot_chunks": lambda s, d: raftlog.snapshot_chunks(lww.live_state(D.mutation_log(s, d)).select("key", (F.octet_length("key") + F.octet_length(F.coalesce("value", F.lit(""))) + 8).alias("bytes"))),
}


def _unsorted(spark, sf):
    """Records of a stream that don't come in strictly ascending order: of the raw log, against its place."""
    from ..functions.running import previous

    log = D.banded_log(spark, sf).select("key", "seq")
    return previous(log, [], "seq", ["key"]).filter("prev_key >= key").agg(F.count(F.lit(1)).alias("out_of_order"))


_V = D.with_views
ORACLES = {
    "kv_live_state": _V(LIVE + " SELECT * FROM live", "mlog"),
    "kv_get_point": _V(LIVE + " SELECT * FROM live WHERE key = '42'", "mlog"),
    "kv_multi_get": _V(LIVE + f" SELECT * FROM live WHERE key IN ({', '.join(repr(k) for k in _KEYS)})", "mlog"),
    "kv_scan_range": _V(LIVE + " SELECT * FROM live WHERE key >= '10' AND key <= '25'", "mlog"),
    "kv_scan_reversed_bounds": _V(LIVE + " SELECT * FROM live WHERE key >= '25' AND key <= '10'", "mlog"),
    "kv_scan_windows": _V(
        "live AS (SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM banded) WHERE r = 1 AND op = 0), "
        "w AS (SELECT range AS id, lpad(CAST(range * 40 AS VARCHAR), 9, '0') AS low, lpad(CAST(range * 40 + 99 AS VARCHAR), 9, '0') AS high FROM (SELECT DISTINCT event_id // 120 AS range FROM events)) "
        "SELECT id, key, value, seq FROM w JOIN live ON key >= low AND key <= high", "banded"),
    "kv_missing_keys": _V(LIVE + ", q AS (SELECT CAST(range AS VARCHAR) AS key FROM range(0, 900, 3)) SELECT key FROM q WHERE key NOT IN (SELECT key FROM live)", "mlog"),
    "kv_present_keys": _V(LIVE + ", q AS (SELECT CAST(range AS VARCHAR) AS key FROM range(0, 900, 3)) SELECT key FROM q WHERE key IN (SELECT key FROM live)", "mlog"),
    "kv_tombstones": _V("SELECT key, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM mlog) WHERE r = 1 AND op = 1", "mlog"),
    "kv_as_of": _V("SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM mlog WHERE seq <= 5000) WHERE r = 1 AND op = 0", "mlog"),
    "kv_history": _V("SELECT key, seq, op, age FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS age FROM mlog)", "mlog"),
    "kv_version_counts": _V("SELECT key, count(*) AS versions, CAST(sum(op) AS BIGINT) AS deletes, min(seq) AS first_seq, max(seq) AS last_seq FROM mlog GROUP BY key", "mlog"),
    "kv_segment_stats": _V("SELECT seg, min(key) AS min_key, max(key) AS max_key, count(*) AS records, count(DISTINCT key) AS keys, max(seq) AS max_seq FROM mlog GROUP BY seg", "mlog"),
    "kv_segment_overlap": _V("b AS (SELECT seg, min(key) AS lo, max(key) AS hi FROM banded GROUP BY seg) SELECT x.seg AS left_id, y.seg AS right_id FROM b x JOIN b y ON x.seg < y.seg AND x.lo <= y.hi AND y.lo <= x.hi", "banded"),
    "kv_segment_prune": _V("SELECT seg, min(key) AS min_key, max(key) AS max_key FROM banded GROUP BY seg HAVING min(key) <= '000001400' AND max(key) >= '000000600'", "banded"),
    "kv_partial_then_final_lww": _V(LIVE + " SELECT * FROM live", "mlog"),
    "kv_compact_keep_tombstones": _V("SELECT key, value, seq, op FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM mlog) WHERE r = 1", "mlog"),
    "kv_compact_bottom": _V("SELECT key, value, seq, op FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM mlog) WHERE r = 1 AND op = 0", "mlog"),
    "kv_compaction_ratio": _V(LIVE + " SELECT (SELECT count(*) FROM mlog) AS records, (SELECT count(DISTINCT seg) FROM mlog) AS segments, (SELECT count(DISTINCT key) FROM mlog) AS keys, (SELECT count(*) FROM live) AS live, (SELECT count(DISTINCT seg) FROM mlog) + 1 AS read_amp, round((SELECT count(*) FROM mlog) / (SELECT count(*) FROM live), 6) AS space_amp", "mlog"),
    "kv_max_sequence": _V("SELECT max(seq) AS last_seq FROM mlog", "mlog"),
    "kv_wal_replay_filter": _V("SELECT key, seq, op FROM mlog WHERE seq > 9000", "mlog"),
    "kv_wal_renumber": _V("SELECT key, seq AS place, 4000 + row_number() OVER (ORDER BY seq) AS seq FROM mlog WHERE seq > 4000", "mlog"),
    "kv_batch_first_wins": _V("SELECT key, value, idx AS seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx DESC, pos ASC) AS r FROM batches) WHERE r = 1 AND op = 0", "batches"),
    "kv_index_gap_check": _V("p AS (SELECT idx, lag(idx, 1, 0) OVER (ORDER BY idx) AS after FROM cmd WHERE idx % 97 <> 0 AND idx % 98 <> 0) SELECT after, idx AS next, idx - after - 1 AS lost FROM p WHERE idx <> after + 1", "cmd"),
    "kv_snapshot_sorted_check": _V("SELECT count(*) AS out_of_order FROM (SELECT key, lag(key) OVER (ORDER BY seq) AS p FROM banded) WHERE p >= key", "banded"),
    "kv_snapshot_chunks": _V(LIVE + ", o AS (SELECT key, strlen(key) + strlen(coalesce(value, '')) + 8 AS bytes FROM live), p AS (SELECT bytes, CAST(sum(bytes) OVER (ORDER BY key) AS BIGINT) - bytes AS off FROM o) SELECT off // 1000 AS chunk, min(off) AS \"offset\", count(*) AS records, CAST(sum(bytes) AS BIGINT) AS bytes FROM p GROUP BY 1", "mlog"),
}
