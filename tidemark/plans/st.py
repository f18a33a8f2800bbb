"""Queries that run streams to their end, and the table on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lww
from ..schema import DELETE, PUT
from ..sources import binary
from ..sources import derived as D
from ..sources.files import scratch
from ..sources.kvtable import KVTable, Options
from ..streaming.dedup import BatchSink, applied_stream
from ..streaming.windows import throughput


def _stream(spark: SparkSession, rows: DataFrame, name: str, files: int = 4) -> tuple[DataFrame, str]:
    """``rows`` as a file stream that comes in order of the first column, and a scratch folder."""
    at = scratch(spark, name)
    first = F.unix_micros(rows.columns[0]) if dict(rows.dtypes)[rows.columns[0]] == "timestamp" else F.col(rows.columns[0])
    low, high = rows.agg(F.min(first), F.max(first)).first()
    step = ((high or 0) - (low or 0)) // files + 1
    for k in range(files):  # one after another: the source takes files by age
        rows.filter(F.floor((first - F.lit(low or 0)) / step) == k).coalesce(1).write.mode("append").parquet(f"{at}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{at}/in"), at


def _drained(stream: DataFrame, at: str, mode: str = "append") -> DataFrame:
    sink = BatchSink(f"{at}/out")
    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return sink.read(stream.sparkSession)


def dedup_stream(spark: SparkSession, sf: str) -> DataFrame:
    stream, at = _stream(spark, D.command_log(spark, sf), "st-dedup")
    return _drained(applied_stream(stream), at).select("idx", "client_id", "request_seq")


def foreach_apply(spark: SparkSession, sf: str) -> DataFrame:
    """The live state after the stream of commands was applied batch by batch."""
    stream, at = _stream(spark, D.command_log(spark, sf), "st-apply")
    done = _drained(applied_stream(stream), at)
    return lww.live_state(done.select("key", "value", F.col("idx").alias("seq"), F.when(F.col("operation") == "delete", 1).otherwise(0).alias("op")))


def window_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Daily counts by a watermarked window; what a stream's end leaves open isn't given."""
    ops = D.operations(spark, sf).select("done", "client", "ok", "attempts")
    stream, at = _stream(spark, ops, "st-window", files=2)
    return _drained(throughput(stream, "1 day", "0 seconds"), at).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "succeeded", "failed", "retries")


def table_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The log written to a table in two bulk segments and compacted; its live state."""
    log = D.mutation_log(spark, sf).withColumn("place", F.col("seq"))
    half = 5000
    with KVTable.open(spark, scratch(spark, "kv"), Options(compaction_threshold=10)) as t:
        t.append(log.filter(F.col("seq") <= half))
        t.append(log.filter(F.col("seq") > half))
        t.compact()
        return t.live()


def _two_parts(spark: SparkSession, sf: str, name: str, options: Options) -> KVTable:
    """A table of the log written in two bulk segments."""
    log = D.mutation_log(spark, sf).withColumn("place", F.col("seq"))
    t = KVTable.open(spark, scratch(spark, name), options)
    t.append(log.filter("seg % 2 = 0").withColumn("place", F.col("seq")))
    t.append(log.filter("seg % 2 = 1"))
    return t


def table_status(spark: SparkSession, sf: str) -> DataFrame:
    with _two_parts(spark, sf, "status", Options(compaction_threshold=10)) as t:
        return t.status().select("generation", "segments", "tail", "last_seq")


def table_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The live state of a table that took another one's snapshot in place of its own."""
    with _two_parts(spark, sf, "source", Options(compaction_threshold=2)) as t:
        image = scratch(spark, "image")
        t.snapshot(image)
    with KVTable.open(spark, scratch(spark, "copy")) as t:
        t.put("old", "goes")
        t.flush()
        t.restore(image)
        return t.live().select("key", "value")


def table_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Gets and a scan over segments, and a tail that hides some of their keys."""
    with _two_parts(spark, sf, "reads", Options(compaction_threshold=10)) as t:
        t.write([(DELETE, "42", None), (PUT, "new", "1"), (PUT, "15", "")])
        return t.multi_get(["42", "new", "15", "16", "nobody"]).unionByName(t.scan("20", "29")).select("key", "value")


def log_files(spark: SparkSession, sf: str) -> DataFrame:
    """The log written as files of records and read again."""
    files = binary.encoded(D.mutation_log(spark, sf), "seg", "log")
    return binary.decoded(files, "log").select(F.col("key").cast("string").alias("key"), "seq", "op", F.col("value").cast("string").alias("value"))


def sorted_files(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted files of the segments, of which a range is read by their index."""
    files = binary.encoded(D.mutation_log(spark, sf), "seg", "sorted")
    return binary.decoded(files, "sorted", "2", "5").select("path", F.col("key").cast("string").alias("key"), "seq", "op")


def file_gets(spark: SparkSession, sf: str) -> DataFrame:
    """Keys looked up in every sorted file; the newest record of each."""
    files = binary.encoded(D.banded_log(spark, sf), "seg", "sorted")
    met = binary.lookups(files, [f"{k:09d}" for k in (0, 7, 333, 334, 999, 3000)] + ["", "x"]).filter("answer = 'found'")
    won = met.groupBy("key").agg(F.max_by(F.struct("op", "value", "seq"), "seq").alias("w"), F.count(F.lit(1)).alias("files"))
    return won.select("key", "files", "w.op", "w.seq", F.col("w.value").cast("string").alias("value"))


QUERIES = {"kv_table_status": table_status, "kv_table_snapshot": table_snapshot, "kv_table_reads": table_reads, "kv_log_files": log_files, "kv_sorted_files": sorted_files, "kv_file_gets": file_gets, "st_dedup_stream": dedup_stream, "st_foreach_apply": foreach_apply, "st_window": window_stream, "kv_table_roundtrip": table_roundtrip}

_APPLIED = """b AS (SELECT *, max(request_seq) OVER (PARTITION BY client_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM cmd),
a AS (SELECT * FROM b WHERE m IS NULL OR request_seq > m)"""
_LIVE = "live AS (SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM mlog) WHERE r = 1 AND op = 0)"
ORACLES = {
    "st_dedup_stream": D.with_views(_APPLIED + " SELECT idx, client_id, request_seq FROM a", "cmd"),
    "st_foreach_apply": D.with_views(_APPLIED + ", r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx DESC) AS r FROM a) SELECT key, value, idx AS seq FROM r WHERE r = 1 AND operation = 'put'", "cmd"),
    "st_window": D.with_views("SELECT strftime(done, '%Y-%m-%d') AS day, count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE NOT ok) AS failed, CAST(sum(greatest(attempts - 1, 0)) AS BIGINT) AS retries FROM ops WHERE date_trunc('day', done) < (SELECT date_trunc('day', max(done)) FROM ops) GROUP BY 1", "ops"),
    # bulk writes are numbered on in the order of their places: first the even segments, then the odd ones
    "kv_table_status": "SELECT CAST(2 AS BIGINT) AS generation, CAST(CASE WHEN count(*) FILTER (WHERE event_id // 1000 % 2 = 1) > 0 THEN 2 ELSE 1 END AS BIGINT) AS segments, CAST(0 AS BIGINT) AS tail, count(*) AS last_seq FROM events",
    "kv_table_snapshot": D.with_views("SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seg % 2 DESC, seq DESC) AS r FROM mlog) WHERE r = 1 AND op = 0", "mlog"),
    "kv_table_reads": D.with_views("l AS (SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seg % 2 DESC, seq DESC) AS r FROM mlog) WHERE r = 1 AND op = 0) SELECT * FROM (VALUES ('new', '1'), ('15', '')) x(key, value) UNION ALL SELECT key, value FROM l WHERE key = '16' OR key BETWEEN '20' AND '29'", "mlog"),
    "kv_log_files": D.with_views("SELECT key, seq, op, coalesce(value, '') AS value FROM mlog", "mlog"),
    "kv_sorted_files": D.with_views("SELECT CAST(seg AS VARCHAR) AS path, key, max(seq) AS seq, arg_max(op, seq) AS op FROM mlog WHERE key BETWEEN '2' AND '5' GROUP BY seg, key", "mlog"),
    "kv_file_gets": D.with_views("SELECT key, count(DISTINCT seg) AS files, arg_max(op, seq) AS op, max(seq) AS seq, coalesce(arg_max(coalesce(value, ''), seq), '') AS value FROM banded WHERE key IN ('000000000', '000000007', '000000333', '000000334', '000000999', '000003000') GROUP BY key", "banded"),
    "kv_table_roundtrip": D.with_views(_LIVE + " SELECT * FROM live", "mlog"),
}
