"""Benchmark reports: nested JSON files, single ones and comparisons of arms, as one table of runs."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Files

_FSYNC = "struct<p50_ms:double,p99_ms:double>"
_LATENCY = "struct<p50:double,p95:double,p99:double,p999:double,max:double>"
_RUN = (
    "struct<repetition:long,clients:long,valid:boolean,invalid_reason:string,window_seconds:double,ops_ok:long,ops_failed:long,retries:long,"
    f"throughput_ops_per_sec:double,latency_ms:{_LATENCY},terms_start:array<long>,terms_end:array<long>,elections_in_window:long,"
    f"committed_entries:long,fsync_before:{_FSYNC},fsync_after:{_FSYNC},counters:map<string,string>>"
)
_ENV = "struct<git_sha:string,git_dirty:boolean,goos:string,goarch:string,kernel:string,cpu_model:string,num_cpu:long,gomaxprocs:long,fsync_primitive:string,filesystem:string,mount_options:string,block_device:string>"
_CONFIG = "struct<warmup_seconds:double,duration_seconds:double,repetitions:long>"
REPORT = f"schema_version:long,label:string,machine_type:string,disk_type:string,environment:{_ENV},config:{_CONFIG},runs:array<{_RUN}>"
_ARM = "struct<name:string,rev:string,picks:array<string>,base_sha:string,head_sha:string,picked_shas:array<string>>"
_SLOT = f"struct<sequence:long,repetition:long,clients:long,arm:string,report:struct<{REPORT}>>"
COMPARISON = f"struct<schema_version:long,complete:boolean,clients:array<long>,repetitions:long,machine_type:string,disk_type:string,num_cpu:long,gomaxprocs:long,arms:array<{_ARM}>,runs:array<{_SLOT}>>"


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row for each unit (a single report, or a slot of a comparison): file, unit, kind, arm, head (what the whole file
    says), report. A comparison is known by its arms. Files are read whole, each by one task."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    both = raw.select("file", "text", F.from_json("text", COMPARISON).alias("c"), F.from_json("text", f"struct<{REPORT}>").alias("r"))
    compare = both.filter("c.arms IS NOT NULL").select("file", "text", "c", F.explode_outer("c.runs").alias("s"))
    compared = compare.select(
        "file",
        F.concat(F.col("s.arm"), F.lit(" rep "), F.col("s.repetition").cast("string"), F.lit(" clients "), F.col("s.clients").cast("string")).alias("unit"),
        F.lit("comparison").alias("kind"),
        F.col("s.arm").alias("arm"),
        F.struct("c.machine_type", "c.disk_type", "c.num_cpu", "c.gomaxprocs", "c.repetitions", "c.arms", "c.clients", "c.complete").alias("head"),
        F.col("s.report").alias("report"),
    )
    single = both.filter("c.arms IS NULL").select(
        "file",
        F.lit("report").alias("unit"),
        F.lit("report").alias("kind"),
        F.lit(None).cast("string").alias("arm"),
        F.struct("r.machine_type", "r.disk_type", F.col("r.environment.num_cpu").alias("num_cpu"), F.col("r.environment.gomaxprocs").alias("gomaxprocs"), F.col("r.config.repetitions").alias("repetitions"), F.lit(None).cast(f"array<{_ARM}>").alias("arms"), F.lit(None).cast("array<bigint>").alias("clients"), F.lit(True).alias("complete")).alias("head"),
        F.col("r").alias("report"),
    )
    return compared.unionByName(single)


def runs_of(units: DataFrame) -> DataFrame:
    """One row for each run: file, unit, arm and the run's fields."""
    return units.select("file", "unit", "arm", F.explode("report.runs").alias("run")).select("file", "unit", "arm", "run.*")


def write_result(spark: SparkSession, folder: str, kind: str, sha: str, result: dict, day: dt.date | None = None) -> str:
    """Writes a result under a name of its own, <day>-<sha>-<kind>.json; -2, -3 and so on where that is taken. Nothing is
    ever overwritten."""
    files = Files(spark, folder)
    files.mkdirs()
    base = f"{(day or dt.date.today()).isoformat()}-{sha[:12]}-{kind}"
    for n in range(1, 10_000):
        name = f"{base}.json" if n == 1 else f"{base}-{n}.json"
        try:
            files.write_new(name, json.dumps(result).encode())
            return name
        except FileExistsError:
            continue
    raise RuntimeError("too many results of one day and revision")


class PeerDirectory:
    """Addresses by peer id from a JSON file, read again at most every ``refresh`` seconds; a bad file keeps the last good one."""

    def __init__(self, spark: SparkSession, folder: str, name: str, refresh: float = 1.0) -> None:
        self.spark, self.files, self.name, self.refresh = spark, Files(spark, folder), name, refresh
        self.at, self.good = float("-inf"), {}

    def peers(self, now: float) -> dict[int, str]:
        if now - self.at >= self.refresh:
            self.at = now
            try:
                found = json.loads(self.files.read(self.name))
                parsed = {int(k): v for k, v in found.items() if isinstance(v, str) and v and int(k) > 0}
                if parsed and len(parsed) == len(found):
                    self.good = parsed
            except Exception:  # noqa: BLE001  any failure to read or parse leaves what was there
                pass
        if not self.good:
            raise LookupError("no peers are known")
        return self.good

    def frame(self, now: float) -> DataFrame:
        return self.spark.createDataFrame(sorted(self.peers(now).items()), "peer long, address string")
