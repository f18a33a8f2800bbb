"""The checks of a report file, each with PASS, WARN or FAIL and what it found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.reports import runs_of
from .checks import FAIL, PASS, WARN, protocol, recorded, same_commit, validity

# Fixed value: what the runs must have synced with.
PRIMITIVE = "fsync(2)"


def _all(units: DataFrame, name: str, ok: Column) -> DataFrame:
    """Passes if ``ok`` holds for every unit of a file; tells the units for which it doesn't."""
    bad = F.array_sort(F.collect_set(F.when(~F.coalesce(ok, F.lit(False)), F.col("unit"))))
    return units.groupBy("file").agg(bad.alias("bad")).select("file", F.lit(name).alias("check"), F.when(F.size("bad") == 0, PASS).otherwise(FAIL).alias("status"), F.array_join("bad", "; ").alias("detail"))


def check(units: DataFrame) -> DataFrame:
    """file, check, status and detail of every file in ``units`` (from ``read_reports``)."""
    env, head = "report.environment.", "head."
    c = F.col
    probes = ["fsync_before.p50_ms", "fsync_before.p99_ms", "fsync_after.p50_ms", "fsync_after.p99_ms"]
    runs = runs_of(units)
    sampled = runs.select("file", F.concat("unit", F.lit(" run "), F.col("repetition").cast("string")).alias("unit"), F.lit(True).alias("any"), *[F.coalesce(c(p) > 0, F.lit(False)).alias(f"p{i}") for i, p in enumerate(probes)])
    by_file = units.select("file").distinct()
    judged = validity(runs.select("file", "valid", F.when((c("elections_in_window") > 0) | F.coalesce(c("invalid_reason").contains("term changed"), F.lit(False)), 1).otherwise(0).alias("elections")), "file")
    judged = by_file.join(judged, "file", "left").select("file", F.lit("validity").alias("check"), F.coalesce("status", F.lit(FAIL)).alias("status"), F.concat_ws(" ", F.coalesce("invalid", F.lit(0)).cast("string"), F.lit("invalid of"), F.coalesce("runs", F.lit(0)).cast("string")).alias("detail"))
    sampled_checks = by_file.join(_all(sampled, "fsync.samples", c("p0") & c("p1") & c("p2") & c("p3")), "file", "left").select("file", F.lit("fsync.samples").alias("check"), F.coalesce("status", F.lit(FAIL)).alias("status"), F.coalesce("detail", F.lit("no runs")).alias("detail"))
    official = units.groupBy("file").agg(
        F.min(F.when(protocol(c("report.config.warmup_seconds"), c("report.config.duration_seconds"), c(head + "repetitions")) == FAIL, 0).when(protocol(c("report.config.warmup_seconds"), c("report.config.duration_seconds"), c(head + "repetitions")) == WARN, 1).otherwise(2)).alias("worst")
    )
    cpus = (c(head + "num_cpu") > 0) & (c(head + "gomaxprocs") == c(head + "num_cpu")) & (c(env + "gomaxprocs") == c(head + "num_cpu"))
    return (
        _all(units, "env.os", c(env + "goos") == "linux")
        .unionByName(_all(units, "env.cpu_count", cpus))
        .unionByName(_all(units, "env.data_dir_fs", recorded(c(env + "filesystem")) & recorded(c(env + "mount_options"))))
        .unionByName(_all(units, "fsync.primitive", c(env + "fsync_primitive") == PRIMITIVE))
        .unionByName(sampled_checks)
        .unionByName(_all(units, "labels", recorded(c(head + "machine_type")) & recorded(c(head + "disk_type"))))
        .unionByName(judged)
        .unionByName(official.select("file", F.lit("protocol").alias("check"), F.element_at(F.array(F.lit(FAIL), F.lit(WARN), F.lit(PASS)), (c("worst") + 1).cast("int")).alias("status"), F.lit("").alias("detail")))
        .unionByName(arms(units))
    )


def arms(units: DataFrame) -> DataFrame:
    """Comparisons: every declared arm has runs with every number of clients, and no others; each run's commit is its arm's."""
    compared = units.filter("kind = 'comparison'")
    declared = compared.select("file", F.explode("head.arms").alias("a"), F.col("head.clients").alias("cs")).select("file", F.col("a.name").alias("arm"), F.col("a.head_sha").alias("sha"), F.explode("cs").alias("clients")).distinct()
    found = runs_of(compared).select("file", "arm", "clients").distinct().withColumn("found", F.lit(True))
    met = declared.join(found, ["file", "arm", "clients"], "full_outer")
    problem = F.when(F.col("found").isNull(), F.concat(F.lit("missing "), "arm")).when(F.col("sha").isNull(), F.concat(F.lit("undeclared "), "arm"))
    other = compared.join(declared.select("file", "arm", "sha").distinct(), ["file", "arm"]).filter(~same_commit(F.col("report.environment.git_sha"), F.col("sha"))).select("file", F.concat(F.lit("other commit "), "arm").alias("p"))
    every = met.select("file", problem.alias("p")).unionByName(other)
    return every.groupBy("file").agg(F.array_sort(F.collect_set("p")).alias("bad")).select("file", F.lit("arms").alias("check"), F.when(F.size("bad") == 0, PASS).otherwise(FAIL).alias("status"), F.array_join("bad", "; ").alias("detail"))
