"""Report files, their checks, results, peers, generators, settings and the command line."""

from __future__ import annotations

import base64
import copy
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.__main__ import run
from tidemark.config import InvalidArgument, ReplicaConfig
from tidemark.functions import generators as G
from tidemark.operators import checks, lww
from tidemark.operators.report_checks import check
from tidemark.sources.kvtable import KVTable
from tidemark.sources.reports import PeerDirectory, read_reports, runs_of, write_result

SHA = {"base": "5c0ffee" + "0" * 33, "tip": "8eae967" + "1" * 33}


def report(sha, rep=1, warmup=5.0, window=30.0):
    run = {"repetition": rep, "clients": 1, "valid": True, "throughput_ops_per_sec": 200.0, "elections_in_window": 0, "fsync_before": {"p50_ms": 1.5, "p99_ms": 2.5}, "fsync_after": {"p50_ms": 1.4, "p99_ms": 2.4}, "counters": {}}
    env = {"git_sha": sha, "goos": "linux", "num_cpu": 8, "gomaxprocs": 8, "fsync_primitive": "fsync(2)", "filesystem": "ext4", "mount_options": "rw"}
    return {"schema_version": 1, "machine_type": "m8", "disk_type": "ssd", "environment": env, "config": {"warmup_seconds": warmup, "duration_seconds": window, "repetitions": 5}, "runs": [run]}


def comparison():
    arms = [{"name": a, "rev": s[:7], "head_sha": s} for a, s in SHA.items()]
    runs = [{"sequence": i + 1, "repetition": 1, "clients": 1, "arm": a, "report": report(s)} for i, (a, s) in enumerate(SHA.items())]
    return {"schema_version": 1, "complete": True, "clients": [1], "repetitions": 5, "machine_type": "m8", "disk_type": "ssd", "num_cpu": 8, "gomaxprocs": 8, "arms": arms, "runs": runs}


def changed(path, value):
    doc = copy.deepcopy(comparison())
    at = doc
    for p in path[:-1]:
        at = at[p]
    if value is None:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return doc


CASES = {
    "good": (comparison(), {}),
    "single": (report(SHA["base"]), {}),
    "short": (changed(["runs", 0, "report", "config", "duration_seconds"], 10.0), {"protocol": "WARN"}),
    "os": (changed(["runs", 1, "report", "environment", "goos"], "darwin"), {"env.os": "FAIL"}),
    "cpus": (changed(["runs", 0, "report", "environment", "gomaxprocs"], 4), {"env.cpu_count": "FAIL"}),
    "no-cpus": (changed(["num_cpu"], None), {"env.cpu_count": "FAIL"}),
    "fs": (changed(["runs", 0, "report", "environment", "mount_options"], "unknown"), {"env.data_dir_fs": "FAIL"}),
    "primitive": (changed(["runs", 0, "report", "environment", "fsync_primitive"], "other"), {"fsync.primitive": "FAIL"}),
    "samples": (changed(["runs", 0, "report", "runs", 0, "fsync_after", "p99_ms"], None), {"fsync.samples": "FAIL"}),
    "labels": (changed(["machine_type"], " "), {"labels": "FAIL"}),
    "invalid": (changed(["runs", 0, "report", "runs", 0, "valid"], False), {"validity": "WARN"}),
    "unjudged": (changed(["runs", 0, "report", "runs", 0, "valid"], None), {"validity": "FAIL"}),
    "missing-arm": (changed(["arms"], comparison()["arms"] + [{"name": "third", "head_sha": "c" * 40}]), {"arms": "FAIL"}),
    "commit": (changed(["runs", 0, "report", "environment", "git_sha"], "d" * 40), {"arms": "FAIL"}),
}


def test_each_flaw_fails_its_check_alone(spark, tmp_path):
    for name, (doc, _) in CASES.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    units = read_reports(spark, str(tmp_path))
    got = {}
    for r in check(units).collect():
        got.setdefault(r["file"].rsplit("/", 1)[1][:-5], {})[r["check"]] = r["status"]
    for name, (_, flaws) in CASES.items():
        assert {k: v for k, v in got[name].items() if v != "PASS"} == flaws, name
        assert len(got[name]) == (8 if name == "single" else 9)
    assert runs_of(units).count() == 2 * len(CASES) - 1


def test_results_are_never_overwritten(spark, tmp_path):
    day = dt.date(2024, 5, 6)
    names = [write_result(spark, str(tmp_path), "bench", "0123456789abcdef", {"n": i}, day) for i in range(3)]
    assert names == ["2024-05-06-0123456789ab-bench.json", "2024-05-06-0123456789ab-bench-2.json", "2024-05-06-0123456789ab-bench-3.json"]
    assert json.loads((tmp_path / names[1]).read_text()) == {"n": 1}


def test_peers_keep_the_last_good_file(spark, tmp_path):
    d = PeerDirectory(spark, str(tmp_path), "peers.json", refresh=5)
    with pytest.raises(LookupError):
        d.peers(0)
    (tmp_path / "peers.json").write_text('{"1": "a:1", "2": "b:2"}')
    with pytest.raises(LookupError):
        d.peers(1)
    assert d.peers(5) == {1: "a:1", 2: "b:2"}
    (tmp_path / "peers.json").write_text("torn")
    assert d.peers(20) == {1: "a:1", 2: "b:2"}
    assert d.frame(30).count() == 2


def test_workloads(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path / "w"))
    t.append(G.sequential(spark, 300))
    assert t.live().count() == 300 and t.live().filter(F.length("value") != 64).count() == 0
    hits = lww.present(G.lookups(spark, 200, 300), t.log()).count()
    assert 60 < hits < 140 and lww.missing(G.lookups(spark, 200, 300), t.log()).count() == 200 - hits
    scans = lww.range_scans(t.log(), G.windows(spark, 20, 300, width=10))
    assert scans.count() == 200
    hot = KVTable.open(spark, str(tmp_path / "h"))
    hot.append(G.hot_keys(spark, 10, 50))
    assert hot.live().count() == 10 and hot.get("hotkey03") == (True, "val00000493")
    gone = KVTable.open(spark, str(tmp_path / "d"))
    gone.append(G.half_deleted(spark, 200))
    assert 60 < gone.live().count() < 140
    assert G.random_keys(spark, 50).select("key").distinct().count() > 40


def test_config():
    ReplicaConfig(1, (1, 2, 3)).validate()
    for bad in (ReplicaConfig(0, (1,)), ReplicaConfig(1), ReplicaConfig(1, (1, 1)), ReplicaConfig(1, (0,)), ReplicaConfig(1, (1,), election_max=6), ReplicaConfig(1, (1,), heartbeat=6), ReplicaConfig(1, (1,), check_quorum=7)):
        with pytest.raises(InvalidArgument):
            bad.validate()


def test_arm_specs(spark):
    specs = ["base=abc", " tip = def+one, two", "=x", "a b=c", "a=", "a=-x", "a=b+", "a=b+c,-d", "none", "a=b c"]
    got = [r["a"] for r in spark.createDataFrame([(i, s) for i, s in enumerate(specs)], "i long, s string").orderBy("i").select(checks.arm_spec(F.col("s")).alias("a")).collect()]
    assert tuple(got[0]) == ("base", "abc", []) and tuple(got[1]) == ("tip", "def", ["one", "two"])
    assert got[2:] == [None] * 8


def test_command_line(spark, tmp_path):
    path = str(tmp_path / "c")
    assert run(spark, [path, "put", "k", "v"]) == {"seq": 1}
    assert run(spark, [path, "get", "k"]) == {"found": True, "value": base64.b64encode(b"v").decode()}
    run(spark, [path, "flush"])
    assert run(spark, [path, "delete", "k"]) == {"seq": 2}
    assert run(spark, [path, "get", "k"]) == {"found": False, "value": None}
    run(spark, [path, "compact"])
    assert run(spark, [path, "scan", "a", "z"]) == {"pairs": []}
    assert run(spark, [path, "status"])["segments"] == 1
    with pytest.raises(SystemExit):
        run(spark, [path, "nonsense"])
