"""Literal cases of the rules that results depend on."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions.running import before_max, carried, previous, running_sum
from tidemark.operators import checks, commands, lww, raftlog, stats


def log(spark, rows):
    return spark.createDataFrame(rows, "key string, value string, seq long, op int, pos int")


def test_first_of_equal_sequence_wins(spark):
    rows = [("a", "first", 1, 0, 0), ("a", "second", 1, 0, 1), ("b", "x", 1, 1, 0), ("b", "y", 1, 0, 1), ("c", None, 2, 0, 0)]
    assert {(r["key"], r["value"]) for r in lww.live_state(log(spark, rows)).collect()} == {("a", "first"), ("c", None)}


def test_bytes_order_keys(spark):
    rows = [(k, "v", i, 0, 0) for i, k in enumerate(["é", "z", "Z", "a", "", "aa"])]
    assert [r["key"] for r in lww.scan(log(spark, rows), "", "￿").collect()] == ["", "Z", "a", "aa", "z", "é"]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_running_functions_do_not_depend_on_blocks(spark, block):
    rows = spark.range(60).selectExpr("id", "id % 3 AS g", "(id * 7919) % 23 AS v")
    got = {r["id"]: r for r in running_sum(previous(before_max(rows, ["g"], "id", "v", "m", block), ["g"], "id", ["v"], block), ["g"], "id", "v", "s", block).collect()}
    for g in range(3):
        top, last, total = None, None, 0
        for i in range(g, 60, 3):
            v = i * 7919 % 23
            total += v
            assert (got[i]["m"], got[i]["prev_v"], got[i]["s"]) == (top, last, total)
            top, last = v if top is None else max(top, v), v


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_blocks_of_sparse_values(spark, block):
    rows = spark.range(40).selectExpr("id * id * 1000003 AS at", "id AS v", "CASE WHEN id % 7 = 0 THEN id END AS k")
    got = running_sum(carried(rows, [], "at", ["k"], block), [], "at", "v", "s", block).orderBy("at").collect()
    assert [(r["s"], r["last_k"]) for r in got] == [(i * (i + 1) // 2, i // 7 * 7) for i in range(40)]


def test_null_groups_are_groups(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 7), ("a", 3, 1)], "g string, id long, v long")
    got = {r["id"]: (r["m"], r["prev_v"], r["s"]) for r in running_sum(previous(before_max(df, ["g"], "id", "v", "m", 2), ["g"], "id", ["v"], 2), ["g"], "id", "v", "s", 2).collect()}
    assert got == {1: (None, None, 5), 2: (5, 5, 12), 3: (None, None, 1)}


def test_delayed_retry(spark):
    rows = [(2, "c", 1, "k", "one", "put"), (3, "c", 2, "k", "two", "put"), (4, "c", 1, "k", "one", "put"), (5, "d", 5, "k", "v1", "put"), (6, "d", 5, "k", "again", "put")]
    df = spark.createDataFrame(rows, "idx long, client_id string, request_seq long, key string, value string, operation string")
    assert [r["idx"] for r in commands.applied(df).orderBy("idx").collect()] == [2, 3, 5]
    assert [r["value"] for r in commands.state(df).collect()] == ["v1"]


@pytest.mark.parametrize(("values", "want"), [([], (0, 0, 0)), ([4], (4, 4, 4)), ([9, 1, 5], (5, 1, 9)), ([4, 1, 3, 10], (3.5, 1, 10))])
def test_describe(spark, values, want):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert tuple(stats.describe(df, [], ["v"], []).first()) == want


@pytest.mark.parametrize(("a", "b", "want"), [((10, 20), (15, 25), False), ((10, 30), (15, 20), False), ((10, 20), (20, 30), False), ((10, 20), (21, 30), True), ((31, 40), (10, 30), True)])
def test_meaningful(spark, a, b, want):
    df = spark.createDataFrame([(*map(float, a), *map(float, b))], "a_min double, a_max double, b_min double, b_max double")
    assert df.select(stats.meaningful("a", "b").alias("x")).first()["x"] is want


@pytest.mark.parametrize("n", [1, 2, 7, 100, 101])
def test_nearest_rank(spark, n):
    import math

    df = spark.range(n).selectExpr("cast(id * id AS double) AS latency")
    for q in stats.QUANTILES.values():
        assert stats.order_statistics(df, [], "latency", {"x": stats.nearest(q)}).first()["x"] == (math.ceil(q * n) - 1) ** 2
    assert stats.order_statistics(df.limit(0), [], "latency", {"x": stats.nearest(0.5)}).first()["x"] is None


def test_schedule(spark):
    got = [r["arm"] for r in stats.schedule(spark, ["base", "tip"], [1, 4], 3).orderBy("slot").collect()]
    assert got == ["base", "tip", "base", "tip", "tip", "base", "tip", "base", "base", "tip", "base", "tip"]


def test_conflict_and_hint(spark):
    rows = [(1, 1, 1), (1, 2, 3), (1, 3, 3), (2, 1, 1), (2, 2, 2), (2, 3, 2)]
    df = spark.createDataFrame(rows, "node long, idx long, term long")
    assert tuple(raftlog.first_conflict(df).first()) == (2, 2, 2)
    assert tuple(raftlog.conflict_hint(df).first()) == (2, 2, 2, 2)


def test_commit_needs_both_majorities(spark):
    matches = spark.createDataFrame([(1, "a", 5), (1, "b", 5), (1, "c", 1)], "grp long, peer string, matched long")
    sides = [("old", p) for p in "abc"] + [("new", p) for p in "abcd"]
    assert raftlog.quorum_index(matches).first()["candidate"] == 5
    assert raftlog.joint_index(matches, sides).first()["candidate"] == 1


@pytest.mark.parametrize(("candidate", "term", "commit", "want"), [(5, 3, 1, 5), (5, 4, 1, 1), (2, 2, 1, 2), (2, 3, 1, 1), (1, 3, 2, 2), (9, 3, 1, 6), (None, 3, 2, 2)])
def test_only_entries_of_the_own_term_commit(spark, candidate, term, commit, want):
    log = spark.createDataFrame([(1, i, t) for i, t in enumerate([1, 2, 2, 3, 3, 3], 1)], "grp long, idx long, entry_term long")
    states = spark.createDataFrame([(1, term, commit, 6)], "grp long, term long, commit_index long, last_index long")
    found = raftlog.committed(spark.createDataFrame([(1, candidate)], "grp long, candidate long"), log, states)
    assert found.first()["commit_index"] == want


@pytest.mark.parametrize(("nxt", "match", "reject", "acked", "hint", "want"), [
    (9, 3, True, 0, 0, (3, 8)), (9, 3, True, 0, 9, (3, 8)), (9, 3, True, 0, 12, (3, 8)), (9, 3, True, 0, 6, (3, 6)), (9, 3, True, 0, 2, (3, 4)), (1, 0, True, 0, 0, (0, 1)),
    (9, 3, False, 5, 0, (5, 6)), (9, 3, False, 3, 0, (3, 9)), (9, 3, False, 1, 0, (3, 9)), (9, 3, False, 30, 0, (12, 13)),
])
def test_answers_to_appends(spark, nxt, match, reject, acked, hint, want):
    lit = [F.lit(x).cast("boolean" if isinstance(x, bool) else "long") for x in (nxt, match, reject, acked, hint, 12)]
    assert tuple(spark.range(1).select(raftlog.match_after_response(*lit).alias("p")).first()["p"]) == want


def test_repeated_indexes_are_not_contiguous(spark):
    rows = [(1, 1), (1, 2), (1, 2), (2, 1), (2, 2), (3, 1), (3, 1), (3, 3)]
    df = spark.createDataFrame([(n, i, 1) for n, i in rows], "node long, idx long, term long")
    assert {r["node"]: r["contiguous"] for r in raftlog.contiguity(df).collect()} == {1: 0, 2: 1, 3: 0}


def test_hint_stays_above_the_snapshot(spark):
    rows = [(1, i, 3) for i in range(1, 7)] + [(2, i, 2) for i in range(1, 7)]
    df = spark.createDataFrame(rows, "node long, idx long, term long")
    assert tuple(raftlog.conflict_hint(df, snapshot_index=3).first()) == (2, 4, 2, 4)


def test_values_recorded(spark):
    one = spark.range(1)
    ok = lambda x: one.select(checks.recorded(F.lit(x).cast("string")).alias("x")).first()["x"]
    assert [ok(x) for x in ("a", " unknown", "unknown", "\t\n\u00a0", "", None)] == [True, True, False, False, False, False]


def test_arms_without_runs_are_insufficient(spark):
    rows = [("a", 1, True, float(i)) for i in range(6)] + [("b", 4, True, float(i)) for i in range(6)]
    zero = [f"cast(1 AS double) AS {v}" for v in stats.CELL if v != "throughput"]
    df = spark.createDataFrame(rows, "arm string, clients long, valid boolean, throughput double").selectExpr("*", *zero)
    got = {(r["arm"], r["clients"]): (r["base_runs"], r["other_runs"], r["ratio"], r["insufficient"]) for r in stats.compare(df, ["a", "b", "c"]).collect()}
    assert got == {("b", 1): (6, 0, 0.0, 1), ("b", 4): (0, 6, 0.0, 1), ("c", 1): (6, 0, 0.0, 1), ("c", 4): (0, 0, 0.0, 1)}
    with pytest.raises(ValueError):
        stats.compare(df, ["a", "b"], "z")


def test_capped_prefix_takes_a_large_first_entry(spark):
    df = spark.createDataFrame([(1, 1, 5000), (1, 2, 10), (2, 1, 10), (2, 2, 10), (2, 3, 5000)], "node long, idx long, bytes long")
    assert {r["node"]: r["entries"] for r in raftlog.capped_prefix(df, cap=200).collect()} == {1: 1, 2: 2}


def test_checks(spark):
    one = spark.range(1)
    c = lambda a, b: one.select(checks.same_commit(F.lit(a), F.lit(b)).alias("x")).first()["x"]
    assert c("ABCDEF1", " abcdef1234 ") and not c("abcdef", "abcdef") and not c("abcdef12", "abcdef13") and not c(None, "abcdef12")
    text = spark.createDataFrame([(1, "127.0.0.1"), (2, "10.1.2.3 and /home/someone"), (3, "2001:db8:0:0:0:0:0:1"), (4, None)], "id long, text string")
    assert {r["id"]: r["status"] for r in checks.privacy(text, "id", "text").collect()} == {1: "WARN", 2: "FAIL", 3: "FAIL", 4: "PASS"}
    parts = one.select(checks.parsed_list(F.lit(" a, ,b ,,c")).alias("x")).first()["x"]
    assert parts == ["a", "b", "c"]
    voters = lambda xs: one.select(checks.normal_voters(F.array(*map(F.lit, xs))).alias("x")).first()["x"]
    assert voters([3, 1, 2]) == [1, 2, 3] and voters([1, 1]) is None and voters([0, 1]) is None


def test_greedy_batches(spark):
    df = spark.createDataFrame([(1, i, b) for i, b in enumerate([5, 5, 5, 90, 3, 3])], "grp long, pos long, bytes long")
    got = [(r["entries"], r["size"]) for r in raftlog.greedy_batches(df, "grp", most=2, cap=50).orderBy("batch").collect()]
    assert got == [(2, 10), (1, 5), (1, 90), (2, 6)]


def test_empty_logs(spark):
    empty = log(spark, [])
    assert lww.live_state(empty).count() == lww.tombstones(empty).count() == lww.history(empty).count() == 0
    assert lww.multi_get(empty, []).count() == 0
