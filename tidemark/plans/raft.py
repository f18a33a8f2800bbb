"""Queries over replicated logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raftlog
from ..sources import derived as D

_SIDES = [("old", p) for p in ("click", "view", "error")] + [("new", p) for p in ("click", "purchase", "signup", "missing")]


def _messages(spark, sf):
    """Append messages, one for each ten log entries, and their entries, some of them malformed."""
    e = F.col("event_id")
    events = D.table(spark, sf, "events")
    m = F.col("msg")
    heads = events.select((e - e % 10).alias("msg")).distinct().select("msg", m.alias("prev_index"), (1 + F.floor(m / 2500)).cast("long").alias("prev_term"), F.when(m % 170 == 0, 0).otherwise(1 + F.floor((m + 9) / 2500)).cast("long").alias("term"))
    msg = (e - e % 10).alias("msg")
    term = F.when(e % 1103 == 0, 0).when(e % 211 == 0, F.floor(e / 2500)).otherwise(1 + F.floor(e / 2500)).cast("long").alias("entry_term")
    entries = events.select(msg, (e % 10).alias("pos"), F.when(e % 131 == 0, e + 2).otherwise(e + 1).alias("idx"), term, F.when(e % 307 == 0, 5_000_000).otherwise(F.length("props")).cast("long").alias("bytes"))
    return heads, entries


def _recovered(spark, sf):
    """Log records as read back, in file order; one is damaged."""
    e = F.col("event_id")
    return D.table(spark, sf, "events").select(e.alias("place"), F.when(e < 700, e + 1).otherwise(e + 1).alias("idx"), (e != 812).alias("good"))


def _requests(spark, sf):
    """Vote requests, one for each event."""
    e = F.col("event_id")
    return D.table(spark, sf, "events").select(e.alias("candidate"), (1 + F.floor(e / 2500)).cast("long").alias("last_term"), (e % 5000).alias("last_index"))


_VOTERS = [(i, 1 + i % 3, 900 * i) for i in range(1, 6)]
_PEERS = [f"n{i}" for i in range(7)]


def _changes(spark, sf):
    """Membership changes: peers join and leave in turn."""
    e = F.col("event_id")
    return D.table(spark, sf, "events").select(e.alias("idx"), F.when(e % 3 == 2, "leave").otherwise("join").alias("kind"), F.concat(F.lit("n"), (F.col("user_id") % 7).cast("string")).alias("peer"))


def _leaders(spark, sf):
    """Each group's leader: its term, commit index and last index; and its log. Some leaders are in a newer term than any entry."""
    m = D.match_table(spark, sf)
    e = F.col("event_id")
    last = m.groupBy("grp").agg(F.max("matched").alias("last_index"))
    term = (1 + F.floor(F.col("last_index") / 1000) + F.when(F.col("grp") % 5 == 0, 1).otherwise(0)).cast("long")
    states = last.select("grp", term.alias("term"), F.when(F.col("grp") % 7 == 0, F.col("last_index")).otherwise(3).cast("long").alias("commit_index"), "last_index")
    log = D.table(spark, sf, "events").select((F.col("user_id") % 50).alias("grp"), e.alias("idx"), (1 + F.floor(e / 1000)).cast("long").alias("entry_term"))
    return m, log, states


def _quorum_commit(spark, sf):
    m, log, states = _leaders(spark, sf)
    return raftlog.committed(raftlog.quorum_index(m).select("grp", "candidate"), log, states).select("grp", "term", "commit_index")


def _joint_commit(spark, sf):
    m, log, states = _leaders(spark, sf)
    return raftlog.committed(raftlog.joint_index(m, _SIDES), log, states).select("grp", "commit_index")


def _broken_log(spark, sf):
    """Logs of which one lacks an index, and one has an index twice and lacks another."""
    log = D.replica_log(spark, sf).filter("NOT (node = 2 AND idx = 500) AND NOT (node = 3 AND idx = 600)")
    return log.unionByName(log.filter("node = 3 AND idx = 700"))


def _responses(spark, sf):
    """Answers to appends: hints of 0, at and above next, stale ones, and acknowledgements beyond the last index."""
    e, u = F.col("event_id"), F.col("user_id")
    hint = F.when(u % 4 == 0, 0).when(u % 4 == 1, e + u % 12).otherwise(e - u % 40)
    p = raftlog.match_after_response(e + 5, e - u % 9, F.col("event_type") == "error", e + u % 14 - 5, hint, e + 6)
    return D.table(spark, sf, "events").select("event_id", p.alias("p")).select("event_id", "p.match", "p.next")


QUERIES = {
    "raft_quorum_commit": _quorum_commit,
    "raft_joint_commit": _joint_commit,
    "raft_log_conflict": lambda s, d: raftlog.first_conflict(D.replica_log(s, d)),
    "raft_conflict_hint": lambda s, d: raftlog.conflict_hint(D.replica_log(s, d)),
    "raft_malformed": lambda s, d: raftlog.malformed(*_messages(s, d)).select("msg", "pos", F.coalesce("reason", F.lit("none")).alias("reason")),
    "raft_contiguity": lambda s, d: raftlog.contiguity(_broken_log(s, d)),
    "raft_replication_lag": lambda s, d: raftlog.replication_lag(D.match_table(s, d)),
    "raft_role_transitions": lambda s, d: raftlog.role_transitions(D.statuses(s, d)),
    "raft_vote_grants": lambda s, d: raftlog.vote_grants(_requests(s, d), _VOTERS),
    "raft_membership_fold": lambda s, d: raftlog.membership_fold(_changes(s, d), _PEERS),
    "raft_capped_batch": lambda s, d: raftlog.capped_prefix(D.replica_log(s, d), cap=20_000),
    "raft_greedy_batches": lambda s, d: raftlog.greedy_batches(D.table(s, d, "events").select(F.floor(F.col("event_id") / 500).cast("long").alias("grp"), F.col("event_id").alias("pos"), F.length("props").cast("long").alias("bytes")), "grp", most=64, cap=600),
    "raft_coalesce_runs": lambda s, d: raftlog.coalesced_runs(D.table(s, d, "events").select(F.col("event_id").alias("tick"), F.col("event_type").alias("sender"))),
    "raft_valid_prefix": lambda s, d: raftlog.valid_prefix(_recovered(s, d), 100),
    "raft_after_snapshot": lambda s, d: raftlog.after_snapshot(D.replica_log(s, d), 997, 1).groupBy("node").agg(F.count(F.lit(1)).alias("entries"), F.min("idx").alias("first_idx")),
    "raft_quorum_check": lambda s, d: D.match_table(s, d).groupBy("grp").agg(F.collect_set(F.when(F.col("matched") > 400, F.col("peer"))).alias("acks")).select("grp", F.when(raftlog.has_quorum(F.col("acks"), F.array(*map(F.lit, ("click", "view", "error"))), F.array(*map(F.lit, ("click", "purchase", "signup", "missing")))), 1).otherwise(0).alias("quorum")),
    "raft_append_response": _responses,
    "raft_term_runs": lambda s, d: raftlog.term_runs(D.replica_log(s, d)),
    "raft_commit_regressions": lambda s, d: raftlog.monotone_commit(D.statuses(s, d)),
}

_V_SQL = "v(voter, term, idx) AS (VALUES (1, 2, 900), (2, 3, 1800), (3, 1, 2700), (4, 2, 3600), (5, 3, 4500))"
_STATES = """st AS (SELECT grp, 1 + max(matched) // 1000 + CASE WHEN grp % 5 = 0 THEN 1 ELSE 0 END AS term, CASE WHEN grp % 7 = 0 THEN max(matched) ELSE 3 END AS commit_index, max(matched) AS last_index FROM matches GROUP BY grp),
lg AS (SELECT user_id % 50 AS grp, event_id AS idx, 1 + event_id // 1000 AS entry_term FROM events)"""
_V = D.with_views
ORACLES = {
    # the definition itself: of all log entries of the leader's term that enough peers have, the last, if above the commit index
    "raft_quorum_commit": _V(_STATES + """,
ok AS (SELECT l.grp, l.idx FROM lg l JOIN st USING (grp) WHERE l.entry_term = st.term AND (SELECT count(*) FROM matches m WHERE m.grp = l.grp AND m.matched >= l.idx) >= (SELECT count(*) // 2 + 1 FROM matches m WHERE m.grp = l.grp))
SELECT st.grp, st.term, greatest(st.commit_index, coalesce(max(ok.idx), 0)) AS commit_index FROM st LEFT JOIN ok USING (grp) GROUP BY st.grp, st.term, st.commit_index""", "matches"),
    "raft_joint_commit": _V(_STATES + ", s(side, peer) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _SIDES) + """),
ok AS (SELECT l.grp, l.idx FROM lg l JOIN st USING (grp) WHERE l.entry_term = st.term
  AND (SELECT count(*) FROM matches m JOIN s ON s.peer = m.peer AND s.side = 'old' WHERE m.grp = l.grp AND m.matched >= l.idx) >= 2
  AND (SELECT count(*) FROM matches m JOIN s ON s.peer = m.peer AND s.side = 'new' WHERE m.grp = l.grp AND m.matched >= l.idx) >= 3)
SELECT st.grp, greatest(st.commit_index, coalesce(max(ok.idx), 0)) AS commit_index FROM st LEFT JOIN ok USING (grp) GROUP BY st.grp, st.commit_index""", "matches"),
    "raft_log_conflict": _V("SELECT f.node, min(f.idx) AS truncate_from, count(*) AS conflicts FROM rlog f JOIN rlog l ON l.node = 1 AND f.node <> 1 AND f.idx = l.idx AND f.term <> l.term GROUP BY f.node", "rlog"),
    "raft_conflict_hint": _V("""c AS (SELECT f.node, min(f.idx) AS tick FROM rlog f JOIN rlog l ON l.node = 1 AND f.node <> 1 AND f.idx = l.idx AND f.term <> l.term GROUP BY f.node),
i AS (SELECT node, idx, term, idx - row_number() OVER (PARTITION BY node, term ORDER BY idx) AS island FROM rlog)
SELECT c.node, c.tick AS truncate_from, x.term AS conflict_term, (SELECT min(y.idx) FROM i y WHERE y.node = x.node AND y.term = x.term AND y.island = x.island) AS hint FROM c JOIN i x ON x.node = c.node AND x.idx = c.tick""", "rlog"),
    "raft_malformed": """WITH h AS (SELECT event_id AS msg, event_id AS pi, 1 + event_id // 2500 AS pt, CASE WHEN event_id % 170 = 0 THEN 0 ELSE 1 + (event_id + 9) // 2500 END AS t FROM events WHERE event_id % 10 = 0),
e AS (SELECT event_id - event_id % 10 AS msg, event_id % 10 AS pos, CASE WHEN event_id % 131 = 0 THEN event_id + 2 ELSE event_id + 1 END AS idx,
  CASE WHEN event_id % 1103 = 0 THEN 0 WHEN event_id % 211 = 0 THEN event_id // 2500 ELSE 1 + event_id // 2500 END AS et, CASE WHEN event_id % 307 = 0 THEN 5000000 ELSE length(props) END AS b FROM events),
r AS (SELECT h.msg, pos, CASE WHEN idx <> pi + pos + 1 THEN 'index' WHEN et = 0 THEN 'term zero' WHEN b > 4227072 THEN 'too large' WHEN et > t THEN 'above the message term'
  WHEN et < coalesce(lag(et) OVER (PARTITION BY h.msg ORDER BY pos), pt) THEN 'below the term before' END AS reason FROM e JOIN h USING (msg))
SELECT h.msg, min(pos) FILTER (WHERE reason IS NOT NULL) AS pos, coalesce(arg_min(reason, pos) FILTER (WHERE reason IS NOT NULL), 'none') AS reason FROM h LEFT JOIN r USING (msg) GROUP BY h.msg""",
    "raft_valid_prefix": "SELECT event_id AS place, event_id + 1 AS idx FROM events WHERE event_id < 812 AND event_id + 1 > 100",
    "raft_after_snapshot": _V("SELECT node, count(*) AS entries, min(idx) AS first_idx FROM rlog WHERE idx > 997 AND node IN (SELECT node FROM rlog WHERE idx = 997 AND term = 1) GROUP BY node", "rlog"),
    "raft_quorum_check": _V("g AS (SELECT grp, count(*) FILTER (WHERE matched > 400 AND peer IN ('click', 'view', 'error')) AS a, count(*) FILTER (WHERE matched > 400 AND peer IN ('click', 'purchase', 'signup', 'missing')) AS b FROM matches GROUP BY grp) SELECT grp, CASE WHEN a >= 2 AND b >= 3 THEN 1 ELSE 0 END AS quorum FROM g", "matches"),
    "raft_append_response": """WITH r AS (SELECT event_id, event_id + 5 AS nx, event_id - user_id % 9 AS m, event_type = 'error' AS rej, event_id + user_id % 14 - 5 AS acked, event_id + 6 AS lst,
  CASE user_id % 4 WHEN 0 THEN 0 WHEN 1 THEN event_id + user_id % 12 ELSE event_id - user_id % 40 END AS hint FROM events),
t AS (SELECT *, CASE WHEN hint > 0 AND hint < nx THEN hint ELSE greatest(nx - 1, least(nx, 1)) END AS back FROM r)
SELECT event_id, CASE WHEN rej OR acked <= m THEN m ELSE least(acked, lst) END AS match, CASE WHEN rej THEN greatest(1, back, m + 1) WHEN acked <= m THEN nx ELSE least(acked, lst) + 1 END AS next FROM t""",
    "raft_contiguity": _V("l AS (SELECT * FROM rlog WHERE NOT (node = 2 AND idx = 500) AND NOT (node = 3 AND idx = 600) UNION ALL SELECT * FROM rlog WHERE node = 3 AND idx = 700), p AS (SELECT node, idx, idx - lag(idx) OVER (PARTITION BY node ORDER BY idx) AS step FROM l) SELECT x.node, CASE WHEN (SELECT count(*) FROM p WHERE p.node = x.node AND step <> 1) = 0 THEN 1 ELSE 0 END AS contiguous, min(x.idx) AS first_idx, max(x.idx) AS last_idx, arg_max(x.term, x.idx) AS last_term FROM l x GROUP BY x.node", "rlog"),
    "raft_replication_lag": _V("SELECT grp, peer, max(matched) OVER (PARTITION BY grp) - matched AS lag FROM matches", "matches"),
    "raft_role_transitions": _V("p AS (SELECT node, role, lag(role) OVER (PARTITION BY node ORDER BY tick) AS q, term, lag(term) OVER (PARTITION BY node ORDER BY tick) AS qt FROM statuses) SELECT node, count(*) FILTER (WHERE role = 'candidate' AND q IS DISTINCT FROM 'candidate') AS elections, count(*) FILTER (WHERE role = 'leader' AND q IS DISTINCT FROM 'leader') AS won, count(*) FILTER (WHERE q = 'leader' AND role <> 'leader' AND qt = term) AS lost FROM p GROUP BY node", "statuses"),
    "raft_vote_grants": f"WITH {_V_SQL}, r AS (SELECT event_id AS candidate, 1 + event_id // 2500 AS lt, event_id % 5000 AS li FROM events) SELECT candidate, count(*) FILTER (WHERE lt > term OR (lt = term AND li >= idx)) AS granted, count(*) AS voters, CASE WHEN count(*) FILTER (WHERE lt > term OR (lt = term AND li >= idx)) >= 3 THEN 1 ELSE 0 END AS won FROM r, v GROUP BY candidate",
    "raft_membership_fold": "WITH c AS (SELECT event_id AS idx, CASE WHEN event_id % 3 = 2 THEN 'leave' ELSE 'join' END AS kind, 'n' || CAST(user_id % 7 AS VARCHAR) AS peer FROM events), s AS (SELECT idx, "
    + ", ".join(f"last_value(CASE WHEN peer = '{p}' THEN kind END IGNORE NULLS) OVER (ORDER BY idx) AS k{i}" for i, p in enumerate(_PEERS))
    + " FROM c), n AS (SELECT idx AS tick, list_filter(["
    + ", ".join(f"CASE WHEN k{i} = 'join' THEN '{p}' END" for i, p in enumerate(_PEERS))
    + "], lambda x: x IS NOT NULL) AS names FROM s) SELECT tick, len(names) AS voters, array_to_string(names, ',') AS members FROM n WHERE len(names) > 0",
    "raft_capped_batch": _V("t AS (SELECT node, idx, sum(bytes + 32) OVER (PARTITION BY node ORDER BY idx) AS total, row_number() OVER (PARTITION BY node ORDER BY idx) AS r FROM rlog) SELECT node, count(*) AS entries, CAST(max(total) AS BIGINT) AS size FROM t WHERE total <= 20000 OR r = 1 GROUP BY node", "rlog"),
    "raft_greedy_batches": """WITH RECURSIVE q AS (SELECT event_id // 500 AS grp, event_id AS pos, length(props) AS bytes, row_number() OVER (PARTITION BY event_id // 500 ORDER BY event_id) AS r FROM events),
b(grp, r, batch, n, size, bytes) AS (SELECT grp, r, CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(bytes AS BIGINT), bytes FROM q WHERE r = 1
 UNION ALL SELECT q.grp, q.r, CASE WHEN b.n >= 64 OR b.size + q.bytes > 600 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.n >= 64 OR b.size + q.bytes > 600 THEN 1 ELSE b.n + 1 END,
  CASE WHEN b.n >= 64 OR b.size + q.bytes > 600 THEN q.bytes ELSE b.size + q.bytes END, q.bytes FROM b JOIN q ON q.grp = b.grp AND q.r = b.r + 1)
SELECT grp, batch, count(*) AS entries, CAST(sum(bytes) AS BIGINT) AS size FROM b GROUP BY grp, batch""",
    "raft_coalesce_runs": "WITH p AS (SELECT event_id AS tick, event_type AS sender, CASE WHEN lag(event_type) OVER (ORDER BY event_id) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS new FROM events), r AS (SELECT *, CAST(sum(new) OVER (ORDER BY tick) AS BIGINT) AS run FROM p) SELECT run, min(sender) AS sender, count(*) AS messages, min(tick) AS first_tick FROM r GROUP BY run",
    "raft_term_runs": _V("p AS (SELECT *, CASE WHEN lag(term) OVER (PARTITION BY node ORDER BY idx) IS DISTINCT FROM term THEN 1 ELSE 0 END AS new FROM rlog), r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY node ORDER BY idx) AS BIGINT) AS run FROM p) SELECT node, run, min(term) AS term, min(idx) AS first_idx, max(idx) AS last_idx FROM r GROUP BY node, run", "rlog"),
    "raft_commit_regressions": _V("p AS (SELECT node, tick, commit_index, max(commit_index) OVER (PARTITION BY node ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM statuses) SELECT * FROM p WHERE commit_index < before", "statuses"),
}
