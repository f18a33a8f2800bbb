"""Queries of what a log's members decide, and of slots and report lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, stats
from ..operators import consensus as C
from ..sources import derived as D

def _e():
    return F.col("event_id")


def _u():
    return F.col("user_id")


def _events(spark, sf):
    return D.table(spark, sf, "events")


def _proposals(spark, sf):
    """Proposals, some too large."""
    return _events(spark, sf).select(_e().alias("pos"), F.when(_e() % 37 == 0, 5_000_000).otherwise(F.length("props")).cast("long").alias("bytes"))


def _completed(spark, sf):
    """Each event proposes at its tick; indexes are applied in steps of seven; the leader is demoted now and then."""
    p = C.proposed(_proposals(spark, sf), 100).select(F.col("pos").alias("id"), F.col("pos").alias("tick"), "index")
    steps = _events(spark, sf).select((F.floor(_e() / 7) * 7 + 20).cast("long").alias("tick"), (F.floor(_e() / 7) * 7 + 95).cast("long").alias("applied_index")).distinct()
    lost = _events(spark, sf).select((F.floor(_e() / 300) * 300 + 299).cast("long").alias("tick")).distinct()
    return C.completed(p, steps, lost)


def _queue(spark, sf):
    """Appends in the queues of three members."""
    return _events(spark, sf).select((_e() % 3).alias("node"), _e().alias("pos"), (_u() % 2).cast("string").alias("sender"), (_e() % 5).alias("entries"), (_e() % 11 * 10).alias("bytes"), (_e() % 41 == 0).alias("alone"))


def _votes(spark, sf):
    req = _events(spark, sf).select((_e() % 5).alias("voter"), (1 + F.floor(_e() / 100)).cast("long").alias("term"), _e().alias("pos"), (_u() % 4).alias("candidate"), (_e() % 6).alias("last_term"), (_e() % 50).alias("last_index"), F.lit(3).cast("long").alias("own_term"), (_u() % 30).alias("own_index"), (_e() % 23 > 0).alias("is_voter"), (_e() % 19 == 0).alias("lease"))
    return C.votes(req).select("voter", "term", "pos", "candidate", "answer")


def _tally(spark, sf):
    """Elections decided by the answers of a term, of the old voters and, every third term, of new ones too."""
    v = _votes(spark, sf).groupBy("term").agg(F.collect_set(F.when(F.col("answer") == "granted", F.col("voter"))).alias("g"), F.collect_set(F.when(F.col("answer") == "refused", F.col("voter"))).alias("r"))
    old, new = F.array(*[F.lit(i).cast("long") for i in (0, 1, 2)]), F.array(*[F.lit(i).cast("long") for i in (2, 3, 4)])
    joint = F.when(F.col("term") % 3 == 0, new).otherwise(F.array().cast("array<bigint>"))
    r = F.array_except("r", "g")
    return v.select("term", C.election(F.col("g"), r, old, joint).alias("outcome"))


def _reads(spark, sf):
    probes = _events(spark, sf).select(_e().alias("probe"), F.when(_e() % 29 == 0, "follower").otherwise("leader").alias("role"), (1 + _e() % 3).alias("term"), (_e() % 50).alias("commit_index"), (1 + _e() % 4).alias("commit_term"), (_e() % 50 - F.when(_u() % 5 == 0, 1).otherwise(0)).alias("applied_index"))
    acks = _events(spark, sf).select((_e() - _e() % 2).alias("probe"), F.concat(F.lit("n"), (_u() % 6).cast("string")).alias("peer"), (1 + (_e() - _e() % 2) % 3).alias("term"))
    return C.read_index(probes, acks, ["n0", "n1", "n2"], "n0")


def _lookups(spark, sf):
    log = D.replica_log(spark, sf)
    snaps = spark.createDataFrame([(1, 0, 0), (2, 100, 7), (3, 4000, 2)], "node long, snap_index long, snap_term long")
    asked = _events(spark, sf).select((1 + _u() % 3).alias("node"), (_e() * 2).alias("idx")).distinct()
    return C.terms_at(asked, log, snaps)


def _entries(spark, sf):
    """A log with changes of the membership: joint and final in turn, some damaged, among other data."""
    k = F.floor(_e() / 10).cast("long")
    voters = lambda x: F.array(F.lit(1).cast("long"), F.lit(2).cast("long"), 3 + x % 4)
    phase = F.when(k % 2 == 0, "joint").otherwise("final")
    old, new = voters(F.floor(k / 2)), voters(F.floor(k / 2) + 1)
    good = C.encoded(phase, F.when(k % 2 == 0, old).otherwise(F.array().cast("array<bigint>")), F.reverse(new))
    data = F.when(_e() % 10 != 0, F.col("props")).when(k % 31 == 7, F.concat(F.lit(C.PREFIX), F.lit("{"))).when(k % 31 == 12, C.encoded(F.lit("joint"), old, F.array(F.lit(1).cast("long"), F.lit(1).cast("long")))).when(k % 31 == 18, C.encoded(F.lit("other"), old, new)).otherwise(good)
    return _events(spark, sf).select(_e().alias("idx"), data.alias("data"))


def _membership(spark, sf):
    m = C.membership_changes(_entries(spark, sf), [1, 2, 3])
    return m.select("idx", F.coalesce("phase", F.lit("-")).alias("phase"), F.array_join(F.coalesce("voters", F.array().cast("array<bigint>")), ",").alias("voters"), F.array_join(F.coalesce("joint", F.array().cast("array<bigint>")), ",").alias("joint"), F.coalesce("problem", F.lit("none")).alias("problem"))


def _changes(spark, sf):
    asked, voters = F.array(_u() % 4, (_u() % 4) + 1, F.lit(5).cast("long")), F.array(F.lit(1).cast("long"), F.lit(2).cast("long"), F.lit(5).cast("long"))
    joint = F.when(_e() % 9 == 0, voters).otherwise(F.array().cast("array<bigint>"))
    return _events(spark, sf).select("event_id", C.proposed_change(F.when(_e() % 13 == 0, "follower").otherwise("leader"), joint, _e() % 7, _e() % 8, asked, voters).alias("wish"), C.change_status(F.reverse(asked), voters, joint, _e() % 7, _e() % 8).alias("status"))


def _snapshots(spark, sf):
    v = F.when(_e() % 17 == 0, F.array(F.lit(2), F.lit(1))).when(_e() % 5 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1), F.lit(2)))
    a = C.snapshot_answer(_e() % 40, 1 + _e() % 3 - F.when(_e() % 11 == 0, 5).otherwise(0), v, _u() % 41, _e() % 23, _e() % 30, 1 + _u() % 3, _e() % 30 + 4)
    return _events(spark, sf).select("event_id", a.alias("a")).select("event_id", "a.*")


def _chunks(spark, sf):
    """Streams of up to a hundred chunks, some with a gap, a wrong total, changed metadata or a wrong sum."""
    s, q = F.floor(_e() / 100).cast("long"), _e() % 100
    sized = _events(spark, sf).select(s.alias("stream"), q.alias("seq"), F.col("props").cast("binary").alias("data"))
    whole = sized.groupBy("stream").agg(F.sum(F.octet_length("data")).cast("long").alias("t"), F.crc32(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("data").cast("string").alias("d")))), lambda x: x["d"]), "").cast("binary")).alias("c"))
    from ..functions.running import running_sum

    along = running_sum(sized.withColumn("n", F.octet_length("data").cast("long")), ["stream"], "seq", "n", "upto").join(whole, "stream")
    k = F.col("stream") % 7
    return along.select("stream", "seq", "data", (F.col("upto") - F.col("n") + F.when((k == 1) & (F.col("seq") == 5), 1).otherwise(0)).alias("offset"), (F.col("t") + F.when(k == 2, 3).otherwise(0)).alias("total"), (F.col("c") + F.when(k == 3, 1).otherwise(0)).alias("checksum"), F.when((k == 4) & (F.col("seq") == 50), 9).otherwise(F.col("stream") + 1).cast("long").alias("snap_index"), F.when(k == 5, 0).otherwise(2).cast("long").alias("snap_term"))


def _updates(spark, sf):
    answers = F.when(_e() % 3 == 0, F.array(F.lit("append"), F.lit("append_response"))).when(_e() % 7 == 0, F.array(F.lit("snapshot_response"))).when(_e() % 5 == 0, F.array(F.lit("append"))).otherwise(F.array().cast("array<string>"))
    return _events(spark, sf).select((_e() % 6).alias("entries"), answers.alias("answers"))


def _resends(spark, sf):
    """One append in five ticks to each of three peers; some answers are late or never come."""
    sends = _events(spark, sf).select((_e() % 3).alias("peer"), (_e() - _e() % 3).alias("tick"), _e().alias("last"))
    acks = _events(spark, sf).filter("event_type <> 'error'").select((_e() % 3).alias("peer"), (_e() - _e() % 3 + 4).alias("tick"), _e().alias("matched"))
    return C.resends(sends, acks, 5)


def _hard_states(spark, sf):
    return C.hard_state(_events(spark, sf).select((_u() % 10).alias("node"), _e().alias("pos"), F.floor(_e() / 50).cast("long").alias("term"), (_u() % 4).alias("vote"), ((_e() < 700) | (_u() % 3 > 0)).alias("good")))


def _exposed(spark, sf):
    g = _events(spark, sf).groupBy("event_type", (_u() % 3).alias("n")).agg(F.count(F.lit(1)).alias("value"))
    return stats.exposition(g.select(F.lit("events_total").alias("name"), F.create_map(F.lit("type"), "event_type", F.lit("node"), F.concat(F.lit('n"'), F.col("n").cast("string"))).alias("labels"), "value"))


def _delivered(spark, sf):
    m = _events(spark, sf).select(_e().alias("seq"), F.col("event_type").alias("sender"), (_u() % 3).cast("string").alias("receiver"), _e().alias("sent"))
    links = spark.createDataFrame([("click", "0", True, None, None, None), ("view", "1", None, 40, None, None), ("error", "2", None, None, 500, True), ("error", "0", None, None, 300, False)], "sender string, receiver string, drop boolean, delay long, release long, reverse boolean")
    return C.delivered(m, links, ["signup"])


def _slots(spark, sf):
    extra = F.when(_e() % 3 == 0, F.array(F.lit("-official"))).when(_e() % 5 == 0, F.array(F.lit("--out=x"), F.lit("-official=false"))).when(_e() % 7 == 0, F.array(F.lit("-official"), F.lit("--official=0"))).otherwise(F.array(F.lit("plain")))
    machine, disk = F.when(_e() % 4 == 0, " ").otherwise("m"), F.when(_e() % 6 == 0, "").otherwise("ssd")
    usage = F.when(_e() % 2 == 0, "flags\n  -machine-type string\n\t-disk-type string\n").otherwise("flags -machine-type x")
    return _events(spark, sf).select("event_id", F.array_join(checks.slot_args(_e() % 5, F.lit("o"), extra, machine, disk, checks.accepts_labels(usage)), " ").alias("args"), F.coalesce(checks.extra_problem(extra), F.lit("none")).alias("own"), checks.machine_labels_missing(extra, machine, disk).alias("unlabelled"), F.coalesce(checks.run_label(F.when(_e() % 8 == 0, "darwin").otherwise("linux"), checks.passes_official(extra)), F.lit("refused")).alias("label"))


def _lines(spark, sf):
    status = F.element_at(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("PASS"), F.lit("FAIL")), F.when(_e() % 97 == 0, 4).otherwise(_e() % 3 + 1).cast("int"))
    rows = _events(spark, sf).select(F.floor(_e() / 9).cast("long").alias("file"), (_e() % 9).alias("place"), status.alias("status"), F.concat(F.lit("check."), (_e() % 9).cast("string")).alias("check"), F.col("event_type").alias("detail"))
    return checks.verdict(rows, "file")


QUERIES = {
    "net_proposed": lambda s, d: C.proposed(_proposals(s, d), 100).select("pos", "index"),
    "net_completed": _completed,
    "net_append_groups": lambda s, d: C.append_groups(_queue(s, d), most=12, cap=300),
    "net_pre_votes": lambda s, d: _events(s, d).select("event_id", C.pre_vote(_e() % 9 > 0, _e() % 5, _u() % 4, C.in_lease(F.when(_e() % 31 == 0, "leader").otherwise("follower"), _u() % 2, _e() % 20, F.lit(6)), C.up_to_date(_e() % 3, _e() % 50, _u() % 3, _u() % 50)).alias("p")).select("event_id", "p.reject", "p.term"),
    "net_votes": _votes,
    "net_elections": _tally,
    "net_read_index": _reads,
    "net_terms_at": _lookups,
    "net_membership": _membership,
    "net_change_wishes": _changes,
    "net_snapshot_answers": _snapshots,
    "net_reassembled": lambda s, d: C.reassembled(_chunks(s, d), ["snap_index", "snap_term"], 1 << 20).select("stream", "bytes", F.coalesce("problem", F.lit("none")).alias("problem")),
    "net_sync_roles": lambda s, d: C.sync_roles(_updates(s, d)),
    "net_delivered": _delivered,
    "net_resends": _resends,
    "net_hard_state": _hard_states,
    "net_exposition": _exposed,
    "chk_slots": _slots,
    "chk_lines": _lines,
}

_PROPOSED = "p AS (SELECT event_id AS pos, CASE WHEN event_id % 37 = 0 THEN 0 ELSE 100 + count(*) FILTER (WHERE event_id % 37 <> 0) OVER (ORDER BY event_id) END AS index FROM events)"
_VOTES = """r AS (SELECT event_id % 5 AS voter, 1 + event_id // 100 AS term, event_id AS pos, user_id % 4 AS candidate, event_id % 19 = 0 AS lease,
  event_id % 23 > 0 AND event_id % 19 <> 0 AND (event_id % 6 > 3 OR (event_id % 6 = 3 AND event_id % 50 >= user_id % 30)) AS able FROM events),
f AS (SELECT voter, term, arg_min(candidate, pos) AS who FROM r WHERE able GROUP BY voter, term),
v AS (SELECT r.voter, r.term, pos, candidate, CASE WHEN lease THEN 'ignored' WHEN able AND candidate = who THEN 'granted' ELSE 'refused' END AS answer FROM r LEFT JOIN f ON f.voter = r.voter AND f.term = r.term)"""
_NEW = "[1, 2, 3 + (k // 2 + 1) % 4]"
_OLD = "[1, 2, 3 + (k // 2) % 4]"
ORACLES = {
    "net_proposed": f"WITH {_PROPOSED} SELECT pos, index FROM p",
    "net_completed": f"""WITH {_PROPOSED}, a AS (SELECT DISTINCT event_id // 7 * 7 + 20 AS tick, event_id // 7 * 7 + 95 AS upto FROM events), l AS (SELECT DISTINCT event_id // 300 * 300 + 299 AS tick FROM events),
s AS (SELECT pos AS id, pos, index, (SELECT min(tick) FROM a WHERE upto >= index) AS done, (SELECT min(tick) FROM l WHERE tick >= pos) AS lost FROM p),
g AS (SELECT *, greatest(done, pos) AS fin FROM s)
SELECT id, index, CASE WHEN index = 0 THEN 'too large' WHEN done IS NOT NULL AND (lost IS NULL OR fin <= lost) THEN 'ok' WHEN lost IS NOT NULL THEN 'not leader' ELSE 'pending' END AS status,
  CASE WHEN index = 0 THEN pos WHEN done IS NOT NULL AND (lost IS NULL OR fin <= lost) THEN fin ELSE lost END AS ended FROM g""",
    "net_append_groups": """WITH RECURSIVE q AS (SELECT event_id % 3 AS node, event_id AS pos, CAST(user_id % 2 AS VARCHAR) AS sender, event_id % 5 AS entries, event_id % 11 * 10 AS bytes, event_id % 41 = 0 AS alone, row_number() OVER (PARTITION BY event_id % 3 ORDER BY event_id) AS r FROM events),
w(node, r, grp, sender, n, size, alone, pos, entries, bytes) AS (SELECT node, r, CAST(1 AS BIGINT), sender, entries, bytes, alone, pos, entries, bytes FROM q WHERE r = 1
 UNION ALL SELECT q.node, q.r, CASE WHEN j THEN grp ELSE grp + 1 END, q.sender, CASE WHEN j THEN n + q.entries ELSE q.entries END, CASE WHEN j THEN size + q.bytes ELSE q.bytes END, q.alone, q.pos, q.entries, q.bytes
 FROM (SELECT w.*, q2.r AS nr, NOT q2.alone AND NOT w.alone AND q2.sender = w.sender AND w.n < 12 AND w.size < 300 AND w.n + q2.entries <= 12 AND w.size + q2.bytes <= 300 AS j FROM w JOIN q q2 ON q2.node = w.node AND q2.r = w.r + 1) x JOIN q ON q.node = x.node AND q.r = x.nr)
SELECT node, grp, min(sender) AS sender, min(pos) AS first_pos, count(*) AS appends, CAST(sum(entries) AS BIGINT) AS entries, CAST(sum(bytes) AS BIGINT) AS bytes FROM w GROUP BY node, grp""",
    "net_pre_votes": """WITH g AS (SELECT event_id, event_id % 5 AS t, user_id % 4 AS own, event_id % 9 > 0 AND event_id % 5 >= user_id % 4 + 1 AND NOT (event_id % 31 = 0 OR (user_id % 2 <> 0 AND event_id % 20 < 6))
  AND (event_id % 3 > user_id % 3 OR (event_id % 3 = user_id % 3 AND event_id % 50 >= user_id % 50)) AS ok FROM events) SELECT event_id, NOT ok AS reject, CASE WHEN ok THEN t ELSE own END AS term FROM g""",
    "net_votes": f"WITH {_VOTES} SELECT * FROM v",
    "net_elections": f"""WITH {_VOTES}, b AS (SELECT term, voter, bool_or(answer = 'granted') AS g, bool_or(answer = 'refused') AS r FROM v GROUP BY term, voter),
c AS (SELECT term, count(*) FILTER (WHERE g AND voter < 3) AS go, count(*) FILTER (WHERE g AND voter > 1) AS gn, count(*) FILTER (WHERE r AND NOT g AND voter < 3) AS ro, count(*) FILTER (WHERE r AND NOT g AND voter > 1) AS rn FROM b GROUP BY term)
SELECT term, CASE WHEN go >= 2 AND (term % 3 <> 0 OR gn >= 2) THEN 'won' WHEN ro >= 2 OR (term % 3 = 0 AND rn >= 2) THEN 'lost' ELSE 'open' END AS outcome FROM c""",
    "net_read_index": """WITH p AS (SELECT event_id AS probe, event_id % 29 = 0 AS other, 1 + event_id % 3 AS t, event_id % 50 AS c, 1 + event_id % 4 AS ct, event_id % 50 - CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END AS a FROM events),
k AS (SELECT event_id - event_id % 2 AS probe, 'n' || CAST(user_id % 6 AS VARCHAR) AS peer FROM events),
n AS (SELECT p.probe, count(DISTINCT peer) FILTER (WHERE peer IN ('n1', 'n2')) AS n FROM p LEFT JOIN k ON k.probe = p.probe GROUP BY p.probe)
SELECT p.probe, CASE WHEN other THEN 'not leader' WHEN NOT (c > 0 AND ct = t) THEN 'not ready' WHEN n < 1 THEN 'no quorum' WHEN a < c THEN 'not applied' ELSE 'ok' END AS status, CASE WHEN NOT other AND c > 0 AND ct = t AND n >= 1 AND a >= c THEN c END AS index FROM p JOIN n USING (probe)""",
    "net_terms_at": D.with_views("""s(node, si, st) AS (VALUES (1, 0, 0), (2, 100, 7), (3, 4000, 2)), q AS (SELECT DISTINCT 1 + user_id % 3 AS node, event_id * 2 AS idx FROM events)
SELECT q.node, q.idx, CASE WHEN q.idx = 0 THEN 0 WHEN q.idx = si THEN st WHEN q.idx < si THEN 0 ELSE coalesce(term, 0) END AS term FROM q JOIN s ON s.node = q.node LEFT JOIN rlog l ON l.node = q.node AND l.idx = q.idx""", "rlog"),
    "net_membership": f"""WITH e AS (SELECT event_id AS idx, event_id // 10 AS k FROM events WHERE event_id % 10 = 0),
d AS (SELECT idx, k, CASE k % 31 WHEN 7 THEN '-' WHEN 12 THEN 'joint' WHEN 18 THEN 'other' ELSE CASE WHEN k % 2 = 0 THEN 'joint' ELSE 'final' END END AS phase,
  CASE WHEN k % 31 = 7 OR (k % 31 NOT IN (12, 18) AND k % 2 = 1) THEN NULL ELSE {_OLD} END AS o, CASE WHEN k % 31 IN (7, 12) THEN NULL ELSE {_NEW} END AS n,
  CASE k % 31 WHEN 7 THEN 'not a command' WHEN 12 THEN 'new voters' WHEN 18 THEN 'phase' END AS bad FROM e),
p AS (SELECT *, lag(phase) OVER (ORDER BY idx) AS pp, lag(n) OVER (ORDER BY idx) AS pn, row_number() OVER (ORDER BY idx) AS r FROM d),
w AS (SELECT *, CASE WHEN phase = 'joint' THEN NOT coalesce(CASE WHEN r = 1 OR pp = '-' THEN [1, 2, 3] = o WHEN pp = 'final' THEN pn = o END, false) ELSE NOT coalesce(pp = 'joint' AND pn = n, false) END AS wrong FROM p)
SELECT idx, phase, coalesce(array_to_string(CASE WHEN phase = 'joint' THEN o ELSE n END, ','), '') AS voters, coalesce(array_to_string(CASE WHEN phase = 'joint' THEN n END, ','), '') AS joint,
  coalesce(bad, CASE WHEN wrong THEN phase || ' without its match' END, 'none') AS problem FROM w""",
    "net_change_wishes": """WITH c AS (SELECT event_id, [user_id % 4, user_id % 4 + 1, 5] AS a, event_id % 9 = 0 AS j, event_id % 7 AS i, event_id % 8 AS m, event_id % 13 = 0 AS f FROM events)
SELECT event_id, CASE WHEN f THEN 'not leader' WHEN j OR i > m THEN 'in progress' WHEN list_contains(a, 0) OR len(list_distinct(a)) < 3 THEN 'voters' WHEN list_sort(a) = [1, 2, 5] THEN 'same' ELSE 'joint' END AS wish,
  CASE WHEN NOT j AND i <= m AND list_sort(a) = [1, 2, 5] THEN 'done' ELSE 'pending' END AS status FROM c""",
    "net_snapshot_answers": """WITH s AS (SELECT event_id, event_id % 40 AS i, 1 + event_id % 3 - CASE WHEN event_id % 11 = 0 THEN 5 ELSE 0 END AS t, event_id % 17 = 0 AS unsorted, user_id % 41 AS m, event_id % 23 AS own, event_id % 30 AS c, 1 + user_id % 3 AS ta, event_id % 30 + 4 AS l FROM events),
b AS (SELECT *, i < 1 OR t < 1 OR unsorted OR m > i OR (i > own AND i <= c AND ta <> t) AS bad FROM s) SELECT event_id, bad AS reject, CASE WHEN bad THEN l + 1 ELSE greatest(i, own) END AS index, NOT bad AND i > own AS installed FROM b""",
    "net_reassembled": """WITH g AS (SELECT event_id // 100 AS stream, sum(strlen(props)) AS bytes, count(*) AS n FROM events GROUP BY 1)
SELECT stream, CAST(bytes AS BIGINT) AS bytes, CASE stream % 7 WHEN 1 THEN CASE WHEN n > 5 THEN 'offset' ELSE 'none' END WHEN 2 THEN 'ended early' WHEN 3 THEN 'checksum' WHEN 4 THEN CASE WHEN n > 50 AND stream + 1 <> 9 THEN 'metadata changed' ELSE 'none' END WHEN 5 THEN 'metadata must be positive' ELSE 'none' END AS problem FROM g""",
    "net_sync_roles": "SELECT CASE WHEN event_id % 3 = 0 OR event_id % 7 = 0 THEN 'follower' ELSE 'leader' END AS role, count(*) AS syncs, CAST(sum(event_id % 6) AS BIGINT) AS entries FROM events WHERE event_id % 6 > 0 GROUP BY 1",
    "net_resends": """WITH s AS (SELECT event_id % 3 AS peer, event_id - event_id % 3 AS tick, event_id AS last FROM events), a AS (SELECT event_id % 3 AS peer, event_id - event_id % 3 + 4 AS tick, event_id AS matched FROM events WHERE event_type <> 'error'),
m AS (SELECT s.peer, s.tick, s.last, min(a.tick) AS ack FROM s LEFT JOIN a ON a.peer = s.peer AND a.matched >= s.last GROUP BY ALL)
SELECT peer, tick, last, CASE WHEN ack - tick < 5 THEN ack END AS settled, CASE WHEN ack IS NULL OR ack - tick >= 5 THEN tick + 5 END AS resend FROM m""",
    "net_hard_state": """WITH r AS (SELECT user_id % 10 AS node, event_id AS pos, event_id // 50 AS term, user_id % 4 AS vote, event_id < 700 OR user_id % 3 > 0 AS good FROM events)
SELECT node, arg_max(term, pos) AS term, arg_max(vote, pos) AS vote FROM r x WHERE NOT EXISTS (SELECT 1 FROM r y WHERE y.node = x.node AND NOT y.good AND y.pos <= x.pos) GROUP BY node""",
    "net_exposition": """SELECT 'events_total{node="n\\"' || user_id % 3 || '",type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type, user_id % 3""",
    "net_delivered": """SELECT event_id AS seq, event_type AS sender, CAST(user_id % 3 AS VARCHAR) AS receiver,
  CASE WHEN event_type = 'error' AND user_id % 3 = 2 AND event_id < 500 THEN 500 WHEN event_type = 'error' AND user_id % 3 = 0 AND event_id < 300 THEN 300 WHEN event_type = 'view' AND user_id % 3 = 1 THEN event_id + 40 ELSE event_id END AS at,
  CASE WHEN event_type = 'error' AND user_id % 3 = 2 AND event_id < 500 THEN -event_id ELSE event_id END AS place
FROM events WHERE event_type <> 'signup' AND NOT (event_type = 'click' AND user_id % 3 = 0)""",
    "chk_slots": """WITH x AS (SELECT event_id AS e, CASE WHEN event_id % 3 = 0 THEN '-official' WHEN event_id % 5 = 0 THEN '--out=x -official=false' WHEN event_id % 7 = 0 THEN '-official --official=0' ELSE 'plain' END AS extra, CASE WHEN event_id % 4 = 0 THEN ' ' ELSE 'm' END AS m, CASE WHEN event_id % 6 = 0 THEN '' ELSE 'ssd' END AS d FROM events)
SELECT e AS event_id, '-clients=' || (e % 5) || ' -repetitions=1 -out=o ' || CASE WHEN e % 2 = 0 AND d <> '' THEN '-machine-type=' || m || ' -disk-type=' || d || ' ' ELSE '' END || extra AS args, CASE WHEN e % 3 <> 0 AND e % 5 = 0 THEN 'out' ELSE 'none' END AS own,
  e % 3 = 0 AND (trim(m) = '' OR d = '') AS unlabelled, CASE WHEN e % 3 <> 0 THEN 'secondary' WHEN e % 8 = 0 THEN 'refused' ELSE 'official' END AS label FROM x""",
    "chk_lines": """WITH r AS (SELECT event_id // 9 AS file, event_id % 9 AS place, ['PASS', 'WARN', 'PASS', 'FAIL'][CASE WHEN event_id % 97 = 0 THEN 4 ELSE event_id % 3 + 1 END] AS s, event_type AS d FROM events)
SELECT file, string_agg(rpad(s, 4, ' ') || '  ' || rpad('check.' || place, 16, ' ') || ' ' || d, chr(10) ORDER BY place) AS lines,
  'result: ' || CASE WHEN count(*) FILTER (WHERE s = 'FAIL') > 0 THEN 'FAIL' ELSE 'PASS' END || ' (' || count(*) FILTER (WHERE s = 'FAIL') || ' failed, ' || count(*) FILTER (WHERE s = 'WARN') || ' warnings)' AS result FROM r GROUP BY file""",
}
