"""What the members of a replicated log decide: proposals, votes, reads, membership, snapshots.

Each function takes tables of messages or states and gives what a member would
answer or conclude, by columns and joins; nothing here is a running process.
Along a log, order is taken by blocks (``functions.running``), and events are
matched with the spans between others by cells (``functions.ranges``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import point_in_interval
from ..functions.running import previous, running_sum
from ..schema import BATCH_MAX_BYTES, BATCH_MAX_ENTRIES, MAX_ENTRY_BYTES, SNAPSHOT_CHUNK_BYTES
from .checks import normal_voters
from .raftlog import has_quorum, up_to_date

#: What an entry's data begin with if they are a change of the membership.
PREFIX = "\0member\1"
JOINT, FINAL = "joint", "final"
COMMAND = "phase string, old array<bigint>, new array<bigint>"


# --- proposals ----------------------------------------------------------------


def proposed(proposals: DataFrame, last_index: int, cap: int = MAX_ENTRY_BYTES) -> DataFrame:
    """Proposals (pos, bytes) in order, as a leader appends them: the index that each gets, 0 if it is too large; the
    others are appended anyway."""
    fits = F.when(F.col("bytes") <= cap, 1).otherwise(0).cast("long")
    counted = running_sum(proposals.withColumn("_fits", fits), [], "pos", "_fits", "_n")
    return counted.withColumn("index", F.when(F.col("_fits") == 1, F.col("_n") + last_index).otherwise(0)).drop("_fits", "_n")


def completed(proposals: DataFrame, applied: DataFrame, demotions: DataFrame) -> DataFrame:
    """How pending proposals (id, tick, index) end: ``ok`` at the first tick at which their index is applied (tick,
    applied_index, which never falls), ``not leader`` if the leader is demoted (tick) before, ``too large`` at once for
    index 0, else ``pending``."""
    p = proposals.select("id", "tick", "index")
    steps = previous(applied.select("tick", "applied_index"), [], "tick", ["applied_index"])
    steps = steps.select((F.coalesce("prev_applied_index", F.lit(0)) + 1).alias("low"), F.col("applied_index").alias("high"), F.col("tick").alias("done"))
    done = point_in_interval(p.select("id", "index").filter("index > 0"), "index", steps, "low", "high").select("id", "done")
    ends = previous(demotions.select("tick").distinct(), [], "tick", ["tick"])
    ends = ends.select((F.coalesce("prev_tick", F.lit(-(2**62))) + 1).alias("low"), F.col("tick").alias("lost"))
    lost = point_in_interval(p.select("id", F.col("tick").alias("at")), "at", ends, "low", "lost").select("id", "lost")
    met = p.join(done, "id", "left").join(lost, "id", "left")
    at = F.greatest("done", "tick")
    ok = at.isNotNull() & (F.col("lost").isNull() | (at <= F.col("lost")))
    status = F.when(F.col("index") == 0, "too large").when(ok, "ok").when(F.col("lost").isNotNull(), "not leader").otherwise("pending")
    ended = F.when(F.col("index") == 0, F.col("tick")).when(ok, at).otherwise(F.col("lost"))
    return met.select("id", "index", status.alias("status"), ended.alias("ended"))


def append_groups(queue: DataFrame, node: str = "node", most: int = BATCH_MAX_ENTRIES, cap: int = BATCH_MAX_BYTES) -> DataFrame:
    """Appends that a member persists together: in the order of its queue (pos, sender, entries, bytes, alone) a sender's
    appends in a row join until they would pass ``most`` entries or ``cap`` bytes; one that changes the hard state, cuts
    the log, brings a snapshot or changes the role (``alone``) is a group of its own. Queues stream through a task each."""
    import pyarrow as pa

    cols = [F.col(c).cast("long").alias(c) for c in (node, "pos", "entries", "bytes")]
    ordered = queue.select(*cols, F.col("sender").cast("string").alias("sender"), F.col("alone").cast("boolean").alias("alone")).repartition(node).sortWithinPartitions(node, "pos")

    def group(batches):
        held, out = None, []  # node, number, sender, first, appends, entries, bytes, closed

        def rows():
            made = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, kinds, strict=True)], [node, "grp", "sender", "first_pos", "appends", "entries", "bytes"])
            out.clear()
            return batch

        for b in batches:
            for n, pos, entries, size, sender, alone in zip(*(c.to_pylist() for c in b.columns), strict=True):
                same = held is not None and held[0] == n
                if same and not alone and not held[7] and held[2] == sender and held[5] < most and held[6] < cap and held[5] + entries <= most and held[6] + size <= cap:
                    held[4:7] = [held[4] + 1, held[5] + entries, held[6] + size]
                    continue
                if held is not None:
                    out.append(tuple(held[:7]))
                held = [n, held[1] + 1 if same else 1, sender, pos, 1, entries, size, bool(alone)]
            yield rows()
        if held is not None:
            out.append(tuple(held[:7]))
            yield rows()

    return ordered.mapInArrow(group, f"`{node}` long, grp long, sender string, first_pos long, appends long, entries long, bytes long")


def resends(sends: DataFrame, acks: DataFrame, limit: int) -> DataFrame:
    """What becomes of appends with entries (peer, tick, last), one in flight to a peer (a number): ``settled`` at the tick at
    which the peer has matched all of it (acks: peer, tick, matched; never falling), unless that takes ``limit`` ticks,
    after which it is sent again (``resend``: when)."""
    key = lambda peer, index: peer.cast("decimal(38,0)") * (1 << 62) + index
    steps = previous(acks.select("peer", "tick", "matched"), ["peer"], "tick", ["matched"])
    steps = steps.select(key(F.col("peer"), F.coalesce("prev_matched", F.lit(0)) + 1).alias("low"), key(F.col("peer"), F.col("matched")).alias("high"), F.col("tick").alias("acked"))
    asked = sends.select("peer", "tick", "last", key(F.col("peer"), F.col("last")).alias("at"))
    met = point_in_interval(asked, "at", steps, "low", "high").select("peer", "tick", F.greatest("acked", "tick").alias("settled"))
    out = sends.join(met, ["peer", "tick"], "left")
    late = F.col("settled").isNull() | (F.col("settled") - F.col("tick") >= limit)
    return out.select("peer", "tick", "last", F.when(~late, F.col("settled")).alias("settled"), F.when(late, F.col("tick") + limit).alias("resend"))


def hard_state(records: DataFrame) -> DataFrame:
    """Each member's term and vote as a restart finds them: those of its last record (node, pos, term, vote, good) before
    the first damaged one."""
    stop = F.min(F.when(~F.col("good"), F.col("pos")))
    ends = records.groupBy("node").agg(stop.alias("_stop"))
    kept = records.join(ends, "node").filter(F.col("_stop").isNull() | (F.col("pos") < F.col("_stop")))
    return kept.groupBy("node").agg(F.max_by(F.struct("term", "vote"), "pos").alias("s")).select("node", "s.term", "s.vote")


# --- votes ----------------------------------------------------------------------


def pre_vote(voter: Column, term: Column, own_term: Column, leader_is_recent: Column, newer: Column) -> Column:
    """(reject, term) of the answer to a pre-vote: granted by a voter for a term above its own, without a recent leader, to
    a log that is up to date. A grant has the term that was asked for, a refusal the own one."""
    grant = voter & (term >= own_term + 1) & ~leader_is_recent & newer
    return F.struct((~grant).alias("reject"), F.when(grant, term).otherwise(own_term).alias("term"))


def in_lease(role: Column, leader: Column, elapsed: Column, least: Column) -> Column:
    """A leader ignores votes, and so does who heard of a leader within the least election timeout."""
    return (role == "leader") | ((leader != 0) & (elapsed < least))


def votes(requests: DataFrame) -> DataFrame:
    """Answers to vote requests (voter, term, pos, candidate, last_term, last_index, own_term, own_index, is_voter, lease):
    in a term a voter grants one candidate only, the first whose log is up to date, and that one again. In lease it
    ignores the request."""
    able = F.col("is_voter") & ~F.col("lease") & up_to_date(F.col("last_term"), F.col("last_index"), F.col("own_term"), F.col("own_index"))
    held = requests.withColumn("_able", able)
    first = held.filter("_able").groupBy("voter", "term").agg(F.min_by("candidate", "pos").alias("_for"))
    answer = F.when(F.col("lease"), "ignored").when(F.col("_able") & (F.col("candidate") == F.col("_for")), "granted").otherwise("refused")
    return held.join(first, ["voter", "term"], "left").withColumn("answer", answer).drop("_able", "_for")


def election(granted: Column, refused: Column, voters: Column, joint: Column | None = None) -> Column:
    """won with a quorum of grants (of both voter sets), lost as soon as a majority of either set refused, else open."""
    lost = has_quorum(refused, voters)
    if joint is not None:
        lost = lost | ((F.size(joint) > 0) & has_quorum(refused, joint))
    return F.when(has_quorum(granted, voters, joint), "won").when(lost, "lost").otherwise("open")


# --- reads ------------------------------------------------------------------------


def read_index(probes: DataFrame, acks: DataFrame, voters: list[str], own: str) -> DataFrame:
    """Of reads that share a probe (probe, role, term, commit_index, commit_term, applied_index) what they get: the commit
    index, once a quorum has acknowledged the probe (probe, peer, term) in the leader's term and that index is applied.
    ``not ready`` before an entry of the term is committed."""
    counted = probes.select("probe", "term").join(acks.select("probe", "peer", F.col("term").alias("_t")), "probe").filter("_t = term").groupBy("probe").agg(F.collect_set("peer").alias("peers"))
    met = probes.join(counted, "probe", "left")
    by = F.array_union(F.coalesce("peers", F.array().cast("array<string>")), F.array(F.lit(own)))
    ready = (F.col("commit_index") > 0) & (F.col("commit_term") == F.col("term"))
    quorum = has_quorum(by, F.array(*map(F.lit, voters)))
    status = F.when(F.col("role") != "leader", "not leader").when(~ready, "not ready").when(~quorum, "no quorum").when(F.col("applied_index") < F.col("commit_index"), "not applied").otherwise("ok")
    return met.select("probe", status.alias("status")).join(probes.select("probe", "commit_index"), "probe").select("probe", "status", F.when(F.col("status") == "ok", F.col("commit_index")).alias("index"))


def terms_at(lookups: DataFrame, log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The term at each asked index (node, idx) of a log (node, idx, term) that begins with a snapshot (node, snap_index,
    snap_term): the snapshot's at its index, 0 before it, at 0 and beyond the end."""
    entries = log.select("node", "idx", "term").join(snapshots, "node").filter("idx > snap_index").select("node", "idx", "term")
    met = lookups.join(snapshots, "node", "left").join(entries, ["node", "idx"], "left")
    term = F.when(F.col("idx") == 0, 0).when(F.col("idx") == F.col("snap_index"), F.col("snap_term")).otherwise(F.coalesce("term", F.lit(0)))
    return met.select("node", "idx", term.cast("long").alias("term"))


# --- membership ---------------------------------------------------------------------


def encoded(phase: Column, old: Column, new: Column) -> Column:
    """The data of an entry that changes the membership."""
    return F.concat(F.lit(PREFIX), F.to_json(F.struct(phase.alias("phase"), F.when(F.size(old) > 0, old).alias("old"), new.alias("new"))))


def decoded(data: Column) -> Column:
    """(config, phase, old, new, problem) of an entry's data: whether it claims to change the membership, and what is wrong
    with it, or null. Voters come sorted."""
    config = F.coalesce(data.startswith(PREFIX), F.lit(False))
    c = F.from_json(F.substring(data, len(PREFIX) + 1, 1 << 30), COMMAND)
    new, old = normal_voters(F.coalesce(c["new"], F.array().cast("array<bigint>"))), normal_voters(F.coalesce(c["old"], F.array().cast("array<bigint>")))
    bad = F.when(c["phase"].isNull(), "not a command").when(~c["phase"].isin(JOINT, FINAL), "phase").when(new.isNull(), "new voters").when((c["phase"] == JOINT) & old.isNull(), "old voters")
    only = lambda x: F.when(config, x)
    return F.struct(config.alias("config"), only(c["phase"]).alias("phase"), only(old).alias("old"), only(new).alias("new"), only(bad).alias("problem"))


def membership_changes(entries: DataFrame, initial: list[int]) -> DataFrame:
    """The membership after each entry (idx, data) that changes it: voters, joint (empty unless a change is under way),
    and what is wrong, if something is. A joint entry must begin with the voters of the final one before it (or with the
    ``initial`` ones), a final one must end the joint one right before it."""
    config = entries.select("idx", decoded(F.col("data")).alias("c")).filter("c.config").select("idx", "c.*")
    start = F.array(*[F.lit(v).cast("long") for v in sorted(initial)])
    back = previous(config, [], "idx", ["phase", "new"])
    before = F.when(F.col("prev_phase").isNull(), start).when(F.col("prev_phase") == FINAL, F.col("prev_new"))
    wrong = F.when(F.col("phase") == JOINT, ~F.coalesce(before == F.col("old"), F.lit(False))).otherwise(~F.coalesce((F.col("prev_phase") == JOINT) & (F.col("prev_new") == F.col("new")), F.lit(False)))
    problem = F.coalesce("problem", F.when(wrong, F.concat(F.col("phase"), F.lit(" without its match"))))
    joint = F.col("phase") == JOINT
    return back.select("idx", "phase", F.when(joint, F.col("old")).otherwise(F.col("new")).alias("voters"), F.when(joint, F.col("new")).otherwise(F.array().cast("array<bigint>")).alias("joint"), problem.alias("problem"))


def change_status(asked: Column, voters: Column, joint: Column, index: Column, applied: Column) -> Column:
    """Of a pending change to ``asked``: done once these are the voters, no change is under way and it is applied."""
    return F.when((F.size(joint) == 0) & (index <= applied) & (F.array_sort(voters) == F.array_sort(asked)), "done").otherwise("pending")


def proposed_change(role: Column, joint: Column, index: Column, commit: Column, asked: Column, voters: Column) -> Column:
    """What a leader makes of a wish for other voters: a problem, ``same``, or ``joint`` (a change begins)."""
    wish = normal_voters(asked)
    return F.when(role != "leader", "not leader").when((F.size(joint) > 0) | (index > commit), "in progress").when(wish.isNull(), "voters").when(wish == voters, "same").otherwise(JOINT)


# --- snapshots ------------------------------------------------------------------------


def snapshot_answer(index: Column, term: Column, voters: Column, membership_index: Column, own_snapshot: Column, own_commit: Column, own_term_at: Column, own_last: Column) -> Column:
    """(reject, index, installed) of the answer to a snapshot: refused without an index or term, with a membership that
    isn't one or is newer than the snapshot, or where it disagrees with what is committed; the hint is then right after
    the last index. Installed only if it is newer than the own one."""
    bad = F.coalesce((index < 1) | (term < 1), F.lit(True)) | ((F.size(voters) > 0) & ~F.coalesce(normal_voters(voters) == voters, F.lit(False))) | (membership_index > index)
    bad = bad | ((index > own_snapshot) & (index <= own_commit) & (own_term_at != term))
    return F.struct(bad.alias("reject"), F.when(bad, own_last + 1).otherwise(F.greatest(index, own_snapshot)).alias("index"), (~bad & (index > own_snapshot)).alias("installed"))


def reassembled(chunks: DataFrame, meta: list[str], most: int, chunk: int = SNAPSHOT_CHUNK_BYTES) -> DataFrame:
    """Snapshot streams from their chunks (stream, seq, offset, total, checksum, data, and the columns ``meta``, which must
    be positive and stay the same): bytes and the first problem in order of arrival, or null. Offsets must be what came
    before, and what came the total, of ``most`` bytes at most, with the right CRC-32. Data are put together only for
    streams whose chunks are all right, whose size ``most`` bounds."""
    c = F.col
    along = running_sum(chunks.withColumn("_size", F.octet_length("data").cast("long")), ["stream"], "seq", "_size", "_upto")
    first = chunks.groupBy("stream").agg(F.min_by(F.struct("total", "checksum", *meta), "seq").alias("_f"), F.min("seq").alias("_first"))
    rows = along.join(first, "stream")
    same = F.lit(True)
    for m in ("total", "checksum", *meta):
        same = same & c(m).eqNullSafe(c("_f")[m])
    positive = F.lit(True)
    for m in meta:
        positive = positive & F.coalesce(c(m) > 0, F.lit(False))
    before = c("_upto") - c("_size")
    bad = (
        F.when((c("seq") == c("_first")) & ~positive, "metadata must be positive")
        .when((c("seq") == c("_first")) & (c("total") > most), "too large")
        .when(~same, "metadata changed")
        .when(c("offset") != before, "offset")
        .when(c("_size") > chunk, "chunk too large")
        .when(c("_upto") > c("total"), "beyond the total")
    )
    judged = rows.withColumn("_bad", bad)
    found = judged.groupBy("stream").agg(F.min_by("_bad", F.when(c("_bad").isNotNull(), c("seq"))).alias("_bad"), F.sum("_size").alias("bytes"), F.first("_f").alias("_f"))
    whole = chunks.join(found.filter("_bad IS NULL AND bytes = _f.total").select("stream"), "stream", "left_semi")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.hex("data").alias("x")))), lambda x: x["x"]), "")
    sums = whole.groupBy("stream").agg(F.crc32(F.unhex(text)).alias("_crc"))
    problem = F.coalesce("_bad", F.when(c("bytes") != c("_f.total"), "ended early").when(c("_crc") != c("_f.checksum"), "checksum"))
    return found.join(sums, "stream", "left").select("stream", "bytes", problem.alias("problem"))


# --- what is counted, and a network for tests ---------------------------------------------


def sync_roles(updates: DataFrame) -> DataFrame:
    """Log syncs and the entries synced, by role: an update (entries, answers) that carries entries is a follower's if it
    answers an append or a snapshot, else a leader's."""
    answers = F.exists("answers", lambda m: m.isin("append_response", "snapshot_response"))
    role = F.when(F.coalesce(answers, F.lit(False)), "follower").otherwise("leader")
    return updates.filter("entries > 0").groupBy(role.alias("role")).agg(F.count(F.lit(1)).alias("syncs"), F.sum("entries").alias("entries"))


def delivered(messages: DataFrame, links: DataFrame, paused: list[str]) -> DataFrame:
    """Messages (seq, sender, receiver, sent) as a faulty network delivers them, for tests of late, lost and reordered
    input. Links (sender, receiver, drop, delay, release, reverse; one row a link) drop, delay, or hold until a time, when
    what was sent before it comes in order or in reverse; paused members get and send nothing. Gives ``at`` and ``place``,
    by which to sort what is delivered."""
    met = messages.join(links, ["sender", "receiver"], "left")
    out = F.col("sender").isin(*paused) | F.col("receiver").isin(*paused) if paused else F.lit(False)
    kept = met.filter(~F.coalesce(F.col("drop"), F.lit(False)) & ~out)
    held = F.coalesce(F.col("sent") < F.col("release"), F.lit(False))
    at = F.when(held, F.col("release")).otherwise(F.col("sent") + F.coalesce("delay", F.lit(0)))
    place = F.when(held & F.coalesce(F.col("reverse"), F.lit(False)), -F.col("seq")).otherwise(F.col("seq"))
    return kept.select("seq", "sender", "receiver", at.alias("at"), place.alias("place"))
