"""Replicated-log computations: commit, conflicts, quorums, membership and batching.

Logs have columns node, idx and term (and bytes). Everything that looks at the
row before does so block by block, so that one long log is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.running import before_max, carried, previous, running_sum
from ..schema import APPEND_CAP_BYTES, BATCH_MAX_BYTES, BATCH_MAX_ENTRIES, ENTRY_OVERHEAD_BYTES, MAX_ENTRY_BYTES

CHUNK = 1000


def majority(n: Column) -> Column:
    return F.floor(n / 2).cast("long") + 1


def quorum_index(matches: DataFrame, group: str = "grp") -> DataFrame:
    """The highest index that a majority of each group's peers has: the n/2+1-th largest match. Peers are few."""
    w = Window.partitionBy(group).orderBy(F.col("matched").desc(), F.col("peer"))
    sized = matches.withColumn("r", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(group)))
    return sized.filter(F.col("r") == majority(F.col("n"))).select(group, F.col("n").alias("peers"), F.col("matched").alias("candidate"))


def joint_index(matches: DataFrame, members: list[tuple[str, str]], group: str = "grp") -> DataFrame:
    """While membership changes an index needs a majority of both voter sets (members: side and peer, few); a voter that
    hasn't answered matches 0."""
    listed = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(p).alias("peer")) for s, p in members])
    voters = matches.select(group).distinct().select(group, F.explode(listed).alias("m")).select(group, "m.side", "m.peer")
    full = voters.join(matches, [group, "peer"], "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    w = Window.partitionBy(group, "side").orderBy(F.col("matched").desc(), F.col("peer"))
    sized = full.withColumn("r", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(group, "side")))
    return sized.filter(F.col("r") == majority(F.col("n"))).groupBy(group).agg(F.min("matched").alias("candidate"))


def committed(candidates: DataFrame, log: DataFrame, states: DataFrame, group: str = "grp") -> DataFrame:
    """The commit index of each group's leader (states: group, term, commit_index, last_index) when a quorum has
    ``candidate``: it goes up to the candidate only if that is in the leader's log (group, idx, entry_term) and of the
    leader's own term, and never back. Terms don't fall along a log, so no lower index can be of that term if the
    candidate isn't."""
    held = states.join(candidates, group, "left").withColumn("at", F.when(F.col("candidate").isNotNull(), F.least("candidate", "last_index")))
    at = log.select(F.col(group).alias("_g"), F.col("idx").alias("at"), "entry_term")
    met = held.join(at, (held[group] == at["_g"]) & (held["at"] == at["at"]), "left").drop("_g").select(*[held[c] for c in held.columns], "entry_term")
    up = F.when(F.col("entry_term") == F.col("term"), F.greatest("commit_index", "at")).otherwise(F.col("commit_index"))
    return met.withColumn("commit_index", up).drop("at", "entry_term", "candidate")


def first_conflict(log: DataFrame, leader: int = 1) -> DataFrame:
    """For each follower the first index where its term differs from the leader's, and how many do."""
    ours = log.filter(F.col("node") == leader).select("idx", F.col("term").alias("leader_term"))
    theirs = log.filter(F.col("node") != leader).select("node", "idx", "term")
    return theirs.join(ours, "idx").filter("term <> leader_term").groupBy("node").agg(F.min("idx").alias("truncate_from"), F.count(F.lit(1)).alias("conflicts"))


def term_runs(log: DataFrame) -> DataFrame:
    """Maximal runs of one term in each log: node, run, term, first_idx, last_idx."""
    back = previous(log.select("node", "idx", "term"), ["node"], "idx", ["term"])
    starts = back.withColumn("new", F.when(F.col("prev_term").isNull() | (F.col("prev_term") != F.col("term")), 1).otherwise(0).cast("long"))
    runs = running_sum(starts, ["node"], "idx", "new", "run")
    return runs.groupBy("node", "run").agg(F.min("term").alias("term"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


def conflict_hint(log: DataFrame, leader: int = 1, snapshot_index: int = 0) -> DataFrame:
    """Where a follower tells the leader to go on from: the first index, above its snapshot, of the run of the term that
    the conflicting entry has. One aggregation: the last entry before it that has another term."""
    at = first_conflict(log.filter(F.col("idx") > snapshot_index), leader).select("node", "truncate_from")
    own = log.join(at, "node").filter((F.col("idx") <= F.col("truncate_from")) & (F.col("idx") > snapshot_index))
    term = own.filter(F.col("idx") == F.col("truncate_from")).select("node", F.col("term").alias("conflict_term"))
    run = own.join(term, "node").groupBy("node", "truncate_from", "conflict_term")
    other = F.max(F.when(F.col("term") != F.col("conflict_term"), F.col("idx")))
    return run.agg(F.coalesce(other + 1, F.min("idx")).alias("hint")).select("node", "truncate_from", "conflict_term", "hint")


def malformed(messages: DataFrame, entries: DataFrame) -> DataFrame:
    """Why an append can't come from a correct leader, or null: the first entry that breaks a rule, and the first rule
    that it breaks. Messages: msg, prev_index, prev_term, term; entries: msg, pos (from 0), idx, entry_term, bytes. A
    message's entries are bounded by the append cap."""
    c = F.col
    w = Window.partitionBy("msg").orderBy("pos")
    rows = entries.withColumn("above", F.lag("entry_term").over(w)).join(messages, "msg")
    reason = (
        F.when(c("idx") != c("prev_index") + c("pos") + 1, "index")
        .when(c("entry_term") == 0, "term zero")
        .when(c("bytes") > MAX_ENTRY_BYTES, "too large")
        .when(c("entry_term") > c("term"), "above the message term")
        .when(c("entry_term") < F.coalesce("above", "prev_term"), "below the term before")
    )
    bad = rows.withColumn("reason", reason).filter("reason IS NOT NULL").groupBy("msg").agg(F.min("pos").alias("pos"), F.min_by("reason", "pos").alias("reason"))
    return messages.select("msg").join(bad, "msg", "left")


def contiguity(log: DataFrame) -> DataFrame:
    """Whether each log's indexes go on by one, none repeated, and its last index and term."""
    span = F.max("idx") - F.min("idx") + 1
    return log.groupBy("node").agg(
        F.when((span == F.countDistinct("idx")) & (span == F.count("idx")), 1).otherwise(0).alias("contiguous"),
        F.min("idx").alias("first_idx"),
        F.max("idx").alias("last_idx"),
        F.max_by("term", "idx").alias("last_term"),
    )


def replication_lag(matches: DataFrame, group: str = "grp") -> DataFrame:
    """How far each peer is behind its group's furthest."""
    last = matches.groupBy(group).agg(F.max("matched").alias("last_index"))
    return matches.join(last, group).select(group, "peer", F.greatest(F.lit(0), F.col("last_index") - F.col("matched")).alias("lag"))


def role_transitions(statuses: DataFrame) -> DataFrame:
    """Elections started and leaderships won by each node, and leaderships lost within a term, from successive statuses."""
    back = previous(statuses.select("node", "tick", "role", "term"), ["node"], "tick", ["role", "term"])
    became = lambda role: F.count_if((F.col("role") == role) & F.coalesce(F.col("prev_role") != role, F.lit(True)))
    return back.groupBy("node").agg(became("candidate").alias("elections"), became("leader").alias("won"), F.count_if((F.col("prev_role") == "leader") & (F.col("role") != "leader") & (F.col("prev_term") == F.col("term"))).alias("lost"))


def vote_grants(requests: DataFrame, voters: list[tuple[int, int, int]]) -> DataFrame:
    """Votes for each candidate (candidate, last_term, last_index): a voter (its number, last term and last index; voters
    are few) grants if the candidate's log is at least as up to date."""
    listed = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(i).alias("idx")) for _, t, i in voters])
    granted = F.size(F.filter(listed, lambda v: up_to_date(F.col("last_term"), F.col("last_index"), v["term"], v["idx"]))).cast("long")
    tally = requests.groupBy("candidate").agg(F.sum(granted).alias("granted"), F.sum(F.lit(len(voters)).cast("long")).alias("voters"))
    return tally.withColumn("won", F.when(F.col("granted") >= majority(F.col("voters")), 1).otherwise(0))


def up_to_date(last_term: Column, last_index: Column, own_term: Column, own_index: Column) -> Column:
    return (last_term > own_term) | ((last_term == own_term) & (last_index >= own_index))


def membership_fold(changes: DataFrame, peers: list[str]) -> DataFrame:
    """The voters after each committed change (idx, kind, peer): a join adds, a leave removes. Each peer's last change up
    to an index decides; ``peers`` are all that there are, and few. Indexes after which nobody is left are left out."""
    of = [F.when(F.col("peer") == p, F.col("kind")).alias(f"k{i}") for i, p in enumerate(peers)]
    held = carried(changes.select("idx", *of), [], "idx", [f"k{i}" for i in range(len(peers))])
    names = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"last_k{i}") == "join", F.lit(p)) for i, p in enumerate(peers)])))
    return held.select(F.col("idx").alias("tick"), F.size(names).cast("long").alias("voters"), F.array_join(names, ",").alias("members")).filter("voters > 0")


def capped_prefix(log: DataFrame, cap: int = APPEND_CAP_BYTES, overhead: int = ENTRY_OVERHEAD_BYTES) -> DataFrame:
    """What of each log fits into one append: entries while their sizes sum to the cap, the first in any case."""
    sized = running_sum(log.withColumn("_size", F.col("bytes") + overhead), ["node"], "idx", "_size", "total")
    low = sized.groupBy("node").agg(F.min("idx").alias("_first"))
    return sized.join(low, "node").filter((F.col("total") <= cap) | (F.col("idx") == F.col("_first"))).groupBy("node").agg(F.count(F.lit(1)).alias("entries"), F.max("total").alias("size"))


def greedy_batches(queue: DataFrame, group: str, most: int = BATCH_MAX_ENTRIES, cap: int = BATCH_MAX_BYTES) -> DataFrame:
    """Group commit: proposals (group, pos, bytes) are taken in order until a batch has ``most`` entries or would pass
    ``cap`` bytes. Where a batch ends depends on all before it, so a queue streams through one task, in order, and is
    never held there: what is kept is the open batch. Groups are dealt by their key."""
    import pyarrow as pa

    ordered = queue.select(F.col(group).cast("long").alias("g"), F.col("pos").cast("long").alias("pos"), F.col("bytes").cast("long").alias("bytes"))
    ordered = ordered.repartition("g").sortWithinPartitions("g", "pos")

    def pack(batches):
        done, at, number, n, size, any_yet = [], None, 0, 0, 0, False

        def rows():
            cols = list(zip(*done, strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["g", "batch", "entries", "size"])

        for b in batches:
            for g, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if any_yet and g == at and n < most and size + x <= cap:
                    n, size = n + 1, size + x
                    continue
                if any_yet:
                    done.append((at, number, n, size))
                number, n, size = (number + 1 if any_yet and g == at else 1), 1, x
                at, any_yet = g, True
            yield rows()
            done.clear()
        if any_yet:
            done.append((at, number, n, size))
            yield rows()

    return ordered.mapInArrow(pack, "g long, batch long, entries long, size long").withColumnRenamed("g", group)


def coalesced_runs(messages: DataFrame) -> DataFrame:
    """Maximal runs of consecutive messages (tick, sender) of one sender, which are handled together."""
    back = previous(messages.select("tick", "sender"), [], "tick", ["sender"])
    new = F.when(F.col("prev_sender").isNull() | (F.col("prev_sender") != F.col("sender")), 1).otherwise(0).cast("long")
    runs = running_sum(back.withColumn("new", new), [], "tick", "new", "run")
    return runs.groupBy("run").agg(F.min("sender").alias("sender"), F.count(F.lit(1)).alias("messages"), F.min("tick").alias("first_tick"))


def monotone_commit(statuses: DataFrame) -> DataFrame:
    """Statuses whose commit index is below an earlier one of the node, which must not be."""
    seen = before_max(statuses, ["node"], "tick", "commit_index", "before")
    return seen.filter(F.col("commit_index") < F.col("before")).select("node", "tick", "commit_index", "before")


def snapshot_chunks(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Where each record (key, bytes) of a sorted image begins, and in which chunk: sizes summed in key order. Keys
    are first dealt to ranges, whose totals give the offsets at which they start."""
    from ..functions.ranges import cell_of, cut_points

    cuts = cut_points(rows, "key")
    cells = rows.withColumn("_cell", cell_of(F.col("key"), cuts))
    totals = cells.groupBy("_cell").agg(F.sum("bytes").alias("_t"))
    before = totals.select("_cell", F.coalesce(F.sum("_t").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # as many rows as ranges
    w = Window.partitionBy("_cell").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    placed = cells.join(F.broadcast(before), "_cell").withColumn("offset", F.sum("bytes").over(w) - F.col("bytes") + F.col("_b"))
    return placed.withColumn("chunk", F.floor(F.col("offset") / chunk)).groupBy("chunk").agg(F.min("offset").alias("offset"), F.count(F.lit(1)).alias("records"), F.sum("bytes").alias("bytes"))


def valid_prefix(records: DataFrame, snapshot_index: int = 0) -> DataFrame:
    """What a recovered log keeps: records (place, idx, good) above the snapshot, up to the first that is damaged or
    doesn't go on from the one before."""
    back = previous(records.select("place", "idx", "good"), [], "place", ["idx"])
    broken = ~F.col("good") | (F.col("idx") != F.coalesce(F.col("prev_idx") + 1, F.col("idx")))
    stop = back.filter(broken).agg(F.min("place").alias("stop"))  # one row
    return records.join(F.broadcast(stop)).filter((F.col("stop").isNull() | (F.col("place") < F.col("stop"))) & (F.col("idx") > snapshot_index)).select("place", "idx")


def after_snapshot(log: DataFrame, index: int, term: int) -> DataFrame:
    """What a log keeps when a snapshot is installed: the suffix if it agrees with the snapshot's last entry, else nothing."""
    agrees = log.filter((F.col("idx") == index) & (F.col("term") == term)).select("node").distinct()
    return log.filter(F.col("idx") > index).join(agrees, "node", "left_semi")


def has_quorum(acks: Column, voters: Column, joint: Column | None = None) -> Column:
    """Whether the acknowledging peers are a majority of the voters, and of the joint voters where there are some."""
    met = lambda v: F.size(F.array_intersect(acks, v)) >= F.floor(F.size(v) / 2) + 1
    return met(voters) if joint is None else met(voters) & (F.coalesce(F.size(joint), F.lit(0)).isin(0, -1) | met(joint))


def match_after_response(next_index: Column, match: Column, reject: Column, acked: Column, hint: Column, last_index: Column) -> Column:
    """(match, next) of a peer after its answer. An accepted append above the match moves the match up, to the last index
    at most, and next right after it; one that proves nothing new changes nothing. A rejected one moves next to a hint
    that is above 0 and below next, else back by one, but never to what is matched."""
    matched = F.least(acked, last_index)
    new = acked > match
    back = F.when((hint > 0) & (hint < next_index), hint).when(next_index > 1, next_index - 1).otherwise(next_index)
    accepted = F.struct(F.when(new, matched).otherwise(match).alias("match"), F.when(new, matched + 1).otherwise(next_index).alias("next"))
    return F.when(reject, F.struct(match.alias("match"), F.greatest(F.lit(1).cast("long"), back, match + 1).alias("next"))).otherwise(accepted)
