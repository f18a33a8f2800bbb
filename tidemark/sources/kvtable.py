"""A table of versioned keys over sorted Parquet files and an atomic manifest.

One driver writes; any number of readers read. Small writes go to a tail, which
is logged file by file before they count, and of which the newest version of each
key is kept in memory; bulk writes become a segment at once. The tail is flushed
when it has as many keys, or LOGGED times as many records, as the threshold says,
so that neither memory nor the log grows without end however hot a key is.
Flushing turns the tail into a segment, compaction all segments into one without
tombstones. Each change publishes a new generation; files that no generation
needs any more are removed by ``vacuum``.

Defined results: a get or scan takes the newest version of a key, and finds a put
of null or of an empty value; deletes hide a key, and deleting an absent one is
allowed; scan bounds are both included, and reversed bounds give nothing. In a
batch the first mutation of a key wins. Read errors are raised.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lww
from ..schema import COMPACTION_THRESHOLD, DELETE, FLUSH_THRESHOLD, MAX_KEY_BYTES, MAX_VALUE_BYTES, PUT, RECORD
from . import manifest as M
from .files import Files, scratch


#: A tail of so many times the threshold's records is flushed, too, however few its keys are.
LOGGED = 16


class TableError(RuntimeError):
    """An operation that the table's mode or state doesn't allow."""


@dataclass(frozen=True)
class Options:
    """Thresholds at or below zero mean the default. A replica takes batches by index only."""

    flush_threshold: int = FLUSH_THRESHOLD
    compaction_threshold: int = COMPACTION_THRESHOLD
    replica: bool = False

    def filled(self) -> Options:
        return Options(self.flush_threshold if self.flush_threshold > 0 else FLUSH_THRESHOLD, self.compaction_threshold if self.compaction_threshold > 0 else COMPACTION_THRESHOLD, self.replica)


class KVTable:
    def __init__(self, spark: SparkSession, path: str, options: Options = Options()) -> None:
        self.spark, self.path, self.options = spark, path.rstrip("/"), options.filled()
        self.files = Files(spark, self.path)
        self.files.mkdirs()
        self.manifest = M.load(self.files)
        self.applied_index = self.manifest.applied_index
        self.tail: dict[str, tuple[str, str | None, int, int, int]] = {}  # the newest version of each key
        self.records = 0  # in the log of the tail
        self.logged: list[str] = []
        self.closed = self.passing = False
        if self.manifest.version == M.LEGACY:  # what was read of it is published in the present form
            self.manifest = self.manifest.next()
            M.publish(self.files, self.manifest)
        for name in self.files.names():
            if name.startswith("tail-"):
                self._keep(self._replay(name))
                self.logged.append(name)
        self.last_seq = max([self.manifest.last_seq, *(r[2] for r in self.tail.values())])
        if self.options.replica:
            self.applied_index = max(self.applied_index, self.last_seq)

    @classmethod
    def open(cls, spark: SparkSession, path: str = "", options: Options = Options()) -> KVTable:
        """The table at ``path``, made if it isn't there. Without a path it is a passing one, in a scratch folder that goes
        when the table is closed."""
        made = cls(spark, path or scratch(spark, "passing"), options)
        made.passing = not path
        return made

    @classmethod
    def bootstrap(cls, spark: SparkSession, path: str, options: Options = Options()) -> KVTable:
        """A table of the segments in a folder that has no manifest, oldest name first, which is then published."""
        t = cls(spark, path, options)
        if t.manifest.generation:
            raise TableError("there is a manifest")
        names = [n for n in t.files.names() if n.startswith("seg-") and M.NAME.fullmatch(n)]
        segments = tuple(s for n in names if (s := t._segment(n)) is not None)
        t.manifest = t.manifest.next(segments=segments, next_id=len(names) + 1, last_seq=max((s.max_seq for s in segments), default=0))
        M.publish(t.files, t.manifest)
        t.last_seq = max(t.last_seq, t.manifest.last_seq)
        return t

    def __enter__(self) -> KVTable:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Idempotent; a replica flushes first."""
        if not self.closed and self.options.replica and not self.passing:
            self.flush()
        if not self.closed and self.passing:
            self.files.delete("")
        self.closed = True

    # --- the tail -------------------------------------------------------------

    def _replay(self, name: str) -> list[tuple]:
        """A tail file's records that no segment has yet; a torn last line ends the file."""
        out = []
        for line in self.files.read(name).split(b"\n"):
            try:
                row = tuple(json.loads(line))
            except ValueError:
                break
            if row[2] > self.manifest.last_seq:
                out.append(row)
        return out

    def _keep(self, rows: list[tuple]) -> None:
        for r in rows:
            old = self.tail.get(r[0])
            if old is None or (r[2], -r[4]) > (old[2], -old[4]):
                self.tail[r[0]] = r
        self.records += len(rows)

    def _log(self, rows: list[tuple]) -> None:
        name = f"tail-{rows[0][2]:020d}.jsonl"
        self.files.write_new(name, b"".join(json.dumps(r).encode() + b"\n" for r in rows))
        self.logged.append(name)
        self._keep(rows)
        self.last_seq = max(self.last_seq, rows[-1][2])

    def _check(self, key: str, value: str | None) -> None:
        if len(key.encode()) > MAX_KEY_BYTES or len((value or "").encode()) > MAX_VALUE_BYTES:
            raise TableError("a key or value is too large")

    def put(self, key: str, value: str | None) -> int:
        return self.write([(PUT, key, value)])

    def delete(self, key: str) -> int:
        return self.write([(DELETE, key, None)])

    def write(self, mutations: Iterable[tuple[int, str, str | None]]) -> int:
        """Logs (op, key, value) mutations, each with a sequence number of its own; the last one is returned."""
        if self.options.replica:
            raise TableError("a replica is written by apply_batch")
        rows = []
        for i, (op, key, value) in enumerate(mutations):
            self._check(key, value)
            rows.append((key, value if op == PUT else None, self.last_seq + 1 + i, op, 0))
        if rows:
            self._log(rows)
            self._maybe_flush()
        return self.last_seq

    def apply_batch(self, index: int, mutations: Iterable[tuple[int, str, str | None]]) -> bool:
        """Applies one batch of the replicated log, whole or not at all. False if it was applied before."""
        if not self.options.replica:
            raise TableError("apply_batch needs a replica")
        if index < 1:
            raise TableError("an index is above zero")
        if index <= self.applied_index:
            return False
        if index != self.applied_index + 1:
            raise TableError(f"index {index} after {self.applied_index}")
        rows = []
        for pos, (op, key, value) in enumerate(mutations):
            if not key or op not in (PUT, DELETE):
                raise TableError("a mutation without a key or of unknown type")
            self._check(key, value)
            rows.append((key, value if op == PUT else None, index, op, pos))
        if rows:
            self._log(rows)
        self.applied_index = self.last_seq = index
        self._maybe_flush()
        return True

    def append(self, rows: DataFrame) -> None:
        """A bulk write of (key, value, op, place): one segment, numbered on in the order of ``place``, which must be
        distinct. The rows never come to the driver."""
        if self.options.replica:
            raise TableError("a replica is written by apply_batch")
        from ..operators.commands import renumbered

        self.flush()
        numbered = renumbered(rows, self.last_seq).select("key", "value", "seq", F.col("op").cast("int").alias("op"), F.lit(0).alias("pos"))
        self._add_segment(numbered, lambda last: {"last_seq": last})
        self.last_seq = self.manifest.last_seq
        self._maybe_compact()

    # --- segments ----------------------------------------------------------------

    def _write_segment(self, rows: DataFrame, name: str) -> M.Segment | None:
        """Sorted by key, with a Bloom filter and statistics on it; None if there are no rows."""
        n = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
        ordered = rows.repartitionByRange(int(n), "key").sortWithinPartitions("key", F.col("seq").desc())
        ordered.write.mode("errorifexists").option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.path}/{name}")
        return self._segment(name)

    def _segment(self, name: str) -> M.Segment | None:
        found = self.spark.read.parquet(f"{self.path}/{name}").agg(F.min("key"), F.max("key"), F.count(F.lit(1)), F.max("seq")).first()
        return M.Segment(name, *found) if found[2] else None

    def _new_segment(self) -> str:
        """A name that no other writer takes, so that one that comes too late has overwritten nothing."""
        return f"seg-{self.manifest.next_id:08d}-{uuid4().hex[:16]}.parquet"

    def _add_segment(self, rows: DataFrame, changes) -> None:
        name = self._new_segment()
        made = self._write_segment(rows, name)
        segments = (*self.manifest.segments, *([made] if made else []))
        new = self.manifest.next(segments=segments, next_id=self.manifest.next_id + 1, **changes(made.max_seq if made else self.last_seq))
        M.publish(self.files, new)
        self.manifest = new

    def _maybe_flush(self) -> None:
        if len(self.tail) >= self.options.flush_threshold or self.records >= LOGGED * self.options.flush_threshold:
            self.flush()

    def flush(self) -> None:
        """The tail becomes a segment; an empty one still publishes a replica's index."""
        if not self.tail and self.applied_index == self.manifest.applied_index:
            return
        self._add_segment(lww_rows(self._tail_frame()), lambda _: {"last_seq": self.last_seq, "applied_index": self.applied_index})
        for name in self.logged:
            self.files.delete(name)
        self.tail, self.records, self.logged = {}, 0, []
        self._maybe_compact()

    def _maybe_compact(self) -> None:
        if len(self.manifest.segments) >= self.options.compaction_threshold:
            self.compact()

    def compact(self) -> None:
        """All segments become one, without tombstones, or none if nothing is live."""
        if not self.manifest.segments:
            return
        name = self._new_segment()
        merged = lww.winners(self._segments(self.manifest.segments)).filter(F.col("op") == PUT).withColumn("pos", F.lit(0))
        made = self._write_segment(merged.select(*RECORD.fieldNames()), name)
        new = self.manifest.next(segments=(made,) if made else (), next_id=self.manifest.next_id + 1)
        M.publish(self.files, new)
        self.manifest = new

    def vacuum(self) -> list[str]:
        """Removes segments and manifests that the newest generation doesn't need; readers of older ones must be done."""
        keep = {s.name for s in self.manifest.segments} | {f"manifest-{self.manifest.generation:012d}.json"} | set(self.logged)
        gone = [n for n in self.files.names() if n not in keep and not n.startswith("tail-")]
        for n in gone:
            self.files.delete(n)
        return gone

    # --- reads -------------------------------------------------------------------

    def _tail_frame(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.tail.values()), RECORD)

    def _segments(self, segments) -> DataFrame:
        paths = [f"{self.path}/{s.name}" for s in segments]
        return self.spark.read.schema(RECORD).parquet(*paths) if paths else self.spark.createDataFrame([], RECORD)

    def log(self, low: str | None = None, high: str | None = None) -> DataFrame:
        """All versions, from the segments that can hold keys in the range and from the tail."""
        segments = self.manifest.segments if low is None else self.manifest.overlapping(low, high)
        rows = self._segments(segments)
        return rows.unionByName(self._tail_frame()) if self.tail else rows

    def live(self) -> DataFrame:
        return lww.live_state(self.log())

    def get(self, key: str) -> tuple[bool, str | None]:
        self._check(key, None)
        row = lww.get(self.log(key, key), key).first()
        return (False, None) if row is None else (True, row["value"])

    def scan(self, low: str, high: str) -> DataFrame:
        return lww.scan(self.log(low, high), low, high)

    def multi_get(self, keys: DataFrame | Iterable[str]) -> DataFrame:
        return lww.multi_get(self.log(), keys)

    def as_of(self, seq: int) -> DataFrame:
        """The live state after ``seq``; versions that a flush or a compaction has merged, or that newer ones in the tail
        have replaced, are gone."""
        return lww.as_of(self.log(), seq)

    def status(self) -> DataFrame:
        m = self.manifest
        row = (m.generation, len(m.segments), len(self.tail), self.applied_index, m.applied_index, self.last_seq, sum(self.files.size(s.name) for s in m.segments))
        return self.spark.createDataFrame([row], "generation long, segments long, tail long, applied_index long, durable_index long, last_seq long, bytes long")

    # --- snapshots ----------------------------------------------------------------

    def snapshot(self, path: str) -> int:
        """Writes the live state, sorted, and what it must hold; returns the index it stands for."""
        index = self.applied_index if self.options.replica else self.last_seq
        if not index:
            raise TableError("nothing was applied")
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.live().select("key", "value").repartitionByRange(n, "key").sortWithinPartitions("key").write.mode("errorifexists").parquet(f"{path}/data.parquet")
        Files(self.spark, path).write_new("snapshot.json", json.dumps({"index": index, **_contents(self.spark.read.parquet(f"{path}/data.parquet"))}).encode())
        return index

    def restore(self, path: str) -> None:
        """Replaces the state by a snapshot's, if it is whole: the right count and checksum, keys distinct and not empty."""
        meta = json.loads(Files(self.spark, path).read("snapshot.json"))
        rows = self.spark.read.parquet(f"{path}/data.parquet")
        found = _contents(rows)
        if any(found[k] != meta[k] for k in found) or found["keys"] != found["count"] or found["empty"]:
            raise TableError("the snapshot is damaged")
        index = meta["index"]
        if self.options.replica and index < self.applied_index:
            raise TableError("the snapshot is older than what was applied")
        name = self._new_segment()
        made = self._write_segment(rows.select("key", "value", F.lit(index).cast("long").alias("seq"), F.lit(PUT).alias("op"), F.lit(0).alias("pos")), name)
        new = self.manifest.next(segments=(made,) if made else (), next_id=self.manifest.next_id + 1, applied_index=index, last_seq=index)
        M.publish(self.files, new)
        self.manifest, self.applied_index, self.last_seq = new, index, index
        for n in self.logged:
            self.files.delete(n)
        self.tail, self.records, self.logged = {}, 0, []


def lww_rows(log: DataFrame) -> DataFrame:
    """The newest version of each key, in the shape of a record."""
    return lww.winners(log).withColumn("pos", F.lit(0)).select(*RECORD.fieldNames())


def _contents(rows: DataFrame) -> dict:
    r = rows.agg(F.count(F.lit(1)).alias("count"), F.countDistinct("key").alias("keys"), F.count_if(F.col("key") == "").alias("empty"), F.sum(F.xxhash64("key", "value").cast("decimal(38,0)")).cast("string").alias("sum")).first()
    return r.asDict()
