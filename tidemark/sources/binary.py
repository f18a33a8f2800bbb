"""Readers and writers of the binary files: log, sorted file, snapshot image, Bloom filter.

Files are read with Spark's ``binaryFile`` source, so that any path that Spark
reads will do, and decoded a file at a time on the executors; each file is one
segment of a bounded size. Layouts (all numbers big-endian):

    log record       type(1) seq(8) key length(4) value length(4) key value crc32(4)
    sorted file      records: key length(4) value length(4) seq(8) type(1) key value;
                     then bounds, Bloom filter, sparse index and a footer of six longs
    snapshot image   magic, count(8), records: key length(4) value length(4) key value
    Bloom filter     bits(8) hashes(8) words
"""

from __future__ import annotations

import math
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the formats.
LOG_PUT, LOG_DELETE = 1, 2
MAX_LOG_KEY, MAX_LOG_VALUE = 16 << 10, 64 << 20
MAX_SNAPSHOT_FIELD = 64 << 20
SNAPSHOT_MAGIC = b"LSMSNAP\x01"
INDEX_STEP, FOOTER = 16, 48
BLOOM_RATE = 0.01
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3

_LOG = struct.Struct(">BQII")
_SORTED = struct.Struct(">IIQB")
_SNAP = struct.Struct(">II")
_MASK = (1 << 64) - 1


class FormatError(ValueError):
    """A file that doesn't have the layout it should."""


# --- log ---------------------------------------------------------------------


def log_record(op: int, seq: int, key: bytes, value: bytes = b"") -> bytes:
    if len(key) > MAX_LOG_KEY or len(value) > MAX_LOG_VALUE:
        raise FormatError("a record that replay would not accept")
    head = _LOG.pack(op + 1, seq, len(key), len(value)) + key + value
    return head + struct.pack(">I", zlib.crc32(head))


def log_records(raw: bytes) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(op, seq, key, value) of every good record. Reading ends at a torn record or absurd length; records with a
    wrong checksum or unknown type are passed over."""
    at, view = 0, memoryview(raw)
    while at + _LOG.size <= len(raw):
        kind, seq, nk, nv = _LOG.unpack_from(raw, at)
        end = at + _LOG.size + nk + nv + 4
        if nk > MAX_LOG_KEY or nv > MAX_LOG_VALUE or end > len(raw):
            return
        (stored,) = struct.unpack_from(">I", raw, end - 4)
        if zlib.crc32(view[at : end - 4]) == stored and kind in (LOG_PUT, LOG_DELETE):
            k = at + _LOG.size
            yield kind - 1, seq, raw[k : k + nk], raw[k + nk : end - 4]
        at = end


# --- Bloom filter ---------------------------------------------------------------


def fnv1a(key: bytes) -> int:
    h = FNV_OFFSET
    for b in key:
        h = ((h ^ b) * FNV_PRIME) & _MASK
    return h


class Bloom:
    """Double hashing: FNV-1a, and the same turned by 17 bits and made odd."""

    def __init__(self, bits: int, hashes: int, words: list[int] | None = None) -> None:
        self.bits, self.hashes = bits, hashes
        self.words = words or [0] * (bits // 64)

    @classmethod
    def sized(cls, keys: int, rate: float = BLOOM_RATE) -> Bloom:
        per_key = -math.log(rate) / math.log(2) ** 2
        bits = math.ceil(max(keys, 1) * per_key)
        return cls(-(-bits // 64) * 64, min(30, max(1, math.floor(per_key * math.log(2) + 0.5))))

    def places(self, key: bytes) -> Iterator[int]:
        h = fnv1a(key)
        turned = ((h << 17) | (h >> 47)) & _MASK | 1
        return (((h + i * turned) & _MASK) % self.bits for i in range(self.hashes))

    def add(self, key: bytes) -> None:
        for p in self.places(key):
            self.words[p >> 6] |= 1 << (p & 63)

    def may_contain(self, key: bytes) -> bool:
        return all(self.words[p >> 6] >> (p & 63) & 1 for p in self.places(key))

    def encode(self) -> bytes:
        return struct.pack(f">QQ{len(self.words)}Q", self.bits, self.hashes, *self.words)

    @classmethod
    def decode(cls, raw: bytes) -> Bloom:
        if len(raw) < 16:
            raise FormatError("too short for a Bloom filter")
        bits, hashes = struct.unpack_from(">QQ", raw)
        if not bits or bits % 64 or len(raw) - 16 < bits // 8:
            raise FormatError("not a Bloom filter")
        return cls(bits, hashes, list(struct.unpack_from(f">{bits // 64}Q", raw, 16)))


# --- sorted file ------------------------------------------------------------------


def sorted_file(records: Iterable[tuple[int, int, bytes, bytes]]) -> bytes:
    """One file of (op, seq, key, value) records, which must come in strictly ascending key order."""
    body, index, keys, before = bytearray(), [], [], None
    for n, (op, seq, key, value) in enumerate(records):
        if before is not None and key <= before:
            raise FormatError("records out of order")
        if n % INDEX_STEP == 0:
            index.append(struct.pack(">I", len(key)) + key + struct.pack(">Q", len(body)))
        body += _SORTED.pack(len(key), len(value), seq, op) + key + value
        keys.append(key)
        before = key
    if not keys:
        return b""
    bloom = Bloom.sized(len(keys))
    for k in keys:
        bloom.add(k)
    meta = b"".join(struct.pack(">I", len(k)) + k for k in (keys[0], keys[-1]))
    filt, idx = bloom.encode(), b"".join(index)
    at = len(body)
    foot = struct.pack(">6Q", at, at + len(meta), len(filt), at + len(meta) + len(filt), len(idx), len(keys))
    return bytes(body) + meta + filt + idx + foot


def sorted_records(raw: bytes) -> Iterator[tuple[int, int, bytes, bytes]]:
    if len(raw) < FOOTER:
        raise FormatError("too short for a sorted file")
    end, *_, count = struct.unpack(">6Q", raw[-FOOTER:])
    at = 0
    for _ in range(count):
        if at + _SORTED.size > end:
            raise FormatError("fewer records than the footer says")
        nk, nv, seq, op = _SORTED.unpack_from(raw, at)
        k = at + _SORTED.size
        at = k + nk + nv
        yield op, seq, raw[k : k + nk], raw[k + nk : at]


class SortedFile:
    """A sorted file opened for reads: its bounds, filter and sparse index are read, records only where they are needed."""

    def __init__(self, raw: bytes) -> None:
        if len(raw) < FOOTER:
            raise FormatError("too short for a sorted file")
        self.raw = raw
        meta, filt, filt_size, idx, idx_size, self.count = struct.unpack(">6Q", raw[-FOOTER:])
        if not meta <= filt <= idx <= len(raw) - FOOTER or filt + filt_size != idx or idx + idx_size != len(raw) - FOOTER:
            raise FormatError("a footer that points elsewhere")
        self.end = meta
        self.low, at = self._name(meta)
        self.high, _ = self._name(at)
        self.bloom = Bloom.decode(raw[filt : filt + filt_size])
        self.keys, self.places, at = [], [], idx
        while at < idx + idx_size:
            key, at = self._name(at)
            self.keys.append(key)
            self.places.append(struct.unpack_from(">Q", raw, at)[0])
            at += 8

    def _name(self, at: int) -> tuple[bytes, int]:
        (n,) = struct.unpack_from(">I", self.raw, at)
        return self.raw[at + 4 : at + 4 + n], at + 4 + n

    def _from(self, key: bytes) -> Iterator[tuple[int, int, bytes, bytes]]:
        """Records from the index block on that can hold the key."""
        at = self.places[max(0, bisect_right(self.keys, key) - 1)]
        while at < self.end:
            nk, nv, seq, op = _SORTED.unpack_from(self.raw, at)
            k = at + _SORTED.size
            at = k + nk + nv
            yield op, seq, self.raw[k : k + nk], self.raw[k + nk : at]

    def get(self, key: bytes) -> tuple[str, tuple[int, int, bytes, bytes] | None]:
        """``outside`` the bounds, ``skipped`` by the filter, ``absent``, or ``found`` and the record."""
        if not self.low <= key <= self.high:
            return "outside", None
        if not self.bloom.may_contain(key):
            return "skipped", None
        for r in self._from(key):
            if r[2] >= key:
                return ("found", r) if r[2] == key else ("absent", None)
        return "absent", None

    def scan(self, low: bytes, high: bytes) -> Iterator[tuple[int, int, bytes, bytes]]:
        """Records from low to high, both included."""
        if low > high or high < self.low or low > self.high:
            return
        for r in self._from(low):
            if r[2] > high:
                return
            if r[2] >= low:
                yield r


# --- snapshot image --------------------------------------------------------------


def snapshot_image(pairs: Iterable[tuple[bytes, bytes]]) -> bytes:
    rows = list(pairs)
    return SNAPSHOT_MAGIC + struct.pack(">Q", len(rows)) + b"".join(_SNAP.pack(len(k), len(v)) + k + v for k, v in rows)


def snapshot_pairs(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Key and value pairs; raises on a wrong magic, count, size or order, and on anything left over."""
    head = len(SNAPSHOT_MAGIC)
    if raw[:head] != SNAPSHOT_MAGIC or len(raw) < head + 8:
        raise FormatError("not a snapshot image")
    (count,) = struct.unpack_from(">Q", raw, head)
    at, before = head + 8, None
    for _ in range(count):
        if at + _SNAP.size > len(raw):
            raise FormatError("truncated")
        nk, nv = _SNAP.unpack_from(raw, at)
        k = at + _SNAP.size
        if nk > MAX_SNAPSHOT_FIELD or nv > MAX_SNAPSHOT_FIELD or k + nk + nv > len(raw):
            raise FormatError("truncated or too large")
        key = raw[k : k + nk]
        if not key or (before is not None and key <= before):
            raise FormatError("keys out of order")
        yield key, raw[k + nk : k + nk + nv]
        at, before = k + nk + nv, key
    if at != len(raw):
        raise FormatError("bytes after the last record")


# --- as frames ----------------------------------------------------------------------

_DECODERS = {
    "log": log_records,
    "sorted": sorted_records,
    "snapshot": lambda raw: ((0, 0, k, v) for k, v in snapshot_pairs(raw)),
}


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, pos, op, seq, key, value) of the records in the files; kind: log, sorted or snapshot."""
    decode = _DECODERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = list(decode(raw))
                op, seq, key, value = zip(*rows, strict=True) if rows else ((), (), (), ())
                cols = [pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), pa.array(op, pa.int32()), pa.array(seq, pa.int64()), pa.array(key, pa.binary()), pa.array(value, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["path", "pos", "op", "seq", "key", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, pos long, op int, seq long, key binary, value binary")


_RECORD = "path string, pos long, op int, seq long, key binary, value binary"


def encoded(log: DataFrame, group: str, kind: str) -> DataFrame:
    """(path, content): a file of each group's records (op, seq, key, value; the group is a segment, of bounded size): a log
    in order of the sequence, or a sorted file of each key's newest record."""

    def build(rows: pa.Table) -> pa.Table:
        name = rows.column(group)[0].as_py()
        records = [(op, seq, k.encode(), (v or "").encode()) for op, seq, k, v in zip(*(rows.column(c).to_pylist() for c in ("op", "seq", "key", "value")), strict=True)]
        records.sort(key=lambda r: r[1])
        raw = b"".join(log_record(*r) for r in records) if kind == "log" else sorted_file(dict(sorted({r[2]: r for r in records}.items())).values())
        return pa.table({"path": pa.array([str(name)], pa.string()), "content": pa.array([raw], pa.binary())})

    return log.select(group, "op", "seq", "key", "value").groupBy(group).applyInArrow(build, "path string, content binary")


def decoded(files: DataFrame, kind: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """The records of (path, content) files; of sorted files only those from ``low`` to ``high``, if these are given."""
    decode = _DECODERS[kind] if low is None else lambda raw: SortedFile(raw).scan(low.encode(), high.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(name, i, *r) for i, r in enumerate(decode(raw))]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["path", "pos", "op", "seq", "key", "value"])

    return files.select("path", "content").mapInArrow(run, _RECORD)


def lookups(files: DataFrame, keys: list[str]) -> DataFrame:
    """(path, key, answer, op, seq, value) of each key in each sorted file, by bounds, filter and index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f, rows = SortedFile(raw), []
                for k in keys:
                    answer, r = f.get(k.encode())
                    rows.append((name, k, answer, *((r[0], r[1], r[3]) if r else (None, None, None))))
                kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "key", "answer", "op", "seq", "value"])

    return files.select("path", "content").mapInArrow(run, "path string, key string, answer string, op int, seq long, value binary")
