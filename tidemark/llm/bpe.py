"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is cut by the vocabulary's pattern into pre-tokens, each encoded apart.
Within a pre-token, parts form a linked list over byte positions. Every pair of
neighbours that the vocabulary has waits in the bucket of its merge rank; a
bucket is a bitmap of positions (in a long pre-token a heap). A bitmap over the ranks, with a
summary bitmap over its words, says which buckets are filled: find-first-set on
both gives the lowest rank, and the bucket's first position is merged, leftmost
first. A merge changes at most two neighbouring pairs, which are put into their
buckets; what they were before stays behind and is skipped as stale when it
comes up. So a pre-token of n bytes takes n - 1 merges at most and O(n log n)
steps, however long it is.

Recent short pre-tokens are remembered, a bounded number of them, as most are
common words.

Defined results: null text counts as empty; the empty text has no tokens; very long texts
are encoded whole, and of pairs of equal rank the leftmost is merged first; strings of special tokens are ordinary text. Repeated rows are encoded apart;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from hashlib import sha256
from heapq import heappop, heappush
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, extended, held, slices, table

WIDTH = 256
#: Pre-tokens of up to so many bytes keep their buckets as bitmaps of positions, longer ones as heaps.
SHORT = 64
_AFTER, _BEFORE = list(range(1, SHORT + 2)), list(range(-1, SHORT + 1))
#: Pre-tokens remembered by a Python worker, about 250 bytes each, and how many of them are kept when there are too
#: many: the ones met first, which are the common ones. Where ids are made for a table, workers share their executor
#: with what other stages hold, and remember fewer.
REMEMBER = 400_000
REMEMBER_LESS = 120_000
KEEP = 1 / 4
#: Text bytes whose ids are in a worker's memory at once.
SLICE = 1 << 19


class RankQueue:
    """A priority queue of positions by rank: buckets, and a two-level bitmap of those that are filled."""

    def __init__(self, n_ranks: int) -> None:
        self.words = [0] * (n_ranks // WIDTH + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def put(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [at]
            w = rank // WIDTH
            if not self.words[w]:
                self.top |= 1 << w
            self.words[w] |= 1 << (rank % WIDTH)
        else:
            heappush(bucket, at)

    def take(self) -> tuple[int, int] | None:
        """The lowest rank and its first position, or None."""
        if not self.top:
            return None
        w = (self.top & -self.top).bit_length() - 1
        word = self.words[w]
        rank = w * WIDTH + (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        at = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            word &= word - 1
            self.words[w] = word
            if not word:
                self.top &= self.top - 1
        return rank, at


class Codec(dict):
    """A vocabulary of byte strings by rank. As a mapping: from pre-tokens to their ids, made when asked for."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remember: int = REMEMBER) -> None:
        super().__init__()
        self.remember = remember
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.find = regex.compile(rust_pattern(pattern)).findall
        self.two = [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.encode_piece(piece.encode())
        if len(piece) <= SHORT:
            if len(self) >= self.remember:
                kept = dict(islice(self.items(), int(self.remember * KEEP)))
                self.clear()
                self.update(kept)
            self[piece] = ids
        return ids

    def encode_piece(self, raw: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(raw)
        if whole is not None:
            return (whole,)
        if len(raw) < 2:
            raise ValueError(f"the vocabulary lacks the byte {raw!r}")
        return self._short(raw) if len(raw) <= SHORT else self._long(raw)

    def _short(self, raw: bytes) -> tuple[int, ...]:
        """The queue written out in place; a bucket is itself a bitmap of positions."""
        rank_of, words, n = self.ranks.get, self.queue.words, len(raw)
        after, before = _AFTER[: n + 1], _BEFORE[: n + 1]
        two = self.two
        pair = [two[a << 8 | b] for a, b in zip(raw, raw[1:], strict=False)]
        pair.append(-1)
        buckets: dict[int, int] = {}
        get, top, bit = buckets.get, 0, 1
        for r in pair:
            if r >= 0:
                b = get(r)
                if b is None:
                    buckets[r] = bit
                    words[r >> 8] |= 1 << (r & 255)
                    top |= 1 << (r >> 8)
                else:
                    buckets[r] = b | bit
            bit += bit
        while top:
            w = (top & -top).bit_length() - 1
            word = words[w]
            rank = (w << 8) + (word & -word).bit_length() - 1
            b = buckets[rank]
            i = (b & -b).bit_length() - 1
            b &= b - 1
            if b:
                buckets[rank] = b
            else:
                del buckets[rank]
                word &= word - 1
                words[w] = word
                if not word:
                    top &= top - 1
            if pair[i] != rank:
                continue  # stale
            j = after[i]
            k = after[j]
            pair[j] = -1
            after[i] = k
            h = before[i]
            if k < n:
                before[k] = i
                pair[i] = r = rank_of(raw[i : after[k]], -1)
                if r >= 0:
                    b = get(r)
                    if b is None:
                        buckets[r] = 1 << i
                        words[r >> 8] |= 1 << (r & 255)
                        top |= 1 << (r >> 8)
                    else:
                        buckets[r] = b | 1 << i
            else:
                pair[i] = -1
            if h >= 0:
                pair[h] = r = rank_of(raw[h:k], -1)
                if r >= 0:
                    b = get(r)
                    if b is None:
                        buckets[r] = 1 << h
                        words[r >> 8] |= 1 << (r & 255)
                        top |= 1 << (r >> 8)
                    else:
                        buckets[r] = b | 1 << h
        out, i, ranks = [], 0, self.ranks
        while i < n:
            j = after[i]
            out.append(ranks[raw[i:j]])
            i = j
        return tuple(out)

    def _long(self, raw: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        n, longest, rank_of = len(raw), self.longest, ranks.get
        # after[i], before[i]: where the parts next to the one at i begin; pair[i]: the rank of that part with its next
        after = list(range(1, n + 2))
        before = list(range(-1, n))
        pair = [rank_of(raw[i : i + 2], -1) for i in range(n - 1)]
        pair.append(-1)
        queue = self.queue
        put, take = queue.put, queue.take
        for i, r in enumerate(pair):
            if r >= 0:
                put(r, i)
        while (found := take()) is not None:
            rank, i = found
            if pair[i] != rank:
                continue  # stale
            j = after[i]
            k = after[j]
            pair[j] = -1
            after[i] = k
            if k < n:
                before[k] = i
                end = after[k]
                r = rank_of(raw[i:end], -1) if end - i <= longest else -1
                pair[i] = r
                if r >= 0:
                    put(r, i)
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                r = rank_of(raw[h:k], -1) if k - h <= longest else -1
                pair[h] = r
                if r >= 0:
                    put(r, h)
        out, i = [], 0
        while i < n:
            j = after[i]
            out.append(ranks[raw[i:j]])
            i = j
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.find(text))))

    def decode_bytes(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def rust_pattern(pattern: str) -> str:
    """White space is the Unicode property (without the information separators), as the vocabulary's own library has it."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def codec(path: str, pattern: str, remember: int = REMEMBER) -> Codec:
    """One codec for each vocabulary, kept by a Python worker while it is used."""
    return held(("codec", path, pattern, remember), lambda: Codec(load_ranks(path), pattern, remember))


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", into: str = "ids", check: str | None = None) -> DataFrame:
    """``docs`` with an array column of token ids, in place of one of that name; no shuffle. With ``check`` a boolean column of that name, too: whether
    the ids decode to the text. The vocabulary file must be on every executor."""
    default = default_vocabulary() if path is None or pattern is None else (path, pattern)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (into, check)])
    at, names = docs.columns.index(text), docs.columns
    kinds = extended(docs, f"`{into}` array<int>" + (f", `{check}` boolean" if check else ""))
    use = (path or default[0], pattern or default[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*use, REMEMBER_LESS)
        for b in slices(batches, at, SLICE):
            texts = [t or "" for t in b.column(at).to_pylist()]
            ids = [c.encode(t) for t in texts]
            cols = [pa.array(ids, pa.list_(pa.int32()))]
            if check:
                cols.append(pa.array([c.decode_bytes(i) == t.encode() for i, t in zip(ids, texts, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*names, into, *([check] if check else [])])

    return arrow_map(docs, run, kinds)


def decode_documents(rows: DataFrame, path: str | None = None, pattern: str | None = None, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with a binary column: the bytes that the ids stand for (null ids: no bytes)."""
    default = default_vocabulary() if path is None or pattern is None else (path, pattern)
    rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != into])
    at, names = rows.columns.index(ids), rows.columns
    kinds = extended(rows, f"`{into}` binary")
    use = (path or default[0], pattern or default[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*use, REMEMBER_LESS)
        for b in slices(batches, at, SLICE):
            raw = pa.array([c.decode_bytes(x or ()) for x in b.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, raw], [*names, into])

    return arrow_map(rows, run, kinds)


# --- the registered query -------------------------------------------------

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Counts and digests of the ids and of the bytes they decode to, without sending the ids anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        text_of = [str(i) for i in range(max(c.bytes_of, default=0) + 1)].__getitem__
        for b in slices(batches, 1):
            rows = []
            for t in b.column(1).to_pylist():
                ids = c.encode(t or "")
                rows.append((len(ids), sha256(",".join(map(text_of, ids)).encode()).hexdigest(), sha256(c.decode_bytes(ids)).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, RESULT)


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return digests(table(spark, sf_dir, "documents"), *default_vocabulary())
