"""Document fingerprints by content-defined chunking.

A gear hash over the last 16 bytes is computed for every byte of a text; a
boundary falls where its high bits are zero. Boundaries are normalised: up to a
normal chunk length a strict mask (7 bits) must be met, beyond it a loose one
(4 bits), so that chunk lengths gather around the normal length; no chunk but a
text's last is shorter than 16 bytes and none is longer than 192. As a boundary
depends on nearby bytes alone, an edit changes the chunks that it touches and
the boundaries fall into step again after it.

A fingerprint is the sorted set of the chunks' 48-bit digests with their
lengths, in hexadecimal (12 digits of digest, 2 of length for each chunk).
Containment of A in B is the length of A's chunks that B has, over the length
of all of A's chunks (each distinct chunk counts once).

Defined results: null text counts as empty; very long texts are fingerprinted whole; the empty text has the empty
fingerprint; two empty fingerprints contain each other (1.0), an empty and a
filled one don't (0.0). Repeated rows and equal ids are kept; rows of equal id
are ordered by a hash of their text, null ids come last in descending order. Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, arrow_map, slices, table
from .ordering import dealt_in_order

WINDOW, LEAST, NORMAL, MOST = 16, 16, 48, 192
STRICT_BITS, LOOSE_BITS = 7, 4
DIGEST_BYTES = 6


def gear_table(seed: int = 0x9E3779B9) -> np.ndarray:
    """A random word for each byte value, from the SplitMix64 rule."""
    z = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(seed)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


GEAR = gear_table()


def gear_hashes(buf: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[buf[i - k]] << k for k below WINDOW, by doubling the window."""
    h, m = GEAR[buf], 1
    while m < WINDOW:
        if len(h) > m:
            h[m:] += h[:-m] << np.uint32(m)
        m *= 2
    return h


def chunk_ends(texts: Sequence[bytes]) -> list[list[int]]:
    """For each text the ends of its chunks, as offsets into the texts laid end to end."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    h = gear_hashes(buf)
    end = len(buf)
    loose_at = np.flatnonzero(h < np.uint32(1 << (32 - LOOSE_BITS)))
    strict = loose_at[h[loose_at] < np.uint32(1 << (32 - STRICT_BITS))].tolist()
    loose = loose_at.tolist()
    strict.append(end + MOST)
    loose.append(end + MOST)
    out, at, i, j = [], 0, 0, 0
    for t in texts:
        stop, ends = at + len(t), []
        while at < stop:
            if stop - at <= LEAST:
                at = stop
            else:
                i = bisect_left(strict, at + LEAST - 1, i)
                cut = strict[i] + 1
                if cut > at + NORMAL:
                    j = bisect_left(loose, at + NORMAL, j)
                    cut = min(loose[j] + 1, at + MOST)
                at = min(cut, stop)
            ends.append(at)
        out.append(ends)
    return out


def fingerprints(texts: Sequence[bytes]) -> list[dict[int, int]]:
    """For each text its chunk digests with their lengths."""
    out, digest, keep = [], xxhash.xxh3_64_intdigest, (1 << (8 * DIGEST_BYTES)) - 1
    group: list[bytes] = []
    size = 0

    def flush() -> None:
        at = 0
        for t, ends in zip(group, chunk_ends(group), strict=True):
            one, low, base = {}, 0, at
            for e in ends:
                e -= base
                one[digest(t[low:e]) & keep] = e - low
                low = e
            out.append(one)
            at += len(t)

    for t in texts:
        group.append(t)
        size += len(t)
        if size >= SLICE_BYTES:
            flush()
            group, size = [], 0
    if group:
        flush()
    return out


def as_text(fp: dict[int, int]) -> str:
    return b"".join([d.to_bytes(DIGEST_BYTES, "big") + fp[d].to_bytes(1, "big") for d in sorted(fp)]).hex()


def parse(text: str) -> dict[int, int]:
    raw, w = bytes.fromhex(text), DIGEST_BYTES + 1
    return {int.from_bytes(raw[i : i + w - 1], "big"): raw[i + w - 1] for i in range(0, len(raw), w)}


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    if not a or not b:
        return float(not a and not b)
    return sum(map(a.__getitem__, a.keys() & b.keys())) / sum(a.values())


def fingerprint_documents(docs: DataFrame, text: str = "text", keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keys``, fingerprint and n_chunks of every row; no shuffle."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, len(keys)):
            fps = fingerprints([(t or "").encode() for t in b.column(len(keys)).to_pylist()])
            cols = [pa.array(map(as_text, fps), pa.string()), pa.array(map(len, fps), pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *cols], [*keys, "fingerprint", "n_chunks"])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "fingerprint string, n_chunks long"])
    return arrow_map(docs.select(*keys, text), run, schema)


# --- the registered query -------------------------------------------------

RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_chunks long"


def _with_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in ascending order, so that the next document in descending order is the row before."""
    before, before_fp = "", {}
    names = [x.split()[0] for x in RESULT.split(", ")]
    for b in slices(batches, 1):
        ids, carried = b.column(0).to_pylist(), b.column(2).to_pylist()
        texts = [t or "" for t in b.column(1).to_pylist()]
        edited, last = [], before
        for t, c in zip(texts, carried, strict=True):
            half = len(t) // 2
            edited.append(b"" if c else (t[: len(t) - half] + last[:half]).encode())
            last = t
        fps = fingerprints([t.encode() for t in texts])
        edited_fps = fingerprints(edited)
        rows = []
        for i, c in enumerate(carried):
            if not c:
                fp, efp = fps[i], edited_fps[i]
                rows.append((ids[i], len(texts[i]), sha256(edited[i]).hexdigest(), as_text(fp), as_text(efp), containment(fp, efp), containment(fp, before_fp), len(fp)))
            before_fp = fps[i]
        before = last
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    rows = dealt_in_order(docs.select("doc_id", "text"), "doc_id", [F.xxhash64("text")])
    return arrow_map(rows.select("doc_id", "text", "_carried"), _with_edits, RESULT)


def op2_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and how much of the first the others contain."""
    return fingerprints_with_edits(table(spark, sf_dir, "documents"))
