"""Quality selection by importance resampling.

Two generative models, bags of hashed word unigrams and bigrams: one of the
target (documents labelled good), one of the raw corpus (all documents). A
document's log weight is the sum, over its n-grams, of the log ratio of the
models' probabilities. Adding Gumbel noise and taking the k largest samples k
documents without replacement in proportion to their weights.

The target model is fitted on a bounded sample of the labelled rows
(``target_rows``, those whose ids hash lowest, about); the raw counts cover
everything. Noise follows from the id and a seed. The k-th largest key is found
exactly, by counting keys in ever narrower ranges; keys equal to it are all
selected.

Defined results: very long texts are weighed whole; of equal keys at the end of the
selection all are selected; documents without words have weight 0 and no key, and are never
selected; null labels and labels without a document are ignored; rows of equal
id have equal noise; other columns are ignored; without good labels no document
is selected; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, arrow_map, slices, table
from .near_dup import SLICE, _mix, _Q, word_hashes

BUCKETS = 1 << 16
TARGET_ROWS = 20_000
SMOOTH = 1.0
SEED = 1
BINS = 4096


def ngram_buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all texts' n-grams, text after text, and each text's number of them."""
    word, first, last = word_hashes(texts)
    n = last - first
    owner = np.repeat(np.arange(len(texts)), n)
    inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(word) else np.empty(0, np.int64)
    pair = _mix(word[inner] * np.uint64(_Q) + word[inner + 1]) if len(inner) else np.empty(0, np.uint64)
    owners = np.concatenate((owner, owner[inner])) if len(word) else owner
    grams = np.concatenate((word, pair))
    order = np.argsort(owners, kind="stable")
    return (grams[order] >> np.uint64(64 - 16)).astype(np.int64), np.bincount(owners, minlength=len(texts))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for b in slices(batches, 0, SLICE):
        buckets, sizes = ngram_buckets(b.column(0).to_pylist())
        raw += np.bincount(buckets, minlength=BUCKETS)
        good = np.repeat(b.column(1).to_numpy(zero_copy_only=False).astype(bool), sizes)
        target += np.bincount(buckets[good], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])


def log_ratios(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS) -> np.ndarray | None:
    """The log ratio of target to raw for each bucket; None without a target."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    n = good.count()
    scale = 1 << 30
    sample = good.filter(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < scale * target_rows // max(n, 1)).limit(2 * target_rows) if n > target_rows else good
    flag = F.broadcast(sample.withColumn("_good", F.lit(True)))  # target_rows ids, about; twice that at most
    rows = docs.select("doc_id", "text").join(flag, "doc_id", "left").select("text", F.coalesce("_good", F.lit(False)).alias("good"))
    counts = arrow_map(rows, _count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, r, t in counts:
        raw[b], target[b] = r, t
    if not target.sum():
        return None
    return np.log((target + SMOOTH) / (target.sum() + SMOOTH * BUCKETS)) - np.log((raw + SMOOTH) / (raw.sum() + SMOOTH * BUCKETS))


def log_weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, n_ngrams and log_weight of every row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for b in slices(batches, 1, SLICE):
            buckets, sizes = ngram_buckets(b.column(1).to_pylist())
            total = np.concatenate(([0.0], np.cumsum(ratio[buckets])))
            ends = np.cumsum(sizes)
            sums = [float(np.sum(ratio[buckets[e - n : e]])) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)] if len(total) else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes.astype(np.int64)), pa.array(sums, pa.float64())], ["doc_id", "n_ngrams", "log_weight"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_ngrams long, log_weight double")


def kth_largest(df: DataFrame, key: str, k: int) -> float | None:
    """The k-th largest non-null value, exactly, from counts of at most BINS ranges at a time."""
    df = df.filter(F.col(key).isNotNull()).select(key)
    low, high, n = df.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    if not n or k < 1:
        return None
    k = min(k, n)
    while low < high:
        width = (high - low) / BINS
        here = F.least(F.floor((F.col(key) - low) / width), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        held = df.filter(F.col(key).between(low, high)).groupBy(here.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("x"), F.max(key).alias("y")).orderBy(F.desc("b")).collect()
        for r in held:
            if k <= r["n"]:
                break
            k -= r["n"]
        if (r["x"], r["y"]) == (low, high):
            break  # too close to be told apart
        low, high = r["x"], r["y"]
    return high


def resample(docs: DataFrame, labels: DataFrame, share: float, seed: int = SEED, target_rows: int = TARGET_ROWS) -> DataFrame:
    """doc_id, n_ngrams, log_weight, key and selected of every row; round(share * rows with words) rows are selected.
    Runs when called."""
    ratios = log_ratios(docs, labels, target_rows)
    if ratios is None:
        ratios, share = np.zeros(BUCKETS), 0.0
    u = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    key = F.when(F.col("n_ngrams") > 0, F.col("log_weight") - F.log(-F.log(u)))
    scored = Table(log_weights(docs, ratios).withColumn("key", key), "quality-keys").df
    n = scored.filter("n_ngrams > 0").count()
    least = kth_largest(scored, "key", round(share * n))
    return scored.withColumn("selected", F.coalesce(F.col("key") >= F.lit(least), F.lit(False)) if least is not None else F.lit(False))


# --- the registered query -------------------------------------------------


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's weight; as large a share is selected as is good among the labelled ones."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    share = labels.agg(F.avg(F.col("quality").cast("double")).alias("x")).first()["x"] or 0.0
    return resample(docs, labels, share)
