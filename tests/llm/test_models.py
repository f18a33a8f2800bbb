"""Language ID, quality resampling and the pipeline."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lang_id, quality


# --- language ID ------------------------------------------------------------------


def enumerate_word(w, pieces, a, unknown):
    if not w:
        return 1.0
    total = 0.0
    for n in range(1, len(w) + 1):
        p = pieces[w[:n]][a] if w[:n] in pieces else (unknown if n == 1 else 0.0)
        if p:
            total += p * enumerate_word(w[n:], pieces, a, unknown)
    return total


def test_forward_sums_all_segmentations():
    rnd = random.Random(1)
    pieces = {p: (rnd.random(), rnd.random()) for p in [lang_id.MARK, lang_id.MARK + "a", "a", "b", "ab", "ba", "abab", "bb"]}
    m = lang_id.Model(["x", "y"], pieces)
    for w in ["a", "b", "abab", "babcab", "c", "bbbbbbbb", "aabbabab"]:
        for a in (0, 1):
            want = math.log(enumerate_word(lang_id.MARK + w, pieces, a, lang_id.UNKNOWN))
            assert m._arcs(lang_id.MARK + w)[a] == pytest.approx(want)
            assert m._forward(lang_id.MARK + w)[a] == pytest.approx(want)
    w = lang_id.MARK + "ab" * 60
    assert m._forward(w) == pytest.approx(m._arcs(w))
    assert all(map(math.isfinite, m._forward(lang_id.MARK + "ab" * 5000)))


def test_sums_do_not_underflow_at_any_length():
    pieces = {lang_id.MARK: (0.1, 0.2), "q": (0.001, 0.1)}
    m = lang_id.Model(["x", "y"], pieces)
    for n in (20, 44, 45, 46, 47, 48, 49, 60, 400):
        for w in ("z" * n, "z" * (n - 1) + "q", "é" * n):
            assert m.word(w) == pytest.approx(m._forward(lang_id.MARK + w))
            assert all(x == pytest.approx(log_sum) for x, log_sum in zip(m.word(w), [math.log(pieces[lang_id.MARK][a]) + sum(math.log(pieces[c][a] if c in pieces else lang_id.UNKNOWN) for c in w) for a in (0, 1)], strict=True))


def test_expected_counts_against_enumeration():
    probs = {lang_id.MARK + "a": 0.3, lang_id.MARK: 0.1, "a": 0.2, "b": 0.3, "ab": 0.1}
    got = {}
    lang_id.expected_counts("ab", 2, probs, 2, got)
    ways = {(lang_id.MARK + "a", "b"): 0.09, (lang_id.MARK, "a", "b"): 0.006, (lang_id.MARK, "ab"): 0.01}
    total = sum(ways.values())
    for piece in probs:
        assert got.get(piece, 0) == pytest.approx(2 * sum(p * w.count(piece) for w, p in ways.items()) / total)


def test_long_runs_have_the_same_counts():
    probs = {lang_id.MARK + "a": 0.3, lang_id.MARK: 0.1, "a": 0.2, "b": 0.3, "ab": 0.1}
    for w in ("ab", "b", "abcab" * 6):
        short, long = {}, {}
        lang_id.expected_counts(w, 3, probs, 2, short)
        lang_id.long_counts(w, 3, probs, 2, long)
        assert long == pytest.approx(short)
    got = {}
    lang_id.expected_counts("ab" * 3000, 2, probs, 2, got)
    assert sum(len(p) * n for p, n in got.items()) == pytest.approx(2 * (6000 + len(lang_id.MARK)))


def test_learns_from_runs_without_spaces(spark):
    pytest.importorskip("public_tokenizers")
    words = {"de": "und nicht eine werden durch zwischen freundschaft wasser".split(), "en": "the which would through between friendship water because".split()}
    rnd = random.Random(4)
    glued = lambda lang: "".join(rnd.choice(words[lang]) for _ in range(60))
    model = lang_id.learn(spark.createDataFrame([(i, lang, glued(lang)) for i in range(20) for lang in words], "doc_id long, lang string, text string"))
    for lang in words:
        for text in (glued(lang), " ".join(words[lang])):
            found, score = model.predict(text)
            assert found == lang and score > 0.9


def test_held_out_accuracy(spark, sf):
    pytest.importorskip("public_tokenizers")
    got = lang_id.op6_lang_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    out = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)


def test_odd_rows(spark):
    pytest.importorskip("public_tokenizers")
    en, de = "the quick brown fox and the other one", "der schnelle braune fuchs und die andere"
    rows = [(i, f"{en} {i}" if i % 2 else f"{de} {i}", "en" if i % 2 else "de", "x") for i in range(40)]
    rows += [(100, None, "en", "x"), (101, "123 !? ²", "de", "x"), (102, "", None, "x"), (103, en.upper(), None, "x"), (None, de, None, "x"), (104, "ü" * 3000, None, "x"), (1, rows[1][1], "en", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = lang_id.trained(df)
    got = {r["doc_id"]: r for r in lang_id.identify(df.select("doc_id", "text"), model).collect()}
    assert [got[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3
    assert (got[103]["lang_pred"], got[None]["lang_pred"]) == ("en", "de")
    kept = lang_id.known_language(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    nothing = lang_id.trained(df.filter("lang IS NULL"))
    assert {r["lang_pred"] for r in lang_id.identify(df.select("doc_id", "text"), nothing).collect()} == {"und"}
    assert lang_id.known_language(df.limit(0)).count() == 0


# --- quality -------------------------------------------------------------------------


def test_weights_against_brute_force(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("a b c dd E".split()) for _ in range(rnd.choice([0, 1, 2, 9, 40]))) for _ in range(60)] + [None, ""]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, key double")
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(40)] + [(999, 1), (None, 1), (3, None)], "doc_id long, quality int")
    grams = []
    for t in texts:
        buckets, sizes = quality.ngram_buckets([t])
        w = (t or "").lower().split()
        assert sizes[0] == len(buckets) == len(w) + max(0, len(w) - 1)
        grams.append(buckets)
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i, g in enumerate(grams):
        np.add.at(raw, g, 1)
        if i < 40 and i % 3:
            np.add.at(target, g, 1)
    ratio = np.log((target + 1) / (target.sum() + quality.BUCKETS)) - np.log((raw + 1) / (raw.sum() + quality.BUCKETS))
    got = quality.resample(df, labels, 0.5).collect()
    for r in got:
        assert r["log_weight"] == pytest.approx(ratio[grams[r["doc_id"]]].sum())
    keys = sorted((r["key"] for r in got if r["key"] is not None), reverse=True)
    k = round(0.5 * len(keys))
    assert all(r["selected"] == (r["key"] is not None and r["key"] >= keys[k - 1]) for r in got)
    assert not any(r["selected"] for r in quality.resample(df, labels.filter("quality = 7"), 0.5).collect())
    assert quality.resample(df.limit(0), labels, 0.5).count() == 0


@pytest.mark.parametrize("k", [1, 2, 50, 99, 100, 1000])
def test_kth_largest(spark, k):
    rnd = random.Random(k)
    xs = [rnd.choice([rnd.gauss(0, 1), 5.0, 1e9 * rnd.random(), -3.0]) for _ in range(100)]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double")
    assert quality.kth_largest(df, "x", k) == sorted(xs, reverse=True)[min(k, 100) - 1]


def test_quality_tells_junk(spark, sf):
    got = quality.op7_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("quality IS NOT NULL")
    rate = {r["quality"]: r["x"] for r in got.groupBy("quality").agg(F.avg(F.col("selected").cast("int")).alias("x")).collect()}
    assert rate[1] > 0.85 and rate[0] < 0.4


# --- the pipeline ----------------------------------------------------------------------


def test_pipeline(spark, sf):
    pytest.importorskip("public_tokenizers")
    pipeline = pytest.importorskip("corpus_pipeline")
    from tidemark.llm import bpe, decontaminate, near_dup, pii

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, sf).cache()
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
        kept.append(docs)
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in kept]
    assert all(a >= b for a, b in zip(ids, ids[1:], strict=False))
    assert near_dup.near_duplicates(kept[1]).filter("NOT kept").count() == 0
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontaminate.scan_documents(kept[2].select("doc_id", "text"), bench).filter("size(hit_from) > 0").count() == 0
    assert pii.find_personal_data(kept[3])[0].filter("size(base) > 0").count() == 0
    assert kept[4].filter("NOT round_trip").count() == 0
    c = bpe.codec(*bpe.default_vocabulary())
    texts = dict(kept[3].select("doc_id", "text").collect())
    for r in kept[4].collect():
        assert r["ids"] == c.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls everywhere, empty and long texts, repeated rows, names that operators use themselves, and no rows."""
    pytest.importorskip("public_tokenizers")
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, f"some words of the usual kind number {i} and a few more", "en", "s", 1) for i in range(20)]
    rows += [(None, None, None, None, None), (100, None, "en", "s", 0), (101, "", "en", "s", 0), (102, "wort " * 30_000, "de", "s", 5), (103, "mail me@example.com now please, it is urgent", None, "s", 3), (103, "mail me@example.com now please, it is urgent", None, "s", 3), (104, "x" * 100_000, "en", "s", 2)]
    extra = ["_row", "score", "a.b", "node", "_key", "ids", "_words", "kept"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(extra)])
    spark.createDataFrame([(1, None), (None, "of the usual kind number 3 and a few more"), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (df, df.limit(0)):
        for k, (_, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if k < len(pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            kept = out.collect()
            docs = spark.createDataFrame(kept, out.schema)
        if k and docs.columns:
            assert docs.filter("NOT round_trip").count() == 0
    stage = dict(pipeline.STAGES)["MinHash near-dedup"]
    left = [r["doc_id"] for r in stage(spark, df, str(tmp_path)).collect()]
    assert left.count(103) == 1 and left.count(100) == left.count(101) == 1 and left.count(None) == 1
