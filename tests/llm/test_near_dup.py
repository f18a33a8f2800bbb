"""Near-duplicates against all pairs, with hot groups, families at the threshold and odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm import components as graph
from tidemark.llm import near_dup as N
from tidemark.llm.components import connected_components


def sets_of(texts):
    out = []
    for t in texts:
        w = bytes(t or "", "utf-8").lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def components(ids, texts):
    sets, low = sets_of(texts), {}
    group = list(range(len(ids)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                group[root(a)] = root(b)
    for i, d in enumerate(ids):
        low[root(i)] = min(low.get(root(i), d), d)
    return {d: (len(sets[i]), low[root(i)]) for i, d in enumerate(ids)}


def edited(rnd, words, n):
    out = list(words)
    for _ in range(n):
        out[rnd.randrange(len(out))] = f"w{rnd.randrange(10**6)}"
    return out


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(4000)}"
    texts = [None, "", " \t\n", "one", "ONE", "one two", "a b c d", "a b c d e", "A  b\nc d e"]
    shared = [word() for _ in range(30)]
    for size, members, edits in ((60, 40, 3), (60, 60, 5), (25, 10, 1), (120, 30, 12), (6, 4, 1), (200, 8, 9)):
        base = [word() for _ in range(size)]
        for _ in range(members):
            texts.append(" ".join(edited(rnd, base, rnd.randint(0, edits))))
    chain = [word() for _ in range(50)]
    for _ in range(40):  # each like the one before, the ends unlike
        chain = edited(rnd, chain, 1)
        texts.append(" ".join(chain))
    texts += [" ".join([word() for _ in range(40)] + shared) for _ in range(60)]
    texts += [texts[20]] * 30 + [texts[20].upper()]
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(N, "CHUNK", 16)  # several cells to a family
    texts = corpus(seed)
    rows = [(10 * i + 3, t, 1, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int, kept string").repartition(7)
    want = components([r[0] for r in rows], texts)
    got = N.near_duplicates(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_deduplicate(spark):
    texts = ["a b c d e f", "A B C D E F", "g h i j k l", None, "", "g h i j k l"]
    rows = [(i, t, f"s{i}", i) for i, t in enumerate(texts)] + [(2, "g h i j k l", "again", 0), (None, "g h i j k l", "none", 1), (None, "q r s t u v", "none", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _key int")
    out = N.deduplicate(df)
    assert out.columns == df.columns
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in out.collect())
    assert got == [(-1, "q r s t u v"), (0, "a b c d e f"), (2, "g h i j k l"), (3, ""), (4, "")]
    assert N.deduplicate(df.limit(0)).count() == 0
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_sets_and_minima():
    texts = ["a b c d e f a b c d e", "x", None, " y  z\x1cq ", "A\x0bB\x0cc\rd e"]
    got = N.shingle_sets(texts)
    assert [len(s) for s in got] == [len(s) for s in sets_of(texts)]
    assert set(N.shingle_sets(["a b c d e"])[0]) == set(got[4]) and set(got[4]) <= set(got[0])
    rnd = random.Random(1)
    base = [f"w{i}" for i in range(300)]
    a, b = N.shingle_sets([" ".join(base), " ".join(edited(rnd, base, 10))])
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(np.mean(N.minima(a) == N.minima(b)) - true) < 0.06


def test_estimate(spark):
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(400)]
    for n in (0, 4, 12, 40):
        a, b = N.shingle_sets([" ".join(base), " ".join(edited(rnd, base, n))])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        df = spark.createDataFrame([tuple([int(x) for x in N.packed(N.minima(s)).view(np.int64)] for s in (a, b))], "a array<long>, b array<long>")
        assert abs(df.select(N.estimate(F.col("a"), F.col("b")).alias("x")).first()["x"] - true) < 0.09


def test_short_texts_at_the_threshold(spark):
    """Links of similarity exactly 0.75 between texts of a few shingles: 3 of 4, and 6 of 8."""
    rnd, texts = random.Random(9), []
    for few, most in [(7, 8), (10, 12)] * 100:
        words = [f"w{rnd.randrange(10**9)}" for _ in range(most)]
        texts += [" ".join(words[:few]), " ".join(words)]
    want = components(range(len(texts)), texts)
    assert len({c for _, c in want.values()}) == len(texts) // 2
    got = N.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


@pytest.mark.parametrize("few", [0, 4_000_000])
def test_components(spark, few, monkeypatch):
    monkeypatch.setattr(graph, "FEW", few)
    rnd = random.Random(6)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(1000, 1000 + i) for i in range(1, 50)]
    group = {}

    def root(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        group[b] = a
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in list(group) if root(x) != x}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_windows_do_not_change_hashes(monkeypatch):
    """Texts of any length, and words longer than a window, have the same sets however they are cut."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcé漢") for _ in range(rnd.randint(1, 9)))
    texts = [None, "", " \n", "a", "x" * 1000, "y" * 129 + " a b c d e " + "z" * 300, *[" ".join(word() for _ in range(rnd.randint(0, 400))) for _ in range(40)]]
    want = N.shingle_sets(texts)
    for size in (16, 64, 128):
        monkeypatch.setattr(N, "WINDOW", size)
        monkeypatch.setattr(common, "_kept", {})
        assert all(np.array_equal(a, b) for a, b in zip(want, N.shingle_sets(texts), strict=True))
    assert [len(s) for s in want[:5]] == [0, 0, 0, 1, 1]
