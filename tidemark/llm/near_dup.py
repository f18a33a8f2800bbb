"""Near-duplicate documents by b-bit MinHash.

A document's set has its distinct five-word shingles, as 64-bit hashes; with
fewer words the whole sequence is the one shingle. 1024 minima of the set are
taken. Six at a time, the first 384 make 64 band keys, which bring candidates
together; of each minimum, mixed with a number of its own, two bits are kept, packed into longs, and similarity is
estimated from counts of equal bit pairs, corrected for chance agreement (1/4).
Candidates whose estimate is within five standard deviations of the threshold,
or above, are confirmed on the full sets.

Equal sets are one class from the start. Within a band's bucket every class is
paired with the first one alone, so that a bucket of any size gives a linear
number of pairs. Links that this can miss lie between different components of a
bucket: where a bucket still holds several, one member of each is tested against
one of the first. Between the components that are left then, all pairs of
members that hang together by buckets are looked at, in cells of bounded size
that give links alone, and no more of them than join components (estimate first,
then full sets). A link with similarity 0.75 shares no band with a probability
of (1 - 0.75^6)^64 = 4e-6; every other link is found.

Defined results: null text and text without words have the empty set and are
linked with nothing; very long texts are taken whole, hashed in windows of bounded
size; of equally near candidates all are tested; rows of equal text are linked whatever their ids; a null id
takes part, and is the component's id only where it has no other; equal rows get
equal results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, arrow_map, cut, held, slices, table, whole_row
from .components import connected_components

WORDS = 5
THRESHOLD = (75, 100)  # links: 100 * intersection >= 75 * union
BANDS, ROWS, BITS = 64, 6, 2
HASHES = 1024  # the first BANDS * ROWS make the bands
SIG_LONGS = HASHES * BITS // 64
SIGMAS = 5.0
#: Candidate documents whose ids are broadcast to filter the texts; with more, texts are shuffled to them.
BROADCAST_ROWS = 1_000_000
#: Members of a family in one chunk, and their shingles, on average; two chunks' sets are in memory at once.
CHUNK, CHUNK_SHINGLES = 512, 1 << 20
#: Text bytes whose sets are in a worker's memory at once.
SLICE = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64


def _mix(z: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser."""
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def _random(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed))


_BYTE = _random(256, 1)
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xD1B54A32D192ED03 | 1
_P_INV = pow(_P, -1, 1 << 64)
_A = (_random(HASHES, 2) >> _U(32)).astype(np.uint32) | np.uint32(1)
_B = (_random(HASHES, 3) >> _U(32)).astype(np.uint32)
_C = _random(HASHES, 4)
_ROWS_AT_ONCE = 64
#: Bytes of text whose word hashes are computed at once.
WINDOW = 1 << 17


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i for i up to a window's size; built by doubling and kept while it is used."""

    def make() -> tuple[np.ndarray, np.ndarray]:
        made = []
        for base in (_P, _P_INV):
            t = np.ones(2 * WINDOW, np.uint64)
            k = 1
            while k < len(t):
                t[k : 2 * k] = t[:k] * _U(pow(base, k, 1 << 64))
                k *= 2
            made.append(t)
        return made[0], made[1]

    return held("powers", make)


def _hashes_of(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words in a buffer that ends with a space, and where they begin."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[buf])).astype(np.int8)))
    low, high = edge[::2], edge[1::2]
    up, down = _power_tables()
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * up[: len(buf)], dtype=np.uint64)))
    return _mix((total[high] - total[low]) * down[low] + (high - low).astype(np.uint64)), low


def _windows(buf: np.ndarray) -> Iterator[tuple[int, int]]:
    """The buffer in pieces of up to WINDOW bytes that end with a space; a word that has more is a piece with the space after it."""
    at = 0
    while at < len(buf):
        z = min(len(buf), at + WINDOW)
        space = np.flatnonzero(_SPACE[buf[at:z]])
        if len(space):
            end = at + int(space[-1]) + 1
        else:
            while not len(space := np.flatnonzero(_SPACE[buf[z : z + WINDOW]])):
                z += WINDOW
            end = z + int(space[0]) + 1
        yield at, end
        at = end


def _long_word(buf: np.ndarray) -> np.ndarray:
    """The hash of one word, with the space after it, that is longer than the tables; as ``_hashes_of`` gives it."""
    word = buf[:-1]
    up, total = _power_tables()[0], 0
    for at in range(0, len(word), WINDOW):
        part = word[at : at + WINDOW]
        total += int(np.sum(_BYTE[part] * up[: len(part)], dtype=np.uint64)) * pow(_P, at, 1 << 64)
    return _mix(np.array([(total + len(word)) & (1 << 64) - 1], np.uint64))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all texts' words in order, and for each text where its words begin and end among them.

    Words are runs of anything but ASCII white space, with A-Z lower-cased. A word's hash is a difference of
    prefix sums of (byte's random number * P^position), divided by P^(the word's position), mixed."""
    raw = [(t or "").encode().lower() for t in texts]  # bytes.lower() touches A-Z alone
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)  # the last byte is a space
    words, lows = [], []
    for at, z in _windows(buf):
        word, low = (_long_word(buf[at:z]), np.zeros(1, np.int64)) if z - at > 2 * WINDOW else _hashes_of(buf[at:z])
        words.append(word)
        lows.append(low + at)
    word, low = np.concatenate(words), np.concatenate(lows)
    ends = np.cumsum([len(r) + 1 for r in raw])
    return word, np.searchsorted(low, np.concatenate(([0], ends[:-1]))), np.searchsorted(low, ends)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """For each text its distinct shingle hashes, sorted."""
    word, first, last = word_hashes(texts)
    rolled = np.zeros(len(word), np.uint64)
    if len(word) >= WORDS:
        n = len(word) - WORDS + 1
        for k in range(WORDS):
            rolled[:n] = rolled[:n] * _U(_Q) + word[k : k + n]
        rolled[:n] = _mix(rolled[:n] + _U(WORDS))
    out = []
    for a, z in zip(first.tolist(), last.tolist(), strict=True):
        if z - a >= WORDS:
            out.append(np.unique(rolled[a : z - WORDS + 1]))
        elif z > a:
            h = 0
            for w in word[a:z].tolist():
                h = (h * _Q + w) & (1 << 64) - 1
            out.append(_mix(np.array([h + (z - a) & (1 << 64) - 1], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> _U(32)).astype(np.uint32)[:, None]
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), _ROWS_AT_ONCE):
        h = x[at : at + _ROWS_AT_ONCE] * _A
        h += _B
        np.minimum(least, h.min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = _mix(h * _U(_Q) + rows[:, k])
    return h


def packed(least: np.ndarray) -> np.ndarray:
    """Two bits of each mixed minimum, 32 pairs to a long. The low bits of A * x + B itself follow from those of x,
    so that two shingles would agree in all hashes or in none."""
    low = (_mix(least + _C) & _U((1 << BITS) - 1)).reshape(SIG_LONGS, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * _U(BITS)), axis=1)


def digest(shingles: np.ndarray) -> tuple[int, int]:
    raw = blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1, SLICE):
        n, d1, d2, bands, sigs, seen = [], [], [], [], [], {}
        for s in shingle_sets(b.column(1).to_pylist()):
            key = digest(s)
            if key not in seen:
                least = minima(s)
                seen[key] = (band_keys(least).view(np.int64), packed(least).view(np.int64)) if len(s) else (None, None)
            n.append(len(s))
            d1.append(key[0])
            d2.append(key[1])
            bands.append(seen[key][0])
            sigs.append(seen[key][1])
        cols = [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "_key", "n", "d1", "d2", "bands", "sig"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 0, SLICE):
        sets = shingle_sets(b.column(0).to_pylist())
        ok = [digest(s) == (x, y) for s, x, y in zip(sets, b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        made = pa.RecordBatch.from_arrays([b.column(1), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"])
        yield made.filter(pa.array(ok, pa.bool_()))


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed low bits: (agreement - 1/4) / (1 - 1/4)."""
    ones = 0x5555555555555555
    differ = None
    for i in range(SIG_LONGS):
        x = a[i].bitwiseXOR(b[i])
        one = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(ones)))
        differ = one if differ is None else differ + one
    chance = 2.0**-BITS
    return ((1.0 - differ / float(HASHES)) - chance) / (1.0 - chance)


def _links_in_cell(cell: pa.Table) -> pa.Table:
    """Links between the components of a cell's members, by full sets, until no two linked ones are apart."""
    i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
    mine, node, n = (cell.column(c).to_numpy() for c in ("mine", "node", "n"))
    group = cell.column("label").to_numpy().copy()
    sig = cell.column("sig").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), SIG_LONGS)
    full = cell.column("shingles").combine_chunks()
    sets = [full[k].values.to_numpy().view(np.uint64) for k in range(len(node))]
    least, chance = least_estimate(), 2.0**-BITS
    found = []
    for a in range(len(node) - 1):
        rest = slice(a + 1, None)
        near = np.minimum(n[rest], n[a]) * THRESHOLD[1] >= np.maximum(n[rest], n[a]) * THRESHOLD[0]
        near &= group[rest] != group[a]
        if i != j:
            near &= mine[rest] != mine[a]
        at = np.flatnonzero(near) + a + 1
        if len(at):
            x = sig[at] ^ sig[a]
            differ = np.bitwise_count((x | (x >> _U(1))) & _U(0x5555555555555555)).sum(axis=1)
            score = ((1.0 - differ / HASHES) - chance) / (1.0 - chance)
            order = np.argsort(-score, kind="stable")
            for b in at[order[score[order] >= least]].tolist():
                if group[b] == group[a]:
                    continue
                common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if common * THRESHOLD[1] >= (len(sets[a]) + len(sets[b]) - common) * THRESHOLD[0]:
                    found.append((int(node[a]), int(node[b])))
                    group[group == group[b]] = group[a]
    return pa.table({"u": pa.array([f[0] for f in found], pa.int64()), "v": pa.array([f[1] for f in found], pa.int64())})


def least_estimate() -> float:
    j, chance = THRESHOLD[0] / THRESHOLD[1], 2.0**-BITS
    p = j + (1 - j) * chance
    return j - SIGMAS * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


def _likely(a: str, b: str) -> Column:
    sizes = (F.least(f"{a}_n", f"{b}_n") * THRESHOLD[1]) >= (F.greatest(f"{a}_n", f"{b}_n") * THRESHOLD[0])
    return sizes & (estimate(F.col(f"{a}_sig"), F.col(f"{b}_sig")) >= least_estimate())


class _Linker:
    """The steps over one table of classes."""

    def __init__(self, docs: DataFrame) -> None:
        self.docs, self.spark = docs.select("doc_id", "text"), docs.sparkSession
        keyed = self.docs.withColumn("_key", F.xxhash64("doc_id", "text"))
        self.tables: list[Table] = []
        self.rows = self.written(arrow_map(keyed, _sketch, "doc_id " + dict(docs.dtypes)["doc_id"] + ", _key long, n long, d1 long, d2 long, bands array<long>, sig array<long>"), "rows")
        firsts = [F.first(c).alias(c) for c in ("n", "bands", "sig")]
        self.classes = self.written(self.rows.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), *firsts).withColumn("node", F.monotonically_increasing_id()), "classes")

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(Table(df, f"near-{name}"))
        return self.tables[-1].df

    def signatures(self, side: str) -> DataFrame:
        return self.classes.select(F.col("node").alias(side), F.col("n").alias(f"{side}_n"), F.col("sig").alias(f"{side}_sig"))

    def first_pairs(self) -> DataFrame:
        """(a, b): a class and the first of a bucket that it is in."""
        members = self.classes.select("node", F.explode("bands").alias("key"))
        buckets = members.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("last"), F.count(F.lit(1)).alias("size"))
        buckets = self.written(buckets.filter("size > 1"), "buckets")
        self.large = buckets.filter("size > 2").select("key", "a")
        self.members = self.written(members.join(self.large, "key"), "members")
        pairs = buckets.filter("size = 2").select("a", F.col("last").alias("b")).union(self.members.filter("a != node").select("a", F.col("node").alias("b"))).distinct()
        return self.written(pairs.join(self.signatures("a"), "a").join(self.signatures("b"), "b").filter(_likely("a", "b")).select("a", "b", estimate(F.col("a_sig"), F.col("b_sig")).alias("likeness")), "pairs")

    def sets(self, pairs: DataFrame) -> DataFrame:
        """The full sets of the classes in ``pairs``."""
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = self.written(self.classes.select("node", F.col("rep").alias("doc_id"), "d1", "d2").join(nodes, "node", "left_semi"), "wanted")
        few = wanted.count() <= BROADCAST_ROWS
        texts = self.docs.alias("t").join(F.broadcast(wanted) if few else wanted, self.docs["doc_id"].eqNullSafe(wanted["doc_id"])).select("text", "node", "d1", "d2")
        return arrow_map(texts, _full_sets, "node long, shingles array<long>")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links, by their full sets."""
        sets = self.sets(pairs)
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        both = pairs.select("a", "b").join(right, "b").join(left, "a")
        common = F.size(F.array_intersect("x", "y"))
        union = F.size("x") + F.size("y") - common
        return self.written(both.filter(common * THRESHOLD[1] >= union * THRESHOLD[0]).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "links")

    def labelled(self, frame: DataFrame, labels: DataFrame, node: str, into: str) -> DataFrame:
        return frame.join(labels.select(F.col("node").alias(node), F.col("label").alias(into)), node, "left").withColumn(into, F.coalesce(into, node))

    def apart(self, pairs: DataFrame, labels: DataFrame) -> DataFrame:
        return self.labelled(self.labelled(pairs, labels, "a", "la"), labels, "b", "lb").filter("la != lb")

    def open_buckets(self, labels: DataFrame) -> DataFrame:
        """Members (key, node, label, n, sig) of the buckets that hold several components."""
        members = self.labelled(self.members.select("key", "node"), labels, "node", "label")
        members = self.written(members, "labelled")
        split = members.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y").select("key")
        return self.written(members.join(split, "key").join(self.classes.select("node", "n", "sig"), "node"), "open")

    def rivals(self, held: DataFrame, seed: int) -> DataFrame:
        """For each bucket and component one member, another with each seed, paired with that of the bucket's first component."""
        one = F.min_by(F.struct("node", "n", "sig"), F.xxhash64("node", F.lit(seed))).alias("m")
        each = held.groupBy("key", "label").agg(one)
        lead = each.groupBy("key").agg(F.min_by("m", "label").alias("l"), F.min("label").alias("first"))
        met = each.join(lead, "key").filter("label != first").select(*[F.col(f"l.{c}").alias(f"a{'_' * (c != 'node') + c * (c != 'node')}") for c in ("node", "n", "sig")], *[F.col(f"m.{c}").alias(f"b{'_' * (c != 'node') + c * (c != 'node')}") for c in ("node", "n", "sig")])
        return self.likely_pairs(met)

    def remaining(self, held: DataFrame) -> DataFrame:
        """Links (u, v) between components that share a bucket, enough to join them. Members that hang together by
        buckets are a family; a family is dealt to chunks, and each two chunks meet in one cell of bounded size,
        where every pair of different components is looked at once."""
        lead = held.groupBy("key").agg(F.min("node").alias("v"))
        family = connected_components(held.join(lead, "key").select(F.col("node").alias("u"), "v"), self.tables)
        nodes = self.labelled(held.select("node", "label", "n", "sig").dropDuplicates(["node"]), family, "node", "family")
        nodes = self.written(nodes, "apart")
        sizes = nodes.groupBy("family").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
        chunks = F.ceil(F.greatest(F.col("size") / CHUNK, F.col("shingles") / CHUNK_SHINGLES))
        mine = F.pmod(F.xxhash64("node"), chunks).alias("mine")
        dealt = nodes.join(sizes.filter("size > 1"), "family").select("node", "label", "n", "sig", "family", chunks.alias("chunks"), mine)
        cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda k: F.struct(F.least(k, "mine").alias("i"), F.greatest(k, "mine").alias("j")))
        sets = self.sets(nodes.select(F.col("node").alias("a"), F.col("node").alias("b")))
        full = dealt.join(sets, "node").select("*", F.explode(cells).alias("c")).select("family", "c.i", "c.j", "mine", "node", "label", "n", "sig", "shingles")
        return self.written(full.groupBy("family", "i", "j").applyInArrow(_links_in_cell, "u long, v long"), "found")

    def likely_pairs(self, met: DataFrame) -> DataFrame:
        pairs = met.filter(_likely("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), estimate(F.col("a_sig"), F.col("b_sig")).alias("likeness"))
        return self.written(pairs.distinct(), "pairs")

    def settle(self, pairs: DataFrame, by: list[Column] | None = None) -> None:
        """Tests the ``pairs`` (a, b, likeness) that lie between different components; given ``by``, the likeliest of
        each group first, and then those that still do."""
        rest = self.written(self.apart(pairs, self.found), "rest")
        if by and not rest.isEmpty():
            best = rest.groupBy(*by).agg(F.max_by(F.struct("a", "b"), F.struct("likeness", -F.col("a"), -F.col("b"))).alias("p")).select("p.a", "p.b")
            best = self.written(best, "best")
            self.link(best)
            rest = self.written(self.apart(rest.drop("la", "lb"), self.found).join(best, ["a", "b"], "left_anti"), "rest")
        if not rest.isEmpty():
            self.link(rest)

    def link(self, pairs: DataFrame) -> None:
        """Adds the links among ``pairs`` and finds the components anew, from those there are."""
        self.link_all(self.confirmed(pairs))

    def link_all(self, links: DataFrame) -> None:
        if not links.isEmpty():
            known = self.found.select(F.col("node").alias("u"), F.col("label").alias("v"))
            self.found = connected_components(known.union(links), self.tables)

    def labels(self) -> DataFrame:
        """node and label of every class that is linked to a smaller one."""
        self.found = self.spark.createDataFrame([], "node long, label long")
        self.settle(self.first_pairs(), [F.col("b")])
        held = self.open_buckets(self.found)
        if not held.isEmpty():
            self.settle(self.rivals(held, 1))
            held = self.open_buckets(self.found)
        if not held.isEmpty():
            self.link_all(self.remaining(held))
        return self.found

    def result(self) -> DataFrame:
        nodes = self.labelled(self.classes.select("node", "rep", "d1", "d2"), self.labels(), "node", "label")
        nodes = self.written(nodes, "labels")
        least = nodes.groupBy("label").agg(F.min("rep").alias("component_id"))
        by_class = nodes.join(least, "label").select("d1", "d2", "component_id")
        rows = self.rows.select("doc_id", "_key", "n", "d1", "d2")
        linked = rows.filter("n > 0").join(by_class, ["d1", "d2"]).select("doc_id", "_key", F.col("n").alias("n_shingles"), "component_id")
        return linked.union(rows.filter("n = 0").select("doc_id", "_key", "n", F.col("doc_id").alias("c"))).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

    def drop(self) -> None:
        for t in self.tables:
            t.drop()


def _components(docs: DataFrame) -> DataFrame:
    linker = _Linker(docs)
    out = cut(linker.result())
    linker.drop()
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row. Runs when called; the result is read from the
    shared checkpoint folder."""
    return _components(docs).drop("_key")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with the same columns and one row of each component; rows without words all stay."""
    found = _components(docs)
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), "_key").distinct()
    few = gone.count() <= BROADCAST_ROWS
    rows = docs.select(whole_row(docs).alias("_row"), F.xxhash64("doc_id", "text").alias("_k"))
    gone = F.broadcast(gone) if few else gone
    rows = rows.join(gone, (rows["_k"] == gone["_key"]) & rows["_row.doc_id"].eqNullSafe(gone["_id"]), "left_anti")
    kept = found.filter(F.col("kept") & (F.col("n_shingles") > 0))
    total = kept.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.struct(F.coalesce("component_id", F.lit(-1)), F.col("component_id").isNull())).alias("groups")).first()
    if total["n"] > total["groups"]:  # equal ids: rows of one id and component are all its first
        wordless = F.length(F.trim(F.translate(F.coalesce("_row.text", F.lit("")), "\t\n\x0b\f\r", "     "))) == 0
        groups = kept.select(F.col("doc_id").alias("_id"), "_key", "component_id").distinct()
        first = groups.groupBy("component_id").agg(F.min("_key").alias("_key")).select(F.col("component_id").alias("_id"), "_key")
        some = rows.filter(~wordless)
        some = some.join(first, (some["_k"] == first["_key"]) & some["_row.doc_id"].eqNullSafe(first["_id"])).select(some["_row"], some["_k"])
        rows = some.groupBy("_k", "_row.doc_id").agg(F.first("_row").alias("_row")).select("_row").union(rows.filter(wordless).select("_row"))
    return rows.select("_row.*")


# --- the registered query -------------------------------------------------


def op5_near_dup(spark, sf_dir: str) -> DataFrame:
    """Every document with its component of near-duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y
), c AS (SELECT x, min(y) AS m FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.x = d.doc_id
"""
