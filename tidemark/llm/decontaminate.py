"""Benchmark decontamination by a generalised suffix automaton of word sequences.

Texts are lower-cased in A-Z and cut into words (runs of digits, a-z and
characters beyond ASCII). The automaton holds every word sequence of every
benchmark item. A document's words are streamed through it: at each word the
automaton gives the longest sequence, ending there, that any item has. Where
that is ``window`` words or more, the last ``window`` words are an occurrence of
an item's window; items shorter than a window are found whole, through the
suffix links of the states that end them.

The items are taken in blocks of a bounded number of words, each with its own
automaton that is broadcast; a document passes the blocks one after another,
carrying what was hit so far. GROUP blocks make one stage; with more blocks, what
a stage gives is written to a table, its broadcasts are destroyed, and the next
blocks are read. So what the driver and the workers hold is bounded however many
items there are, and no item is left out. Items longer than a block are cut into
pieces that overlap by ``window`` - 1 words, which keeps every window.

Defined results: null text has no words; very long texts are scanned whole; an item without words matches nothing;
an item without an id still marks words but is neither listed nor counted;
equal item ids count once; repeated documents are judged apart; other columns
pass through; empty tables give no hits or no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, arrow_map, extended, slices, table

WINDOW = 10
#: Benchmark words in one automaton.
BLOCK_WORDS = 200_000
#: Automata that are in memory at once.
GROUP = 2
#: Documents that are hit in more than this share of their words go; of others, the hit spans.
MAX_COVERAGE = 0.5

_KEEP = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_KEEP).split() if text else []


def word_spans(text: str) -> list[tuple[int, int]]:
    """Byte offsets of the words in the UTF-8 text."""
    flat, out, at = text.encode().translate(_KEEP), [], 0
    for w in flat.split():
        at = flat.index(w, at)
        out.append((at, at + len(w)))
        at += len(w)
    return out


class Automaton:
    """A generalised suffix automaton over word numbers."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(key, [self.number.setdefault(w, len(self.number)) for w in ws]) for key, ws in items if ws]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self._mark(coded)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        twin = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = twin
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = twin
            p = link[p]
        return twin

    def _mark(self, coded: list[tuple[object, list[int]]]) -> None:
        """owners: by state, ids of the items that have the sequence of ``window`` words (or the whole short item)
        that the state stands for; found: by state, the window's state and the short items' states above it."""
        n, w = len(self.next), self.window
        self.owners: dict[int, set] = {}
        whole: dict[int, int] = {}
        above = self._window_states()
        for key, codes in coded:
            state, short = 0, len(codes) < w
            for i, c in enumerate(codes):
                state = self.next[state][c]
                if i + 1 >= w:
                    self.owners.setdefault(above[state], set()).add(key)
            if short:
                # the state whose longest sequence is the item itself: an item is a prefix, never inside a longer state only
                self.owners.setdefault(("short", state, len(codes)), set()).add(key)
                whole.setdefault(state, 0)
                whole[state] |= 1 << len(codes)
        self.above = above
        order = sorted(range(1, n), key=self.length.__getitem__)
        chain: list[tuple] = [()] * n
        for v in order:
            own = tuple(("short", v, k) for k in range(1, w) if whole.get(v, 0) >> k & 1)
            up = chain[self.link[v]] if self.link[v] > 0 else ()
            chain[v] = own[::-1] + up if own else up
        self.chain = chain

    def _window_states(self) -> list[int]:
        """For each state whose sequences have ``window`` words or more, the suffix-link ancestor (or itself)
        that holds the sequence's last ``window`` words; else 0."""
        out = [0] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if self.length[v] >= self.window:
                up = self.link[v]
                out[v] = out[up] if up > 0 and self.length[up] >= self.window else v
        return out

    def scan(self, codes: list[int]) -> tuple[list[tuple[int, int]], set]:
        """The hit spans of words (from, to), merged and in order, and the ids of the items found."""
        nxt, link, length, above, chain, window = self.next, self.link, self.length, self.above, self.chain, self.window
        spans: list[list[int]] = []
        seen: set = set()
        state = matched = 0
        for i, c in enumerate(codes):
            if c < 0:
                state = matched = 0
                continue
            step = nxt[state].get(c)
            if step is None:
                while state and step is None:
                    state = link[state]
                    step = nxt[state].get(c)
                if step is None:
                    state = matched = 0
                    continue
                matched = length[state] + 1
            else:
                matched += 1
            state = step
            low = -1
            if matched >= window:
                seen.add(above[state])
                low = i + 1 - window
            if chain[state]:
                for short in chain[state]:
                    if short[2] <= matched:
                        seen.add(short)
                        if low < 0 or i + 1 - short[2] < low:
                            low = i + 1 - short[2]
            if low >= 0:
                while spans and spans[-1][0] >= low:
                    spans.pop()
                if spans and spans[-1][1] >= low:
                    spans[-1][1] = i + 1
                else:
                    spans.append([low, i + 1])
        ids: set = set()
        for s in seen:
            ids |= self.owners.get(s, set())
        return [(a, b) for a, b in spans], ids


def blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items, a bounded number of words at a time; the driver never holds more than one block."""
    held: list[tuple[object, list[bytes]]] = []
    n = 0
    for key, text in benchmark.select("item_id", "text").toLocalIterator():
        ws = words(text)
        step = max(1, block_words - window + 1)
        for at in range(0, max(1, len(ws) - window + 1), step):
            piece = ws[at : at + block_words]
            held.append((key, piece))
            n += len(piece)
            if n >= block_words:
                yield held
                held, n = [], 0
    if held:
        yield held


def in_groups(rows: DataFrame, benchmark: DataFrame, window: int, block_words: int, step: Callable[[DataFrame, list], DataFrame], name: str) -> tuple[DataFrame, int]:
    """``step`` (rows, broadcast automata) for one group of blocks after another, and the number of groups. All but the last
    group's rows are written, so that only the last group's automata are still needed for what is returned."""
    context, found = rows.sparkSession.sparkContext, blocks(benchmark, window, block_words)
    group, old, n = list(islice(found, GROUP)), None, 0
    while group:
        following = list(islice(found, GROUP))
        shared = [context.broadcast(Automaton(b, window)) for b in group]
        rows, n = step(rows, shared), n + 1
        if following:
            made = Table(rows, name)
            for s in shared:
                s.destroy()
            if old is not None:
                old.drop()
            rows, old = made.df, made
        group = following
    return rows, n


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with n_words, hit_from and hit_to (arrays of word positions, spans merged) and items (ids as
    strings), in place of columns of these names. With more than GROUP blocks it runs when
    called, and the result reads a table in the shared folder."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_words", "hit_from", "hit_to", "items")])
    cols = docs.columns
    at = cols.index("text")
    kinds = extended(docs, "n_words long, hit_from array<int>, hit_to array<int>, items array<string>")
    none = docs.withColumns({"n_words": F.lit(None).cast("long"), "hit_from": F.array().cast("array<int>"), "hit_to": F.array().cast("array<int>"), "items": F.array().cast("array<string>")})
    out, n = in_groups(none, benchmark, window, block_words, lambda rows, shared: arrow_map(rows, _scanner(shared, at, len(cols)), kinds), "scanned")
    return out if n else arrow_map(none, _scanner([], at, len(cols)), kinds)


def _scanner(shared: list, at: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        autos = [s.value for s in shared]
        for b in slices(batches, at):
            count, lows, highs, found = [], [], [], []
            for text, low, high, items in zip(b.column(at).to_pylist(), *(b.column(n + k).to_pylist() for k in (1, 2, 3)), strict=True):
                ws, ids = words(text), set(items)
                spans = [*zip(low, high, strict=True)]
                for auto in autos:
                    number = auto.number.get
                    more, of = auto.scan([number(w, -1) for w in ws])
                    spans = merged([*spans, *more]) if spans else more
                    ids |= {str(x) for x in of if x is not None}
                count.append(len(ws))
                lows.append([a for a, _ in spans])
                highs.append([z for _, z in spans])
                found.append(sorted(ids))
            made = [pa.array(count, pa.int64()), pa.array(lows, pa.list_(pa.int32())), pa.array(highs, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *made], [*b.schema.names[:n], "n_words", "hit_from", "hit_to", "items"])

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def without_spans(text: str, low: list[int], high: list[int]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw, at, out, spans = text.encode(), 0, [], word_spans(text)
    for a, z in zip(low, high, strict=True):
        out.append(raw[at : spans[a][0]])
        at = spans[z - 1][1]
    out.append(raw[at:])
    return b"".join(out).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with the same columns: hit spans are cut from the texts, and documents that are hit in more than
    ``max_coverage`` of their words go. As a cut joins what stood apart, texts are scanned again until no block
    of the benchmark hits anything; clean documents come through unchanged, byte for byte."""
    names = docs.columns
    rest = F.struct(F.lit(1).alias("_"), *[F.col(f"`{c}`") for c in names if c != "text"])
    row = docs.select("text", rest.alias("_row"), F.lit(None).cast("long").alias("_words"), F.lit(0).cast("long").alias("_cut"), F.lit(False).alias("_touched"))
    kinds = extended(row, "")
    step = lambda rows, shared: arrow_map(rows, _cutter(shared), kinds)
    out, n = in_groups(row, benchmark, window, block_words, step, "cut")
    if not n:
        return docs
    gone = F.col("_cut") > max_coverage * F.coalesce("_words", F.lit(0))
    done = []
    while n > 1:  # a cut for a later group may join words that an earlier one has: texts that were cut pass all groups again
        whole = Table(out.filter(~gone), "cut").df
        done.append(whole.filter("NOT _touched"))
        if whole.filter("_touched").isEmpty():
            out = reduce(DataFrame.unionByName, done)
            break
        out, n = in_groups(whole.filter("_touched").withColumn("_touched", F.lit(False)), benchmark, window, block_words, step, "cut")
    return out.filter(~gone).select(*[F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in names])


def _cutter(shared: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        autos = [s.value for s in shared]
        for b in slices(batches, 0):
            texts, totals, cuts, touched = (b.column(k).to_pylist() for k in (0, 2, 3, 4))
            for i, text in enumerate(texts):
                ws, k, clear = words(text), 0, 0
                if totals[i] is None:
                    totals[i] = len(ws)
                while clear < len(autos):  # a cut for one block may join words that any other has
                    number = autos[k].number.get
                    spans = autos[k].scan([number(w, -1) for w in ws])[0]
                    if spans:
                        cuts[i] += sum(z - a for a, z in spans)
                        text = without_spans(text, [a for a, _ in spans], [z for _, z in spans])
                        ws, clear, touched[i] = words(text), 0, True
                    else:
                        k, clear = (k + 1) % len(autos), clear + 1
                texts[i] = text
            made = [pa.array(texts, b.schema.field(0).type), b.column(1), pa.array(totals, pa.int64()), pa.array(cuts, pa.int64()), pa.array(touched, pa.bool_())]
            yield pa.RecordBatch.from_arrays(made, b.schema.names)

    return run


# --- the registered query -------------------------------------------------

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document's words, those inside benchmark windows, and the items these come from."""
    hits = scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("hit_from", "hit_to", lambda a, z: z - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = r"""
WITH i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)
), d AS (
  SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), dw AS (
  SELECT r, m, k, array_to_string(w[k : k + m - 1], ' ') AS win
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)
), h AS (SELECT r, m, k, item_id FROM dw JOIN iw USING (m, win)
), p AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + m)) AS x FROM h) GROUP BY r
), t AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)
"""
