"""Language ID by unigram language models over a fixed public vocabulary.

Each language has a probability for every piece of a fixed vocabulary. A word
has the probability of all its segmentations into pieces together, which a
forward algorithm sums in one pass: f[j] = sum over pieces that end at j of
f[start] * p(piece). A text's score in a language is the sum of its words' log
probabilities; the posterior over the learned languages (equal priors) gives the
prediction and its score.

Learning is expectation maximisation on the word counts of a sample of labelled
rows, bounded by ``rows_per_lang``: each iteration sums expected piece counts
over all segmentations (forward and backward). The sample keeps the rows whose
id hashes lowest, so it doesn't depend on the order or number of files.

Defined results: the prediction is ``und`` with score 0 where text is null or has
no letter, or where there was nothing to learn from; rows with a null lang are
not learned from; lang, source and doc_id play no part in predicting; of equal
scores the language that sorts first wins; very long texts and words are scored
whole, with scaling. Repeated rows are judged apart; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import exp, log
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, arrow_map, extended, held, slices, table, whole_row

#: Labelled rows that a language is learned from, about.
ROWS_PER_LANG = 300
ITERATIONS = 3
#: Words remembered by a Python worker.
REMEMBER = 300_000
#: Probability of a character that no piece covers, and what is added to every expected count.
UNKNOWN = 1e-7
SMOOTH = 0.05

#: Words of up to so many letters are remembered.
SHORT = 48

LETTER = regex.compile(r"\p{L}")
find_words = regex.compile(r"\p{L}+").findall
MARK = "▁"  # begins a word in the vocabulary


def load_pieces(path: str) -> list[str]:
    """The vocabulary's ordinary pieces, lower-cased and distinct."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return sorted({p.lower() for p in kept if LETTER.search(p)})


def default_vocabulary() -> str:
    import public_tokenizers as p

    return p.path("piece_bpe_32k.model")


class Model:
    """Piece probabilities of all languages: piece -> one probability for each language."""

    def __init__(self, langs: list[str], pieces: dict[str, tuple[float, ...]]) -> None:
        self.langs, self.pieces = langs, pieces
        self.longest = max(map(len, pieces), default=1)
        self.rows: dict[str, int] = {}  # remembered words, and their rows in the table
        self.table = np.empty((REMEMBER, len(langs)))
        self.unknown = (UNKNOWN,) * len(langs)
        self.prefixes: dict[str, tuple[float, ...]] = {p[:k]: () for p in pieces for k in range(1, len(p))}
        self.prefixes.update(pieces)

    def word(self, word: str) -> tuple[float, ...]:
        """Log probability of the word in each language, over all segmentations."""
        return self._arcs(MARK + word) if len(word) <= SHORT else self._forward(MARK + word)

    def _arcs(self, w: str) -> tuple[float, ...]:
        """The forward sums of a short word: its pieces are found once, by walking the vocabulary's prefixes from each
        position, and summed for one language after another. Where these sums underflow, they are taken with scaling."""
        n, get, arcs = len(w), self.prefixes.get, []
        for i in range(n):
            one = False
            for j in range(i + 1, n + 1):
                p = get(w[i:j])
                if p is None:
                    break
                if p:
                    arcs.append((i, j, p))
                    one = one or j == i + 1
            if not one:
                arcs.append((i, i + 1, self.unknown))
        out, zeros = [], [0.0] * n
        for a in range(len(self.langs)):
            f = [1.0, *zeros]
            for i, j, p in arcs:
                f[j] += f[i] * p[a]
            if f[n] < 1e-290:
                return self._forward(w)
            out.append(log(f[n]))
        return tuple(out)

    def _forward(self, w: str) -> tuple[float, ...]:
        n, longest, get = len(w), self.longest, self.pieces.get
        k = len(self.langs)
        zero = (0.0,) * k
        sums = [list(zero) for _ in range(min(n, longest) + 1)]  # a ring: f at the last positions
        ring = len(sums)
        sums[0] = [1.0] * k
        shift = 0.0
        for i in range(n):
            here = sums[i % ring]
            top = max(here)
            if not 1e-200 < top < 1e200:
                shift += log(top)
                for s in sums:
                    s[:] = [x / top for x in s]
            one = get(w[i])
            after = sums[(i + 1) % ring]
            if one is None:
                for a in range(k):
                    after[a] += here[a] * UNKNOWN
            else:
                for a in range(k):
                    after[a] += here[a] * one[a]
            for j in range(i + 2, min(n, i + longest) + 1):
                p = get(w[i:j])
                if p is not None:
                    into = sums[j % ring]
                    for a in range(k):
                        into[a] += here[a] * p[a]
            sums[i % ring] = list(zero)
        return tuple(log(x) + shift if x > 0 else shift - 700.0 for x in sums[n % ring])

    def scores(self, text: str) -> np.ndarray | None:
        """Each language's log probability, or None where there is no letter."""
        counts = Counter(find_words(text.lower()))
        if not counts or not self.langs:
            return None
        rows, table, total = self.rows, self.table, np.zeros(len(self.langs))
        if len(rows) + len(counts) > REMEMBER:
            rows.clear()  # the common ones are soon back
        at, times = [], []
        for w, n in counts.items():
            row = rows.get(w)
            if row is None:
                row = len(rows)
                if len(w) > SHORT or row >= REMEMBER:
                    total += n * np.array(self.word(w))
                    continue
                table[row] = self.word(w)
                rows[w] = row
            at.append(row)
            times.append(n)
        return total + np.array(times, float) @ table[at] if at else total

    def predict(self, text: str | None) -> tuple[str, float]:
        total = self.scores(text) if text else None
        if total is None:
            return "und", 0.0
        best = int(np.argmax(total))
        return self.langs[best], float(1.0 / np.exp(np.maximum(total - total[best], -745.0)).sum())


def expected_counts(word: str, n: int, probs: dict[str, float], longest: int, into: dict[str, float]) -> None:
    """Adds each piece's expected number in ``n`` copies of the word, over all segmentations."""
    if len(word) > SHORT:
        return long_counts(word, n, probs, longest, into)
    w = MARK + word
    size = len(w)
    arcs, f = [], [0.0] * (size + 1)
    f[0] = 1.0
    for i in range(size):
        if f[i] == 0.0:
            continue
        for j in range(i + 1, min(size, i + longest) + 1):
            p = probs.get(w[i:j], 0.0) or (UNKNOWN if j == i + 1 else 0.0)
            if p:
                f[j] += f[i] * p
                arcs.append((i, j, p))
    if f[size] <= 0.0:
        return
    back = [0.0] * (size + 1)
    back[size] = n / f[size]
    for i, j, p in reversed(arcs):
        mass = p * back[j]
        back[i] += mass
        piece = w[i:j]
        into[piece] = into.get(piece, 0.0) + f[i] * mass


def long_counts(word: str, n: int, probs: dict[str, float], longest: int, into: dict[str, float]) -> None:
    """The same for a word of any length, with logarithms of the forward sums; instead of the backward sums it keeps
    the expected number of pieces that begin at each position, which don't underflow either."""
    w = MARK + word
    size = len(w)

    def ending(j: int) -> list[tuple[int, float]]:
        found = [(i, probs.get(w[i:j], 0.0) or (UNKNOWN if j == i + 1 else 0.0)) for i in range(max(0, j - longest), j)]
        return [(i, p) for i, p in found if p]

    f = [0.0] * (size + 1)
    for j in range(1, size + 1):
        arcs = ending(j)
        top = max(f[i] for i, _ in arcs)
        f[j] = top + log(sum(exp(f[i] - top) * p for i, p in arcs))
    begin = [0.0] * size + [float(n)]
    for j in range(size, 0, -1):
        for i, p in ending(j):
            mass = begin[j] * exp(f[i] - f[j]) * p
            begin[i] += mass
            piece = w[i:j]
            into[piece] = into.get(piece, 0.0) + mass


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1):
        counts: dict[str, Counter] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(find_words((text or "").lower()))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])


def _expect(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, probs, longest = shared.value
        sums: dict[str, dict[str, float]] = {}
        for b in slices(batches, 1):
            for lang, w, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                expected_counts(w, n, probs.get(lang, pieces), longest, sums.setdefault(lang, {}))
        rows = [(lang, p, n) for lang, s in sums.items() for p, n in s.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], ["lang", "piece", "n"])

    return run


def learn(labelled: DataFrame, path: str | None = None, rows_per_lang: int = ROWS_PER_LANG, iterations: int = ITERATIONS) -> Model:
    """Learns from (doc_id, lang, text). What reaches the driver is a count for each language and piece of the
    vocabulary; the texts of the sample stay on the executors."""
    spark = labelled.sparkSession
    pieces = load_pieces(path or default_vocabulary())
    labelled = labelled.filter("lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], {})
    scale = 1 << 30
    share = F.element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(scale, scale * rows_per_lang // sizes[lang]))]), F.col("lang"))
    sample = labelled.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(scale)) < share)
    words = Table(arrow_map(sample.select("lang", "text"), _count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    known, longest = set(pieces), max(map(len, pieces))
    probs: dict[str, dict[str, float]] = {}
    start = {p: 1.0 / len(pieces) for p in pieces}
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast((start, probs, longest))  # languages times the vocabulary
        rows = arrow_map(words.df.select("lang", "word", "n"), _expect(shared), "lang string, piece string, n double")
        got = rows.groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        sums: dict[str, dict[str, float]] = {lang: {} for lang in langs}
        for lang, p, n in got:
            if p in known:
                sums[lang][p] = n
        probs = {}
        for lang, s in sums.items():
            total = sum(s.values()) + SMOOTH * len(pieces)
            probs[lang] = {p: (s.get(p, 0.0) + SMOOTH) / total for p in pieces}
        shared.unpersist()
    words.drop()
    return Model(langs, {p: tuple(probs[lang][p] for lang in langs) for p in pieces})


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, in place of columns of these names; no shuffle. The model has one number for each language and piece. ``text`` may
    be a field of a struct, as in ``row.text``."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")])
    first, *inner = text.split(".")
    at, names = docs.columns.index(first), docs.columns
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.pieces))
    kinds, tag = extended(docs, "lang_pred string, score double"), uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held(("lang", tag), lambda: Model(*shared.value))
        for b in slices(batches, at):
            texts = b.column(at)
            for f in inner:
                texts = pc.struct_field(texts, f)
            got = [m.predict(t) for t in texts.to_pylist()]
            cols = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*names, "lang_pred", "score"])

    return arrow_map(docs, run, kinds)


# --- the registered query -------------------------------------------------


def held_out(doc_id: str = "doc_id"):
    """Rows that nothing is learned from: one of five by the checksum of the id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(docs: DataFrame, **limits) -> Model:
    return learn(docs.filter(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text"), **limits)


def known_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose language can't be told: those without letters, and those whose best
    language has a score below ``least``."""
    row = docs.select(whole_row(docs).alias("_row"))
    return identify(row, trained(docs), "_row.text").filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("_row.*")


def op6_lang_id(spark, sf_dir: str) -> DataFrame:
    """Every document's language, learned from four fifths of the rows."""
    docs = table(spark, sf_dir, "documents")
    model = trained(docs)
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
