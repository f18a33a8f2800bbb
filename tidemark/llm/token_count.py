"""Token counts by a linear longest-match automaton.

A word piece tokenizer takes from each word, again and again, the longest piece
of the vocabulary. The automaton does so in one pass: a trie of the pieces whose
every node has a failure link, to the node for what is left after the longest
pieces are popped from the node's string, and the number of pieces popped on the
way. A word's count is the sum of those numbers; no piece is ever built (Song et
al., "Fast WordPiece Tokenization").

The vocabulary's pieces that begin with the word mark begin words, the others go
on with them. A word that can't be cut into pieces counts as one unknown token.
Words are runs of anything but white space.

Defined results: null text counts as empty; very long texts are counted whole; texts without words have no tokens;
repeated rows are counted apart; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices, table

MARK = "▁"
#: Words remembered by a Python worker.
REMEMBER = 500_000
SHORT = 64


class Counter(dict):
    """As a mapping: from words to their number of tokens, below 0 if unknown; made when asked for."""

    def __init__(self, pieces: Iterable[str]) -> None:
        super().__init__()
        self.next: list[dict[str, int]] = [{}, {}]  # 0: the start, 1: within a word
        ends: set[int] = set()
        for piece in pieces:
            first = piece.startswith(MARK)
            at = 0 if first else 1
            for c in piece[1:] if first else piece:
                step = self.next[at].get(c)
                if step is None:
                    step = self.next[at][c] = len(self.next)
                    self.next.append({})
                at = step
            if at > 1:
                ends.add(at)
        n = len(self.next)
        self.fail, self.popped = [-1] * n, [0] * n
        queue = [(c, v, at) for at in (0, 1) for c, v in self.next[at].items()]
        for c, v, u in queue:  # grows: breadth first
            if v in ends:
                self.fail[v], self.popped[v] = 1, 1
            else:
                z, k = self.fail[u], self.popped[u]
                while z >= 0 and c not in self.next[z]:
                    k += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.next[z][c], k
            queue.extend((d, w, v) for d, w in self.next[v].items())

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        if len(word) <= SHORT:
            if len(self) >= REMEMBER:
                self.clear()
            self[word] = n
        return n

    def count(self, word: str) -> int:
        nxt, fail, popped = self.next, self.fail, self.popped
        at = n = 0
        for c in word:
            step = nxt[at].get(c)
            while step is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return -1
                step = nxt[at].get(c)
            at = step
        while at > 1:
            n += popped[at]
            at = fail[at]
        return n if at == 1 else -1


def load_pieces(path: str) -> list[str]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


def default_vocabulary() -> str:
    import public_tokenizers as p

    return p.path("piece_bpe_32k.model")


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One automaton for each vocabulary and Python process."""
    if path not in _counters:
        _counters[path] = Counter(load_pieces(path))
    return _counters[path]


def count_tokens(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown of every row; no shuffle. The vocabulary file must be on every executor."""
    use = path or default_vocabulary()
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(use).__getitem__
        for b in slices(batches, 1):
            words, tokens, unknown = [], [], []
            for t in b.column(1).to_pylist():
                counts = list(map(of, (t or "").split()))
                none = counts.count(-1)
                words.append(len(counts))
                unknown.append(none)
                tokens.append(sum(counts) + 2 * none)
            cols = [b.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return arrow_map(docs.select("doc_id", F.col(text)), run, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")


# --- the registered query -------------------------------------------------


def op8_token_count(spark, sf_dir: str) -> DataFrame:
    """Every document's word pieces, counted."""
    return count_tokens(table(spark, sf_dir, "documents"))
