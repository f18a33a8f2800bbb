"""Secret scans by a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived:
literals, small classes and alternatives give the strings that every match must
hold, and their trigrams must all be in the text. The index lists the distinct
trigrams of each text, in lower case, by one walk over it whatever the number of
rules, and keeps a posting (the trigram and the document) for those that its
rules ask for. A rule's candidates are the documents in the intersection of a
clause's postings; its expression runs on them alone. Rules from which no trigram
follows run on every document. An index can be kept (``Index``): rules that ask
for trigrams it has read postings only, others add what it lacks.

Built-in SQL functions alone: no Python runs on the executors; the expressions
are parsed on the driver.

Defined results: null text counts as empty and has no spans; very long texts are
listed in pieces of bounded size; spans of one place are ordered by their rule;
rows of equal id and text get equal results; null ids are kept; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re._parser as parser
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import Table, table

#: Strings of an alternative, or characters of a class, that are still written out.
MOST_STRINGS = 64
MOST_CHARS = 8
#: Characters of a text whose trigrams are listed at once.
PIECE = 4096
#: Candidate documents whose keys are broadcast; with more, texts are shuffled to them.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Rule:
    """``value``, if given, is a pattern whose first group in a match must have ``least`` characters."""

    kind: str
    pattern: str
    value: str | None = None
    least: int = 0


_ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*+[:=]\x20*+["']?"""
BASE = (
    Rule("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]++", "^" + _ASSIGN + "([A-Za-z0-9+/_.=-]++)", 12),
    Rule("access", "AKIA[A-Z0-9]{14,}+"),
    Rule("hex", "[0-9a-f]{16,}+"),
)
MORE = (
    Rule("private", "-----BEGIN (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----"),
    Rule("code_host", "gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"),
)


# --- from an expression to a query ----------------------------------------
# A query is a set of clauses, each a set of trigrams: some clause must hold with all its trigrams. None: no restriction.

Query = frozenset | None


def _of_strings(strings: Iterable[str]) -> Query:
    clauses = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return None if frozenset() in clauses else frozenset(clauses)


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return frozenset(x | y for x in a for y in b) if len(a) * len(b) <= MOST_STRINGS else a


def _either(qs: list[Query]) -> Query:
    return None if any(q is None for q in qs) else frozenset().union(*qs)


def _chars(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is parser.LITERAL:
            out.add(chr(arg).lower())
        elif op is parser.RANGE and arg[1] - arg[0] < 2 * MOST_CHARS:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_CHARS else None


def _walk(items) -> tuple[set[str] | None, Query]:
    """The strings that the sequence stands for, in lower case, if they are few; and its query."""
    run: set[str] = {""}
    query: Query = None
    whole = True
    for op, arg in items:
        strings: set[str] | None = None
        sub: Query = None
        if op is parser.LITERAL:
            strings = {chr(arg).lower()}
        elif op is parser.IN:
            strings = _chars(arg)
        elif op is parser.AT:
            strings = {""}
        elif op is parser.SUBPATTERN:
            strings, sub = _walk(arg[3])
        elif op is parser.BRANCH:
            parts = [_walk(p) for p in arg[1]]
            if all(p[0] is not None for p in parts):
                strings = set().union(*(p[0] for p in parts))
            sub = _either([p[1] if p[0] is None else _of_strings(p[0]) for p in parts])
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT, parser.POSSESSIVE_REPEAT):
            low, high, inner = arg
            held, sub = _walk(inner)
            if held is not None and high != parser.MAXREPEAT and len(held) ** int(high) <= MOST_STRINGS and int(high) <= 4:
                strings = {"".join(p) for k in range(int(low), int(high) + 1) for p in product(held, repeat=k)}
            if not low:
                sub = None
            elif held is not None and strings is None:
                sub = _of_strings(held)
        elif op is parser.ATOMIC_GROUP:
            strings, sub = _walk(arg)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
        else:
            query = _both(_both(query, _of_strings(run)), sub if strings is None else _of_strings(strings))
            run, whole = {""}, False
    return (run, _of_strings(run)) if whole else (None, _both(query, _of_strings(run)))


def trigram_query(pattern: str) -> Query:
    """The trigrams, in lower case, that every text with a match must hold; None if there are none."""
    strings, query = _walk(parser.parse(pattern))
    query = _of_strings(strings) if strings is not None else query
    return None if query is None else frozenset(c for c in query if not any(o < c for o in query))  # a < b: b is implied


# --- the index --------------------------------------------------------------


def trigrams_of(text: Column, wanted: list[str]) -> Column:
    """The distinct trigrams of the text, in lower case, that are among ``wanted``. Pieces overlap by two characters."""
    pieces = F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{1,{PIECE + 2}}})).{{1,{PIECE}}}"), F.lit(1))
    asked = F.array(*map(F.lit, wanted)).cast("array<string>")
    held = F.transform(pieces, lambda p: F.array_intersect(F.regexp_extract_all(p, F.lit("(?s)(?=(...))"), F.lit(1)), asked))
    return F.array_distinct(F.flatten(held))


def build_index(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id, _key) of the given trigrams over ``rows`` (doc_id, _key, text)."""
    return rows.select("doc_id", "_key", F.explode(trigrams_of(F.col("text"), trigrams)).alias("trigram"))


class Index:
    """Postings of a frame of documents (doc_id, text) in the shared folder, for any rules."""

    def __init__(self, docs: DataFrame) -> None:
        self.rows = S.keyed(docs)
        self.known: set[str] = set()
        self.tables: list[Table] = []

    def postings(self, trigrams: set[str]) -> DataFrame:
        """The postings of ``trigrams``. Reads the texts only where some of them aren't listed yet."""
        new = sorted(trigrams - self.known)
        if new:
            self.tables.append(Table(build_index(self.rows, new), "trigrams"))
            self.known |= trigrams
        every = self.rows.sparkSession.read.parquet(*[t.path for t in self.tables])
        return every.filter(F.col("trigram").isin(sorted(trigrams)))

    def drop(self) -> None:
        for t in self.tables:
            t.drop()
        self.tables, self.known = [], set()


def candidates(index: DataFrame, queries: dict[int, frozenset]) -> DataFrame:
    """doc_id, _key and rules (bits of the rule numbers) of the documents that meet some rule's query."""
    clauses = [(r, c) for r, q in queries.items() for c in sorted(map(sorted, q))]
    rows = [(t, i) for i, (_, c) in enumerate(clauses) for t in c]
    wanted = F.broadcast(index.sparkSession.createDataFrame(rows, "trigram string, clause int"))  # as many rows as the rules have trigrams
    met = index.distinct().join(wanted, "trigram").groupBy("doc_id", "_key", "clause").agg(F.count(F.lit(1)).alias("n"))
    bit, size = F.lit(None).cast("long"), F.lit(None).cast("long")
    for i, (r, c) in enumerate(clauses):
        bit = F.when(F.col("clause") == i, F.lit(1 << r)).otherwise(bit)
        size = F.when(F.col("clause") == i, F.lit(len(c))).otherwise(size)
    return met.filter(F.col("n") == size).groupBy("doc_id", "_key").agg(F.bit_or(bit).alias("rules"))


def scan(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE, index: Index | None = None) -> tuple[DataFrame, list[Table]]:
    """doc_id, text (null: empty), base and spans (all rules') of every row; and the tables in the shared folder to
    drop after use. An ``index`` of the same documents is used and kept; without one, postings are made and dropped."""
    rows = S.keyed(docs)
    rules = (*base, *more)
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    tables: list[Table] = []
    if queries:
        held = index or Index(docs)
        tables.append(Table(candidates(held.postings({t for q in queries.values() for c in q for t in c}), queries), "candidates"))
        if index is None:
            held.drop()
        met = tables[0].df
        few = met.count() <= BROADCAST_ROWS
        rows = rows.join(F.broadcast(met) if few else met, S.same_row(rows, met), "left").select(*[rows[c] for c in rows.columns], met["rules"])
    else:
        rows = rows.withColumn("rules", F.lit(0).cast("long"))

    def found(i: int, r: Rule) -> Column:
        gate = F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0 if i in queries else None
        out = S.matches(F.col("text"), r.pattern, r.kind, gate)
        if r.value is None:
            return out
        return F.filter(out, lambda s: F.length(F.regexp_extract(s["text"], r.value, 1)) >= r.least)

    kinds = [r.kind for r in rules]
    out = rows.withColumn("base", F.concat(*[found(i, r) for i, r in enumerate(rules[: len(base)])]))
    out = out.withColumn("spans", F.concat(F.col("base"), *[found(len(base) + i, r) for i, r in enumerate(more)]))
    out = out.withColumn("base", S.ordered(F.col("base"), kinds, False)).withColumn("spans", S.ordered(F.col("spans"), kinds, False))
    return out.drop("_key", "rules"), tables


# --- the registered query -------------------------------------------------


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    """Every document's secrets."""
    found, _ = scan(table(spark, sf_dir, "documents"))
    base = F.col("base")
    return found.select("doc_id", *[S.count(base, r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(S.written(base), 256).alias("base_sha256"), S.written(F.col("spans")).alias("spans"))


def _oracle() -> str:
    from . import span_sql as Q

    key = "(?i:password|passwd|secret|token|api_?key)"
    head = key + r"""["']?\x20*[:=]\x20*["']?"""
    value = "[A-Za-z0-9+/_.=-]+"
    quoted = head.replace("'", "''")
    plain = {
        "assign": (head + value, f"length(regexp_extract(m, '^{quoted}({value})$', 1)) >= 12"),
        "access": ("AKIA[A-Z0-9]+", "length(m) >= 18"),
        "hex": ("[0-9a-f]{16,}", "true"),
        "private": ("-----BEGIN (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----", "true"),
        "code_host": ("gh[pousr]_[A-Za-z0-9]{36,}", "true"),
        "chat": ("xox[abprs]-[A-Za-z0-9-]{10,}", "true"),
        "jwt": (r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "true"),
    }
    kinds = list(plain)
    order = f"s, {Q.place(kinds)}"
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    every = " UNION ALL ".join(f"SELECT * FROM f_{k}" for k in kinds)
    sums = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    counts = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)
    return (
        f"WITH {Q.DOCS},\n"
        + ",\n".join(Q.found(f"f_{k}", k, p, where) for k, (p, where) in plain.items())
        + f",\na AS ({every}),\ng AS (SELECT r, {sums}, {Q.joined(order)} FILTER (WHERE kind IN ({base})) AS b, {Q.joined(order)} AS spans FROM a GROUP BY r)\n"
        + f"SELECT doc_id, {counts}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"
    )


ORACLE = _oracle()
