"""Spans of regular expressions in text columns, on built-in SQL functions alone.

Spark has no function that returns match positions. ``split`` gives what stands
between the matches of a pattern and ``regexp_extract_all`` the matches; both
walk the text in the same way, so the running sum of their lengths (in code
points) gives each match's start and end. Patterns must not match the empty
string. Patterns here use possessive repeats, which Java runs without recursion
or backtracking.

Very long texts and many matches take time in proportion: running values are
taken in blocks, and over blocks of blocks, so that no growing array is ever
copied beyond a block; pieces of a text are taken from cuts of bounded size,
never by counting characters from its beginning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A span: code points from start up to end, the kind and the matched text.
SPAN = "array<struct<start:int,end:int,kind:string,text:string>>"
#: Elements of a block in running values, and characters of a text's cut.
BLOCK, CUT = 64, 256
#: How many times blocks are taken before the rest, a BLOCK**LEVELS-th of the array, is walked as one.
LEVELS = 3


def empty() -> Column:
    return F.array().cast(SPAN)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body or a function within it uses it."""
    return F.transform(F.array(value), body)[0]


def _before(xs: Column, zero: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each element what all before it give, joined one after another; the array is copied at each step."""
    start = F.struct(zero.alias("at"), F.slice(F.array(zero), 1, 0).alias("out"))
    return F.aggregate(xs, start, lambda a, x: F.struct(join(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])


def before(xs: Column, zero: Column, join: Callable[[Column, Column], Column], levels: int = LEVELS) -> Column:
    """For each element of ``xs`` the ``join`` of ``zero`` and all elements before it (an associative function)."""
    if not levels:
        return _before(xs, zero, join)

    def blocks(xs: Column) -> Column:
        n = F.floor((F.size(xs) + BLOCK - 1) / BLOCK).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: F.slice(xs, k * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.slice(F.array(xs), 1, 0))

    def inner(bs: Column) -> Column:
        totals = F.transform(bs, lambda b: F.aggregate(b, zero, join))
        return F.flatten(F.zip_with(bs, before(totals, zero, join, levels - 1), lambda b, o: F.transform(_before(b, zero, join), lambda x: join(o, x))))

    return let(xs, lambda xs: F.when(F.size(xs) <= BLOCK, _before(xs, zero, join)).otherwise(let(blocks(xs), inner)))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def matches(text: Column, pattern: str, kind: str, gate: Column | None = None) -> Column:
    """All matches of ``pattern``, leftmost first and not overlapping, as spans. ``gate`` is a cheaper condition
    that every text with a match that counts must meet."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))

    def spans(both: Column) -> Column:
        sizes = F.transform(both, lambda x: x["g"] + F.coalesce(F.length(x["m"]), F.lit(0)))

        def one(x: Column, at: Column) -> Column:
            start = at + x["g"]
            return F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), F.lit(kind).alias("kind"), x["m"].alias("text"))

        return F.filter(F.zip_with(both, before(sizes, F.lit(0), _sum), one), lambda s: s["text"].isNotNull())

    return F.when(F.regexp_like(text, F.lit(pattern)) if gate is None else gate, let(both, spans)).otherwise(empty())


def keyed(docs, *also: str):
    """doc_id, text (null: empty), the columns ``also``, and ``_key``, which tells apart rows of equal or null id by their text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), *also).withColumn("_key", F.xxhash64("doc_id", "text"))


def same_row(a, b) -> Column:
    return (a["_key"] == b["_key"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def ordered(spans: Column, kinds: list[str], by_kind_first: bool) -> Column:
    """Sorted by (kind's place, start), or by (start, kind's place)."""
    place = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i)])
    keyed = F.transform(spans, lambda s: F.struct(*((place[s["kind"]].alias("p"), s["start"].alias("q")) if by_kind_first else (s["start"].alias("p"), place[s["kind"]].alias("q"))), s["end"].alias("e"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def clear_of(spans: Column, base: Column) -> Column:
    """The ``spans`` that overlap none of ``base``. Spans of one kind don't overlap each other, and none is empty."""
    mark = lambda xs, own: F.transform(xs, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s.alias("s")))
    every = F.array_sort(F.concat(mark(base, 0), mark(spans, 1)))

    def judged(every: Column) -> Column:
        ends = before(F.transform(every, lambda x: F.when(x["own"] == 0, x["end"]).otherwise(0)), F.lit(0), _most)
        last = F.lit(2**31 - 1)
        starts = F.reverse(before(F.reverse(F.transform(every, lambda x: F.when(x["own"] == 0, x["start"]).otherwise(last))), last, _least))
        met = F.arrays_zip(every.alias("x"), ends.alias("ends"), starts.alias("starts"))
        kept = F.filter(met, lambda m: (m["x"]["own"] == 1) & (m["ends"] <= m["x"]["start"]) & (m["starts"] >= m["x"]["end"]))
        return F.transform(kept, lambda m: m["x"]["s"])

    return F.when((F.size(spans) > 0) & (F.size(base) > 0), let(every, judged)).otherwise(spans)


def replaced(text: Column, spans: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by its kind in brackets."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def piece(cuts: Column, low: Column, high: Column) -> Column:
        """The characters from low up to high."""
        first = F.floor(low / CUT).cast("int")
        some = F.slice(cuts, first + 1, F.floor((high - 1) / CUT).cast("int") - first + 1)
        return F.when(high > low, F.substring(F.array_join(some, ""), low - first * CUT + 1, high - low)).otherwise("")

    def joined(v: Column) -> Column:
        cuts, ss, total = v["cuts"], v["ss"], v["total"]
        at = before(F.transform(ss, lambda s: s["end"]), F.lit(0), _most)
        fresh = F.filter(F.arrays_zip(ss.alias("s"), at.alias("at")), lambda x: x["s"]["start"] >= x["at"])
        parts = F.transform(fresh, lambda x: F.concat(piece(cuts, x["at"], x["s"]["start"]), F.lit("["), F.upper(x["s"]["kind"]), F.lit("]")))
        end = F.array_max(F.transform(ss, lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), piece(cuts, end, F.greatest(end, total)))

    held = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)).alias("cuts"), by_start.alias("ss"), F.length(text).alias("total"))
    return F.when(F.size(spans) > 0, let(held, joined)).otherwise(text)
