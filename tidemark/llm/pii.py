"""Personal data: base patterns, and terms that give away who is meant.

The base finds addresses and numbers by pattern. The terms follow from the
corpus: a protected entity is a found string (in lower case); a term is a run of
letters (in lower case), of any length and anywhere in a text that holds the
entity. Over all distinct texts the term reveals the entity with probability
P(e|t) = texts with both / texts with the term, against P(e) without it. A term
is disclosing for an entity if both are together in at least ``contexts`` unlike
texts, P(e|t) is at least ``share`` and log2(P(e|t) / P(e)) at least ``bits``.
Disclosing terms are generalised (kind ``term``), or removed (kind ``drop``)
where P(e|t) is ``remove`` or more, in every document that they occur in.

Texts that are near copies of each other are one context, however many there
are, as what they share says nothing about an entity: texts with recurring
entities that agree in one of four pairs of minima over their three-word shingles
(SHA-256) hang together, and contexts are counted by what hangs together. So a
signature in many different texts counts, and a text that was copied with small
changes doesn't.

Built-in SQL functions alone: no Python runs on the executors. Before terms are
paired with entities those drop out that can't be disclosing: entities in fewer
contexts, or in so many texts that no term can add ``bits``; terms in fewer
contexts, or in more texts with entities than P(e|t) allows. What is paired in
one text is the entities and rare terms that are left in it.

Defined results: null text counts as empty and has no spans; very long texts take
time in proportion; equal texts get equal results and count once; terms that
overlap a base span aren't listed; null ids are kept; other columns are ignored
(or pass through, in ``sanitise``); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import Table, table, whole_row
from .components import connected_components

# The kinds, in the order in which they are listed.
BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "term", "drop"]

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]|)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
CARD_GATE = r"[0-9](?:[\x20-]?[0-9]){12}"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}++"
WORD = r"[\p{L}\p{N}]++"

#: Keys of texts, or terms, that are broadcast; with more, rows are shuffled to them.
BROADCAST_ROWS = 500_000
#: Words of a shingle, pairs of minima, and hex digits of a minimum: all from one SHA-256.
SHINGLE, PAIRS, DIGITS = 3, 4, 8


@dataclass(frozen=True)
class Limits:
    contexts: int = 3  # unlike texts that hold an entity and a term
    share: float = 0.5
    bits: float = 3.0
    remove: float = 0.9


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]++", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def _card(s: Column) -> Column:
    d = _digits(s["text"])
    return F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False)


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, each kind's in order."""
    email = S.matches(text, EMAIL, "email", F.contains(text, F.lit("@")))
    ip = F.filter(S.matches(text, IP, "ip"), lambda s: F.regexp_like(s["text"], F.lit(rf"^(?:{PART}\.){{3}}{PART}$")))
    card = F.filter(S.matches(text, CARD, "card", F.regexp_like(text, F.lit(CARD_GATE))), _card)
    phone = F.filter(S.matches(text, PHONE, "phone", F.contains(text, F.lit("+"))), lambda s: F.length(_digits(s["text"])).between(9, 15))
    return F.concat(email, ip, card, phone)


def _terms(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0)))


def copy_keys(text: Column) -> Column:
    """Pairs of minima over the text's shingles; near copies have some pair in common."""
    names = [f"m{i}" for i in range(2 * PAIRS)]

    def least(ws: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            shingle = F.sha2(F.array_join(F.slice(ws, i, F.lit(SHINGLE)), " "), 256)
            return S.let(shingle, lambda h: F.struct(*[F.least(acc[m], F.substring(h, DIGITS * k + 1, DIGITS)).alias(m) for k, m in enumerate(names)]))

        zero = F.struct(*[F.lit("g").alias(m) for m in names])
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(ws) - SHINGLE + 1, F.lit(1))), zero, step)

    pairs = lambda m: F.array(*[F.concat(F.lit(f"{k}:"), m[names[2 * k]], m[names[2 * k + 1]]) for k in range(PAIRS)])
    return S.let(S.let(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), least), pairs)


def _few(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it was counted to be small; read from a table, so that counting it is cheap."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _families(held: DataFrame, tables: list[Table]) -> DataFrame:
    """node and family of the texts in ``held`` (node, keys): those that hang together by their keys."""
    members = held.select("node", F.explode("keys").alias("key"))
    first = members.groupBy("key").agg(F.min("node").alias("v"))
    labels = connected_components(members.join(first, "key").select(F.col("node").alias("u"), "v"), tables)
    joined = held.select("node").join(labels, "node", "left")
    return joined.select("node", F.coalesce("label", "node").alias("family"))


def disclosing_terms(rows: DataFrame, limits: Limits, tables: list[Table]) -> tuple[DataFrame, DataFrame] | None:
    """``rows`` has text, base and _text (which tells texts apart). Returns the disclosing terms (term, kind) and, for
    the terms that were looked at, the texts they occur in (_text, term); None where no term can be disclosing."""

    def written(df: DataFrame, name: str) -> DataFrame:
        tables.append(Table(df, f"pii-{name}"))
        return tables[-1].df

    c, one = F.col, F.count(F.lit(1))
    entities = F.array_distinct(F.transform("base", lambda s: F.lower(s["text"]))).alias("entities")
    held = written(rows.filter(F.size("base") > 0).select("_text", entities, copy_keys(c("text")).alias("keys")).dropDuplicates(["_text"]).withColumn("node", F.monotonically_increasing_id()), "held")
    named = held.select("node", F.explode("entities").alias("entity"))
    recurring = named.groupBy("entity").agg(one.alias("k")).filter(c("k") >= limits.contexts)
    mentions = written(named.join(recurring, "entity"), "mentions")
    if mentions.isEmpty():
        return None
    n = rows.select("_text").distinct().count()
    family = written(_families(held.join(mentions.select("node").distinct(), "node", "left_semi"), tables), "families")
    kept = mentions.join(family, "node").groupBy("entity").agg(F.countDistinct("family").alias("contexts"), F.max("k").alias("k"))
    kept = kept.filter((c("contexts") >= limits.contexts) & (F.log2(F.lit(n) / c("k")) >= limits.bits)).select("entity")
    mentions = written(mentions.join(kept, "entity", "left_semi").join(family, "node"), "kept")
    most = mentions.agg(F.max("k")).first()[0]
    if most is None:
        return None
    texts = written(held.select("node", "_text").join(mentions.select("node", "family").distinct(), "node"), "texts")
    near = written(rows.join(_few(texts), "_text").select("node", "family", F.explode(_terms(c("text"))).alias("term")).distinct(), "near")
    # a term beside some entity in m texts is in m at least: with m above k / share, P(e|t) is below share
    rare = near.groupBy("term").agg(one.alias("m"), F.countDistinct("family").alias("f")).filter((c("f") >= limits.contexts) & (c("m") * limits.share <= most)).select("term", "m")
    met = near.join(_few(written(rare, "rare")), "term").join(mentions.select("node", "entity", "k"), "node").filter(c("m") * limits.share <= c("k"))
    pairs = met.groupBy("entity", "term").agg(one.alias("n_both"), F.countDistinct("family").alias("f"), F.max("k").alias("k"))
    pairs = written(pairs.filter(c("f") >= limits.contexts).drop("f"), "pairs")
    wanted = written(pairs.select("term").distinct(), "wanted")
    if wanted.isEmpty():
        return None
    occur = written(rows.select("_text", F.explode(_terms(c("text"))).alias("term")).join(_few(wanted), "term").select("_text", "term").distinct(), "occur")
    by_term = occur.groupBy("term").agg(one.alias("n_term"))
    share = c("n_both") / c("n_term")
    found = pairs.join(by_term, "term").filter((share >= limits.share) & (F.log2(share * n / c("k")) >= limits.bits))
    found = found.groupBy("term").agg(F.max(share).alias("share")).select("term", F.when(c("share") >= limits.remove, "drop").otherwise("term").alias("kind"))
    return written(found, "terms"), occur


def find_personal_data(docs: DataFrame, limits: Limits = Limits(), also: tuple[str, ...] = ()) -> tuple[DataFrame, list[Table]]:
    """doc_id, text (null: empty), base and spans (base and term spans) of every row, with the columns ``also``,
    and the tables in the shared folder to drop after use."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *also)
    rows = rows.withColumn("_text", F.md5("text")).withColumn("base", base_spans(F.col("text")))
    tables: list[Table] = []
    found = disclosing_terms(rows, limits, tables)
    if found is None:
        out = rows.withColumn("spans", F.col("base")).drop("_text")
    else:
        terms, occur = found
        by_text = occur.join(terms, "term").groupBy("_text").agg(F.map_from_entries(F.collect_set(F.struct("term", "kind"))).alias("_terms"))
        tables.append(Table(by_text, "pii-flagged"))
        flagged = rows.join(_few(tables[-1].df), "_text", "left")
        words = F.filter(S.matches(F.col("text"), TERM, "term"), lambda s: F.map_contains_key(F.col("_terms"), F.lower(s["text"])))
        extra = F.when(F.col("_terms").isNotNull(), F.transform(words, lambda s: s.withField("kind", F.element_at(F.col("_terms"), F.lower(s["text"]))))).otherwise(S.empty())
        out = flagged.withColumn("_extra", extra).withColumn("spans", F.concat(F.col("base"), S.clear_of(F.col("_extra"), F.col("base")))).drop("_extra", "_text", "_terms")
    for t in tables[: -1 if found else None]:  # the last one is still read
        t.drop()
    return out, tables[-1:] if found else []


def sanitise(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``docs`` with the same columns: found strings and disclosing terms are replaced by their kind in brackets,
    or left out (kind ``drop``). Texts without spans, null ones too, stay as they are. Runs when called."""
    names = docs.columns
    kept = whole_row(docs).alias("_row")
    found, tables = find_personal_data(docs.select("doc_id", "text", kept), limits, also=("_row",))
    made = F.regexp_replace(S.replaced(F.col("text"), F.col("spans")), r"\x20?\[DROP\]", "")
    new = F.when(F.size("spans") > 0, made).otherwise(F.col("_row.text"))
    return found.select(*[new.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in names])


# --- the registered query -------------------------------------------------


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Every document's personal data."""
    found, _ = find_personal_data(table(spark, sf_dir, "documents"))
    base = F.col("base")
    return found.select("doc_id", *[S.count(base, k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(S.written(base), 256).alias("base_sha256"), S.written(S.ordered(F.col("spans"), KINDS, True)).alias("spans"))


def _oracle(limits: Limits = Limits()) -> str:
    from . import span_sql as Q

    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    doubled = "CASE WHEN i % 2 = 1 THEN x ELSE CASE WHEN x > 4 THEN 2 * x - 9 ELSE 2 * x END END"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: {doubled.replace('x', f'CAST(substr(reverse({digits}), i, 1) AS INT)')})) % 10 = 0"
    plain = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_max(list_transform(string_split(m, '.'), lambda x: CAST(x AS HUGEINT))) <= 255"),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({digits}) BETWEEN 13 AND 19 AND {luhn}"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 9 AND 15"),
    }
    terms = "list_distinct(regexp_extract_all(lower(t), '\\p{L}+'))"
    base = " UNION ALL ".join(f"SELECT * FROM f_{k}" for k in BASE_KINDS)
    sums = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    counts = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE_KINDS)
    minima = ", ".join(f"min(substr(h, {DIGITS * i + 1}, {DIGITS})) AS m{i}" for i in range(2 * PAIRS))
    keys = " UNION ALL ".join(f"SELECT r, '{k}' AS p, m{2 * k} AS x, m{2 * k + 1} AS y FROM mn" for k in range(PAIRS))
    order = f"{Q.place(KINDS)}, s"
    return (
        f"WITH RECURSIVE {Q.DOCS},\n"
        + ",\n".join(Q.found(f"f_{k}", k, p, where) for k, (p, where) in plain.items())
        + f""",
b AS ({base}),
u AS (SELECT t, min(r) AS r FROM d GROUP BY t),
m AS (SELECT DISTINCT r, lower(m) AS entity FROM b WHERE r IN (SELECT r FROM u)),
rec AS (SELECT entity, count(*) AS k FROM m GROUP BY entity HAVING count(*) >= {limits.contexts}),
hd AS (SELECT DISTINCT r FROM m JOIN rec USING (entity)),
ws AS (SELECT r, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+') AS w FROM u JOIN hd USING (r)),
sh AS (SELECT r, sha256(array_to_string(w[i:i + {SHINGLE - 1}], ' ')) AS h FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS i FROM ws)),
mn AS (SELECT r, {minima} FROM sh GROUP BY r),
ky AS ({keys}),
eg AS (SELECT DISTINCT a.r AS a, b.r AS b FROM ky a JOIN ky b USING (p, x, y)),
rf(r, y) AS (SELECT r, r FROM hd UNION SELECT rf.r, eg.b FROM rf JOIN eg ON eg.a = rf.y),
fam AS (SELECT r, min(y) AS family FROM rf GROUP BY r),
kept AS (SELECT entity, k FROM m JOIN rec USING (entity) JOIN fam USING (r) GROUP BY entity, k HAVING count(DISTINCT family) >= {limits.contexts} AND log2((SELECT count(*) FROM u) / k) >= {limits.bits}),
near AS (SELECT r, family, unnest({terms}) AS term FROM u JOIN fam USING (r) WHERE r IN (SELECT r FROM m JOIN kept USING (entity))),
pairs AS (SELECT entity, k, term, count(*) AS n_both FROM m JOIN kept USING (entity) JOIN near USING (r) GROUP BY entity, k, term HAVING count(DISTINCT family) >= {limits.contexts}),
occur AS (SELECT r, term FROM (SELECT r, unnest({terms}) AS term FROM u WHERE (SELECT count(*) FROM pairs) > 0) WHERE term IN (SELECT term FROM pairs)),
n_t AS (SELECT term, count(*) AS n_term FROM occur GROUP BY term),
told AS (SELECT term, max(n_both / n_term) AS share FROM pairs JOIN n_t USING (term)
  WHERE n_both / n_term >= {limits.share} AND log2(n_both / n_term * (SELECT count(*) FROM u) / k) >= {limits.bits} GROUP BY term),
hit AS (SELECT r, doc_id, t FROM d WHERE t IN (SELECT t FROM u WHERE r IN (SELECT r FROM occur WHERE term IN (SELECT term FROM told)))),
{Q.found("f_word", "term", "\\p{L}+", source="hit")},
extra AS (SELECT w.r, CASE WHEN share >= {limits.remove} THEN 'drop' ELSE 'term' END AS kind, w.s, w.e, w.m FROM f_word w JOIN told ON lower(w.m) = told.term
  WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.r = w.r AND w.s < b.e AND b.s < w.e)),
a AS (SELECT * FROM b UNION ALL SELECT * FROM extra),
gb AS (SELECT r, {sums}, {Q.joined(order)} AS base FROM b GROUP BY r),
ga AS (SELECT r, {Q.joined(order)} AS spans FROM a GROUP BY r)
SELECT doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN gb USING (r) LEFT JOIN ga USING (r)"""
    )


ORACLE = _oracle()
