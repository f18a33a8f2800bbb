"""URL filters by a bit-parallel wildcard automaton.

Every rule is a glob over the canonical form of a URL: a dot, the lower-cased
host, and the path, such as ``.www.example.com/en/7``. ``*`` stands for any run
of characters but ``/``, ``**`` for any run, ``?`` for one character but ``/``.
All globs are packed into one row of bits (64 to a machine word): the bit of a
state says that so many of its glob's items have been read. One step of the
Shift-And recurrence moves every state of every glob at once::

    S' = (S << 1) & match[c]  |  S & stay[c]

where ``match[c]`` has the bits of the items that accept byte c and ``stay[c]``
the states that stand before a wildcard run. A step is done for many URLs at
once, one row of words for each, longest URLs first, so that each step touches
just the URLs that still have bytes.

Host rules ``(host, path)`` compile to ``*.host/path**``: host and all its
subdomains, any longer path. Among the host rules that fit, the longest wins;
other globs decide where no host rule fits, the longest first; then the default.

Defined results: of rules of equal length the one given first wins; very long URLs
are judged whole; a null URL, or one without ``://``, has an empty host and path
and so the default verdict; repeated rows are judged apart; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, ascii_lower

ALLOW, BLOCK = "allow", "block"
#: URLs longer than this many bytes are stepped alone, on Python's integers.
LONG_URL = 4096
#: Bits of state that a step may touch at once: URLs times words.
STEP_WORDS = 1 << 20


@dataclass(frozen=True)
class Rule:
    """``host`` is set for a rule on a host and path; else ``pattern`` is a glob over the canonical form."""

    verdict: str
    host: str | None = None
    path: str = ""
    pattern: str | None = None

    @property
    def text(self) -> str:
        return self.pattern if self.host is None else f"{self.host}{self.path}"

    @property
    def glob(self) -> str:
        return self.pattern if self.host is None else f"*.{self.host}{self.path}**"


#: Rules of one job, at most: their masks take some 35 bytes a character.
MOST_RULES = 100_000


def read_rules(spark, path: str) -> list[Rule]:
    """Glob rules from a text file, one a line: allow or block, white space, the glob. Blank lines and # lines are left out."""
    lines = [r["value"].split(None, 1) for r in spark.read.text(path).limit(MOST_RULES + 1).collect() if r["value"].strip() and not r["value"].startswith("#")]
    if len(lines) > MOST_RULES or any(len(x) < 2 or x[0] not in (ALLOW, BLOCK) for x in lines):
        raise ValueError("not a list of rules, or too long a one")
    return [Rule(verdict, pattern=glob.strip()) for verdict, glob in lines]


#: Some junk hosts, as globs, where no list of rules is given.
DEFAULT_GLOBS = (
    Rule(BLOCK, pattern="*.spam-farm.**"),
    Rule(BLOCK, pattern="*.cheap-pills.**"),
    Rule(BLOCK, pattern="**/wp-login*"),
    Rule(BLOCK, pattern="*.casino*.*/**"),
)


class GlobAutomaton:
    """All globs of a rule list as one bit-parallel automaton over bytes."""

    def __init__(self, globs: Sequence[str]) -> None:
        match: list[tuple[int, np.ndarray]] = []
        stay: list[tuple[int, np.ndarray]] = []
        first, last, at = [], [], 0
        every, no_slash = np.ones(256, bool), np.ones(256, bool)
        no_slash[ord("/")] = False
        more = np.zeros(256, bool)
        more[0x80:0xC0] = True  # continuation bytes: one character may be several
        for glob in globs:
            first.append(at)
            raw, i = glob.encode(), 0
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    stay.append((at, every))
                    i += 2
                elif raw[i : i + 1] == b"*":
                    stay.append((at, no_slash))
                    i += 1
                else:
                    at += 1
                    if raw[i : i + 1] == b"?":
                        match.append((at, no_slash & ~more))
                        stay.append((at, more))
                    else:
                        one = np.zeros(256, bool)
                        one[raw[i]] = True
                        match.append((at, one))
                    i += 1
            last.append(at)
            at += 1
        self.words = max(1, (at + 63) // 64)
        self.match = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        for into, sets in ((self.match, match), (self.stay, stay)):
            for bit, accepted in sets:
                into[accepted, bit // 64] |= np.uint64(1 << (bit % 64))
        self.start = np.zeros(self.words, np.uint64)
        for bit in first:
            self.start[bit // 64] |= np.uint64(1 << (bit % 64))
        self.last_word = np.array([b // 64 for b in last], np.int64)
        self.last_bit = np.array([b % 64 for b in last], np.uint64)

    def _accepted(self, state: np.ndarray) -> np.ndarray:
        return ((state[:, self.last_word] >> self.last_bit) & np.uint64(1)).astype(bool)

    def _long(self, raw: bytes) -> np.ndarray:
        as_int = lambda row: int.from_bytes(row.tobytes(), "little")
        match, stay = ([as_int(r) for r in m] for m in (self.match, self.stay))
        s = as_int(self.start)
        for c in raw:
            s = ((s << 1) & match[c]) | (s & stay[c])
        return np.frombuffer(s.to_bytes(self.words * 8, "little"), np.uint64)

    def matches(self, texts: Sequence[bytes]) -> np.ndarray:
        """A row of booleans for each text: which globs match the whole of it."""
        out = np.zeros((len(texts), len(self.last_word)), bool)
        size = np.array([len(t) for t in texts], np.int64)
        for i in np.flatnonzero(size > LONG_URL):
            out[i] = self._accepted(self._long(texts[i])[None, :])[0]
        order = np.flatnonzero(size <= LONG_URL)
        order = order[np.argsort(-size[order], kind="stable")]
        step = max(1, STEP_WORDS // self.words)
        for at in range(0, len(order), step):
            rows = order[at : at + step]
            out[rows] = self._accepted(self._run([texts[i] for i in rows], size[rows]))
        return out

    def _run(self, texts: list[bytes], size: np.ndarray) -> np.ndarray:
        """The end states of texts that are sorted longest first."""
        width = int(size[0]) if len(size) else 0
        flat = np.frombuffer(b"".join(texts), np.uint8)
        chars = np.zeros((len(texts), width), np.uint8)
        chars[np.arange(width)[None, :] < size[:, None]] = flat
        chars = np.ascontiguousarray(chars.T)
        live = np.searchsorted(-size, -np.arange(1, width + 1), side="right")  # texts with at least j bytes
        state = np.tile(self.start, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        for j in range(width):
            n = live[j]
            s, c = state[:n], chars[j, :n]
            moved = s << one
            if self.words > 1:
                moved[:, 1:] |= s[:, :-1] >> top
            state[:n] = (moved & self.match[c]) | (s & self.stay[c])
        return state


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    globs: Sequence[Rule] = DEFAULT_GLOBS,
    default: str = ALLOW,
    url: str = "url",
    keys: Sequence[str] = ("page_id",),
) -> DataFrame:
    """Judges every URL: ``keys``, host, path, rule (the winning host rule or null), glob (the glob that
    decided where no host rule fits, or null) and verdict. The rules are few and travel with the job."""
    for r in (*rules, *globs):
        if r.verdict not in (ALLOW, BLOCK):
            raise ValueError(f"a verdict is allow or block, not {r.verdict}")
    by_length = lambda rs: sorted(rs, key=lambda r: -len(r.text))
    ordered, n_host = [*by_length(rules), *by_length(globs)], len(rules)
    texts, verdicts = [r.text for r in ordered], [r.verdict for r in ordered]
    if len(ordered) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    shared = pages.sparkSession.sparkContext.broadcast(GlobAutomaton([r.glob for r in ordered]))  # bounded by MOST_RULES

    rest = F.substring(F.col(url), F.instr(url, "://") + 3, 1 << 30)
    rest = F.when(F.instr(url, "://") > 0, rest).otherwise("")
    head = F.regexp_extract(rest, r"^([^?#]*)", 1)
    slash = F.instr(head, "/")
    host = ascii_lower(F.when(slash > 0, F.substring(head, F.lit(1), slash - 1)).otherwise(head))
    path = F.when(slash > 0, F.substring(head, slash, F.lit(1 << 30))).otherwise("")
    base = pages.select(*keys, F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    kinds = dict(pages.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "host string, path string, rule string, glob string, verdict string"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, auto = len(keys), shared.value
        for b in batches:
            if not b.num_rows:
                continue
            hosts, paths = b.column(n).to_pylist(), b.column(n + 1).to_pylist()
            hit = auto.matches([f".{h}{p}".encode() for h, p in zip(hosts, paths, strict=True)])
            by_rule, by_glob = hit[:, :n_host], hit[:, n_host:]
            rule = np.where(by_rule.any(1), by_rule.argmax(1) if n_host else 0, -1)
            glob = np.where((rule < 0) & by_glob.any(1), n_host + (by_glob.argmax(1) if by_glob.shape[1] else 0), -1)
            won = np.maximum(rule, glob)
            pick = lambda xs, at: pa.array([xs[i] if i >= 0 else None for i in at.tolist()], pa.string())
            verdict = pa.array([verdicts[i] if i >= 0 else default for i in won.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, pick(texts, rule), pick(texts, glob), verdict], [*b.schema.names, "rule", "glob", "verdict"])

    return arrow_map(base, judge, schema)


# --- the registered query -------------------------------------------------

RULES = (
    Rule(BLOCK, "com", "/en/"),
    Rule(ALLOW, "example.com", "/en/7"),
    Rule(ALLOW, "net", "/de/"),
    Rule(BLOCK, "example.net", "/de/8"),
    Rule(BLOCK, "org", "/es/"),
)


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's URL, judged."""
    from .common import table

    return filter_urls(table(spark, sf_dir, "pages"), RULES)


ORACLE = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*(/[^?#]*)?', 1) AS path
  FROM u
), r AS (SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) AS t(v, h, s)
), w AS (
  SELECT page_id, host, path, arg_max(h || s, length(h || s)) AS rule, arg_max(v, length(h || s)) AS v
  FROM (SELECT DISTINCT page_id, host, path FROM p) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s)
  GROUP BY ALL
), g AS (
  SELECT p.*, w.rule, w.v, CASE WHEN w.rule IS NOT NULL THEN NULL
    WHEN regexp_matches('.' || p.host || p.path, '^[^/]*\\.cheap-pills\\.') THEN '*.cheap-pills.**'
    WHEN regexp_matches('.' || p.host || p.path, '^[^/]*\\.spam-farm\\.') THEN '*.spam-farm.**'
    WHEN regexp_matches('.' || p.host || p.path, '^[^/]*\\.casino[^/]*\\.[^/]*/') THEN '*.casino*.*/**'
    WHEN regexp_matches('.' || p.host || p.path, '^(?s:.*)/wp-login[^/]*$') THEN '**/wp-login*' END AS "glob"
  FROM p LEFT JOIN w ON p.page_id = w.page_id AND p.host = w.host AND p.path = w.path
)
SELECT page_id, host, path, rule, "glob", coalesce(v, CASE WHEN "glob" IS NULL THEN 'allow' ELSE 'block' END) AS verdict FROM g
"""
