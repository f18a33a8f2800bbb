"""Checks of benchmark reports, and string predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as an address or a home folder.
IPV4 = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"
IPV6 = r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]*+:[0-9A-Fa-f:]*+"  # a whole run of hex digits and colons that has a colon
HOME = r"(?:/home/|/Users/)[^/\"\s\\]+|/root(?:/|\"|$)"
_PART = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = r"[0-9A-Fa-f]{1,4}"
PASS, WARN, FAIL = "PASS", "WARN", "FAIL"


def privacy(docs: DataFrame, ident: str, text: str, words: tuple[str, ...] = ()) -> DataFrame:
    """What in a text points at a machine or person: addresses, home folders and the given words; FAIL with any,
    WARN with loopback or unspecified addresses alone."""
    every = lambda p: F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    v4 = F.filter(every(IPV4), lambda x: x.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    groups = lambda x: F.size(F.filter(F.split(x, ":"), lambda g: g != ""))
    long = rf"^(?:{_HEX}:){{7}}{_HEX}$"
    short = rf"^(?:{_HEX}(?::{_HEX})*)?::(?:{_HEX}(?::{_HEX})*)?$"
    v6 = F.filter(every(IPV6), lambda x: x.rlike(long) | (x.rlike(short) & (groups(x) <= 7)))
    own = F.filter(F.concat("v4", "v6"), lambda x: x.startswith("127.") | (x == "0.0.0.0") | x.rlike("^[0:]*:0{0,3}[01]$|^::$"))
    held = docs.select(ident, v4.alias("v4"), v6.alias("v6"), every(HOME).alias("home"), *[F.coalesce(F.col(text).rlike(rf"(?i)(?:^|[^A-Za-z0-9_-])\Q{w}\E(?:$|[^A-Za-z0-9_-])"), F.lit(False)).alias(f"_w{i}") for i, w in enumerate(words)])
    found = held.select(ident, *[F.coalesce(F.size(c), F.lit(0)).cast("long").alias(n) for n, c in (("ipv4", F.col("v4")), ("ipv6", F.col("v6")), ("loopback", own), ("homes", F.col("home")))], *[f"_w{i}" for i in range(len(words))])
    named = F.lit(False)
    for i in range(len(words)):
        named = named | F.col(f"_w{i}")
    bad = (F.col("ipv4") + F.col("ipv6") > F.col("loopback")) | (F.col("homes") > 0) | named
    return found.withColumn("status", F.when(bad, FAIL).when(F.col("loopback") > 0, WARN).otherwise(PASS)).drop(*[f"_w{i}" for i in range(len(words))])


def recorded(c: Column) -> Column:
    """Not null, with something but white space, and not exactly the word unknown."""
    return F.coalesce(c.rlike(r"[^\p{IsWhite_Space}]") & (c != "unknown"), F.lit(False))


def required(rows: DataFrame, fields: list[str]) -> DataFrame:
    """For each field how many rows lack it, and whether the check passes."""
    lacking = rows.agg(*[F.count_if(~recorded(F.col(f).cast("string"))).alias(f) for f in fields])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("missing")) for f in fields])
    return lacking.select(F.explode(pairs).alias("p")).select("p.field", "p.missing", F.when(F.col("p.missing") == 0, PASS).otherwise(FAIL).alias("status"))


def same_commit(a: Column, b: Column, least: int = 7) -> Column:
    """Whether two commit names agree on their common length, which must be ``least`` or more."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    n = F.least(F.length(x), F.length(y))
    return F.coalesce((n >= least) & (F.substring(x, F.lit(1), n) == F.substring(y, F.lit(1), n)), F.lit(False))


def arm_match(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Declared arms (arm, commit) against those found (arm, found)."""
    both = expected.join(actual, "arm", "full_outer")
    status = F.when(F.col("found").isNull(), "missing").when(F.col("commit").isNull(), "undeclared").when(same_commit(F.col("commit"), F.col("found")), "ok").otherwise("other commit")
    return both.select("arm", status.alias("status"))


def parsed_list(c: Column, separator: str = ",") -> Column:
    """The trimmed, non-empty parts of a list."""
    return F.filter(F.transform(F.split(c, f"\\Q{separator}\\E"), lambda x: F.trim(x)), lambda x: x != "")


def validity(runs: DataFrame, *group: str) -> DataFrame:
    """Of runs (valid, elections): FAIL if one isn't judged or lost by an election, WARN if some are invalid, else PASS."""
    judged, n = F.count("valid"), F.count(F.lit(1))
    invalid = F.count_if(~F.col("valid"))
    by_election = F.count_if(~F.col("valid") & (F.col("elections") > 0))
    out = runs.groupBy(*group).agg(n.alias("runs"), judged.alias("judged"), invalid.alias("invalid"), by_election.alias("by_election"))
    return out.withColumn("status", F.when((F.col("judged") < F.col("runs")) | (F.col("runs") == 0) | (F.col("by_election") > 0), FAIL).when(F.col("invalid") > 0, WARN).otherwise(PASS))


# The official protocol.
WARMUP, WINDOW, REPETITIONS = 5.0, 30.0, 5


def protocol(warmup: Column, window: Column, repetitions: Column) -> Column:
    """FAIL if something isn't recorded, WARN if it isn't the official protocol."""
    known = warmup.isNotNull() & window.isNotNull() & repetitions.isNotNull()
    return F.when(~known, FAIL).when((warmup == WARMUP) & (window == WINDOW) & (repetitions == REPETITIONS), PASS).otherwise(WARN)


def failure_class(message: Column) -> Column:
    """Send failures by an expired deadline, and all others."""
    return F.when(F.lower(message).contains("deadline exceeded") | F.lower(message).contains("deadlineexceeded"), "deadline").otherwise("other")


def arm_spec(spec: Column) -> Column:
    """name, rev and picks of "name=rev+pick,pick"; null if it isn't one."""
    name = F.trim(F.regexp_extract(spec, r"^([^=]*)=", 1))
    rest = F.trim(F.regexp_extract(spec, r"=([\s\S]*)$", 1))
    plus = F.instr(rest, "+") > 0
    rev = F.trim(F.regexp_extract(rest, r"^([^+]*)", 1))
    picks = F.when(plus, F.transform(F.split(F.regexp_extract(rest, r"\+([\s\S]*)$", 1), ","), lambda x: F.trim(x))).otherwise(F.array().cast("array<string>"))
    good = lambda r: (r != "") & ~r.startswith("-") & ~r.rlike(r"[ \t\n]")
    ok = F.contains(spec, F.lit("=")) & name.rlike(r"^[A-Za-z0-9_-]+$") & good(rev) & F.forall(picks, good)
    return F.when(ok, F.struct(name.alias("name"), rev.alias("rev"), picks.alias("picks")))


def normal_voters(voters: Column) -> Column:
    """Sorted, distinct, positive; null if nothing is left or something isn't a voter."""
    clean = F.array_sort(F.array_distinct(voters))
    return F.when((F.size(clean) > 0) & (F.size(clean) == F.size(voters)) & ~F.exists(clean, lambda x: x <= 0), clean)


# Flags that are set for each slot and can't be passed on.
OWN_FLAGS = ["clients", "repetitions", "out", "machine-type", "disk-type"]


def accepts_labels(usage: Column) -> Column:
    """Whether a usage text declares both label flags."""
    return usage.rlike(r"(?m)^\s*-machine-type\s") & usage.rlike(r"(?m)^\s*-disk-type\s")


def slot_args(clients: Column, out: Column, extra: Column, machine: Column, disk: Column, forward: Column) -> Column:
    """The arguments of one slot: labels are passed on only if wanted and both set."""
    own = F.array(F.concat(F.lit("-clients="), clients.cast("string")), F.lit("-repetitions=1"), F.concat(F.lit("-out="), out))
    labels = F.when(forward & (machine != "") & (disk != ""), F.array(F.concat(F.lit("-machine-type="), machine), F.concat(F.lit("-disk-type="), disk))).otherwise(F.array().cast("array<string>"))
    return F.concat(own, labels, extra)


def _flag(arg: Column) -> Column:
    return F.when(arg.startswith("-"), F.regexp_extract(arg, r"^-+([^=]*)", 1))


def extra_problem(args: Column) -> Column:
    """The first extra argument that would override a slot's own flag, or null."""
    bad = F.filter(F.transform(args, _flag), lambda f: f.isin(*OWN_FLAGS))
    return F.when(F.size(bad) > 0, F.get(bad, F.lit(0)))


def passes_official(args: Column) -> Column:
    """Whether the last official flag among the arguments is on: without a value, or with one that means true."""
    flags = F.filter(args, lambda a: F.coalesce(_flag(a) == "official", F.lit(False)))
    last = F.element_at(flags, -1)
    on = ~F.contains(last, F.lit("=")) | F.regexp_extract(last, r"=([\s\S]*)$", 1).isin("1", "t", "T", "true", "TRUE", "True")
    return F.when(F.size(flags) > 0, on).otherwise(False)


def machine_labels_missing(args: Column, machine: Column, disk: Column) -> Column:
    blank = lambda c: ~F.coalesce(c.rlike(r"[^\p{IsWhite_Space}]"), F.lit(False))
    return passes_official(args) & (blank(machine) | blank(disk))


def run_label(system: Column, official: Column) -> Column:
    """official on Linux if asked for, secondary if not; null where it was asked for elsewhere."""
    return F.when(~official, "secondary").when(system == "linux", "official")


def verdict(results: DataFrame, *group: str) -> DataFrame:
    """The lines of a report's checks, in the order of ``place``, and its last line."""
    line = F.struct("place", F.concat(F.rpad("status", 4, " "), F.lit("  "), F.rpad("check", 16, " "), F.lit(" "), F.col("detail")).alias("line"))
    failed, warned = F.count_if(F.col("status") == FAIL), F.count_if(F.col("status") == WARN)
    out = results.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]).alias("lines"), failed.alias("failed"), warned.alias("warned"))
    last = F.concat(F.lit("result: "), F.when(F.col("failed") > 0, FAIL).otherwise(PASS), F.lit(" ("), F.col("failed").cast("string"), F.lit(" failed, "), F.col("warned").cast("string"), F.lit(" warnings)"))
    return out.select(*group, F.array_join("lines", "\n").alias("lines"), last.alias("result"))
