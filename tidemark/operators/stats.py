"""Benchmark analytics: percentiles, windows, counters, summaries and comparisons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.running import running_sum, with_prefix

QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}
OFFICIAL_RUNS = 5


def order_statistics(df: DataFrame, group: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Elements of each group's sorted values, exactly: ``ranks`` gives, by name, the place (from 1) as a function of how
    many values there are. Equal values are counted first; the counts are summed along the values by blocks, so that
    no task holds a group."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    along = running_sum(counts, group, value, "_c", "_upto")
    total = counts.groupBy(*group).agg(F.sum("_c").alias("_all"))
    met = with_prefix(along, total, group, "_all")
    return met.groupBy(*group).agg(*[F.min(F.when(F.col("_upto") >= place(F.col("_all")), F.col(value))).alias(n) for n, place in ranks.items()])


def nearest(q: float) -> Callable[[Column], Column]:
    """The nearest-rank percentile: element ceil(q n)."""
    return lambda n: F.greatest(F.ceil(n * F.lit(q)), F.lit(1).cast("long"))


def latency(ops: DataFrame, *group: str) -> DataFrame:
    """Nearest-rank percentiles and the largest latency of the operations that succeeded."""
    return order_statistics(ops.filter("ok"), list(group), "latency", {**{n: nearest(q) for n, q in QUANTILES.items()}, "max": lambda n: n})


def window(ops: DataFrame, start: str, end: str, seconds: float, *group: str) -> DataFrame:
    """Operations done within [start, end): counts, retries (of failed ones, too), throughput."""
    inside = ops.filter((F.col("done") >= F.lit(start).cast("timestamp")) & (F.col("done") < F.lit(end).cast("timestamp")))
    ok = F.count_if("ok")
    return inside.groupBy(*group).agg(ok.alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).alias("retries"), F.round(ok / F.lit(seconds), 6).alias("throughput"))


def describe(df: DataFrame, group: list[str], values: list[str], counts: list[Column], where: dict[str, Column] | None = None) -> DataFrame:
    """By group: the ``counts``, and of each value its median (mean of the middle two), min and max over the rows that meet
    the value's condition; zeros without values."""
    always = F.lit(True)
    pairs = [F.struct(F.lit(v).alias("stat"), F.when((where or {}).get(v, always), F.col(v).cast("double")).alias("v")) for v in values]
    long = df.select(*group, F.explode(F.array(*pairs)).alias("p")).select(*group, F.col("p.stat").alias("_stat"), F.col("p.v").alias("_v"))
    places = {"_a": lambda n: F.floor((n + 1) / 2), "_b": lambda n: F.floor(n / 2) + 1, "_lo": lambda n: F.lit(1), "_hi": lambda n: n}
    found = order_statistics(long, [*group, "_stat"], "_v", places)
    of = {"median": (F.col("_a") + F.col("_b")) / 2, "min": F.col("_lo"), "max": F.col("_hi")}
    wide = found.groupBy(*group).agg(*[F.max(F.when(F.col("_stat") == v, c)).alias(f"{v}_{n}") for v in values for n, c in of.items()])
    names = [f"{v}_{n}" for v in values for n in of]
    base = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"), *counts)
    return with_prefix(base, wide, group, *names, how="left").drop("_rows").fillna(0.0, names)


def counter_deltas(readings: DataFrame) -> DataFrame:
    """Each counter's growth over all nodes (after - before), by family and label."""
    signed = F.when(F.col("boundary") == "after", F.col("value")).otherwise(-F.col("value"))
    family = F.regexp_extract("name", r"^([^{]*)", 1)
    origin = F.regexp_extract("name", r"\{origin=([^}]*)\}", 1)
    return readings.groupBy(family.alias("family"), origin.alias("origin")).agg(F.sum(signed).alias("delta"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 if b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def counter_rollup(readings: DataFrame) -> DataFrame:
    """Sums by (node, boundary), by node, and over all."""
    r = readings.rollup("node", "boundary").agg(F.sum("value").alias("total"))
    return r.select(F.coalesce(F.col("node").cast("string"), F.lit("all")).alias("node"), F.coalesce("boundary", F.lit("all")).alias("boundary"), "total")


def run_validity(statuses: DataFrame) -> DataFrame:
    """A node's run is valid if its term is the same at both ends."""
    ends = statuses.groupBy("node").agg(F.min_by("term", "tick").alias("first_term"), F.max_by("term", "tick").alias("last_term"), F.max("commit_index").alias("hi"), F.min("commit_index").alias("lo"))
    return ends.select("node", F.when(F.col("first_term") == F.col("last_term"), 1).otherwise(0).alias("valid"), F.greatest(F.lit(0), F.col("last_term") - F.col("first_term")).alias("elections"), F.greatest(F.lit(0), F.col("hi") - F.col("lo")).alias("committed"))


def window_outcome(starts: DataFrame, ends: DataFrame, group: str) -> DataFrame:
    """Of each run whether it counts, and why not: the statuses (node, term, commit_index) read at its window's start and
    end must be as many, and no node's term may change. The elections within the window and the entries committed are
    the growth of the highest term and commit index over all nodes, 0 at least."""
    side = lambda d, x: d.select(group, "node", F.col("term").alias(f"{x}_term"), F.col("commit_index").alias(f"{x}_commit"))
    both = side(starts, "s").join(side(ends, "e"), [group, "node"], "full_outer")
    changed = F.col("s_term") != F.col("e_term")
    first = F.min(F.when(changed, F.struct("node", "s_term", "e_term")))
    out = both.groupBy(group).agg(F.count("s_term").alias("n_s"), F.count("e_term").alias("n_e"), first.alias("first"), *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("s_term", "e_term", "s_commit", "e_commit")])
    words = lambda *xs: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    text = lambda c: F.col(c).cast("string")
    reason = F.when(F.col("n_s") != F.col("n_e"), words(text("n_s"), " terms at the start, ", text("n_e"), " at the end")).when(F.col("first").isNotNull(), words("node ", text("first.node"), ": term ", text("first.s_term"), " to ", text("first.e_term")))
    grown = lambda x: F.greatest(F.lit(0), F.col(f"e_{x}") - F.col(f"s_{x}"))
    return out.select(group, reason.isNull().alias("valid"), F.coalesce(reason, F.lit("")).alias("reason"), grown("term").alias("elections"), grown("commit").alias("committed"))


def summarize(runs: DataFrame) -> DataFrame:
    """By number of clients: how many runs, valid and not; the valid ones' throughput and latency; and over all runs whose
    failover probe succeeded, valid or not, how long it took."""
    valid, probed = F.col("valid"), F.coalesce(F.col("failover_ok"), F.lit(False))
    counts = [F.count(F.lit(1)).alias("runs"), F.count_if(valid).alias("valid_runs"), F.count_if(~valid).alias("invalid_runs"), F.count_if(probed).alias("probes_ok"), F.count_if(~F.col("failover_ok")).alias("probes_failed")]
    own, failover = ["throughput", "p50", "p99"], ["failover_ms", "after_close_ms"]
    return describe(runs, ["clients"], own + failover, counts, {**{v: valid for v in own}, **{v: probed for v in failover}})


#: What a cell describes of its valid runs; send failures only of runs that recorded both kinds.
CELL = ["throughput", "p99", "syncs", "per_sync", "appends", "ack_resends", "send_deadline", "send_other"]


def cells(runs: DataFrame) -> DataFrame:
    """By arm and number of clients: runs valid and not, and eight statistics over the valid ones."""
    valid = F.col("valid")
    recorded = valid & F.col("send_deadline").isNotNull() & F.col("send_other").isNotNull()
    counts = [F.count_if(valid).alias("valid_runs"), F.count_if(~valid).alias("invalid_runs"), F.count_if(recorded).alias("send_recorded")]
    return describe(runs, ["arm", "clients"], CELL, counts, {v: recorded if v.startswith("send_") else valid for v in CELL})


def in_declared_order(cells: DataFrame, arms: list[str]) -> DataFrame:
    """Cells by number of clients, then by the arm's declared place (from 1). An undeclared arm is an error."""
    known = F.array(*map(F.lit, arms))
    place = F.array_position(known, F.col("arm"))
    checked = F.when(place > 0, place).otherwise(F.raise_error(F.concat(F.lit("undeclared arm "), F.col("arm"))))
    return cells.withColumn("place", checked.cast("long")).orderBy("clients", "place")


def label(runs: DataFrame) -> DataFrame:
    """official if there are runs and all are, else secondary: one row."""
    return runs.agg(F.coalesce(F.bool_and(F.coalesce(F.col("label") == "official", F.lit(False))), F.lit(False)).alias("all")).select(F.when(F.col("all"), "official").otherwise("secondary").alias("label"))


def meaningful(a: str, b: str) -> Column:
    """Two arms differ only if their ranges don't touch."""
    return (F.col(f"{a}_max") < F.col(f"{b}_min")) | (F.col(f"{b}_max") < F.col(f"{a}_min"))


def compare(runs: DataFrame, arms: list[str], reference: str | None = None) -> DataFrame:
    """Each other declared arm against the reference arm (the first, unless named) for each number of clients that has
    runs. An arm without runs has no valid ones: insufficient, and its ratios are 0."""
    reference = arms[0] if reference is None else reference
    if reference not in arms:
        raise ValueError(f"{reference} isn't a declared arm")
    c = cells(runs)
    names = ["valid_runs", *[f"{v}_{n}" for v in ("throughput", "appends", "p99") for n in ("median", "min", "max")]]
    side = lambda x: c.select(F.col("clients").alias(f"{x}_clients"), F.col("arm").alias(f"{x}_arm"), *[F.col(n).alias(f"{x}_{n}") for n in names])
    others = F.array(*[F.lit(a) for a in arms if a != reference]).cast("array<string>")
    grid = c.select("clients").distinct().select("clients", F.explode(others).alias("arm"))
    base = side("r").filter(F.col("r_arm") == reference)
    met = grid.join(base, F.col("clients") == F.col("r_clients"), "left").join(side("a"), (F.col("arm") == F.col("a_arm")) & (F.col("clients") == F.col("a_clients")), "left")
    met = met.fillna(0, [f"{x}_{n}" for x in "ar" for n in names])
    enough = (F.col("a_valid_runs") >= OFFICIAL_RUNS) & (F.col("r_valid_runs") >= OFFICIAL_RUNS)
    some = (F.col("a_valid_runs") > 0) & (F.col("r_valid_runs") > 0)
    of = lambda v: F.when(some, ratio(F.col(f"a_{v}_median"), F.col(f"r_{v}_median"))).otherwise(0.0)
    apart = lambda v: F.when(enough & meaningful(f"a_{v}", f"r_{v}"), 1).otherwise(0)
    return met.select("arm", "clients", F.col("r_valid_runs").alias("base_runs"), F.col("a_valid_runs").alias("other_runs"), F.round(of("throughput"), 6).alias("ratio"), F.round(of("appends"), 6).alias("appends_ratio"), F.when(enough, 0).otherwise(1).alias("insufficient"), apart("throughput").alias("meaningful"), apart("appends").alias("appends_meaningful"), apart("p99").alias("p99_meaningful"))


def pairwise(runs: DataFrame) -> DataFrame:
    """All pairs of arms with the same number of clients, and whether they differ. Arms are few."""
    c = cells(runs)
    a = c.select("clients", F.col("arm").alias("a"), F.col("throughput_min").alias("a_min"), F.col("throughput_max").alias("a_max"))
    b = c.select("clients", F.col("arm").alias("b"), F.col("throughput_min").alias("b_min"), F.col("throughput_max").alias("b_max"))
    return a.join(b, "clients").filter("a < b").select("clients", "a", "b", F.when(meaningful("a", "b"), 1).otherwise(0).alias("meaningful"))


def result(ops: DataFrame, seconds: str, *group: str) -> DataFrame:
    """Of a workload's operations (value latency; ``seconds``: the wall time, one a group): operations a second and
    nearest-rank latencies."""
    rate = ops.groupBy(*group).agg(F.count(F.lit(1)).alias("operations"), F.max(seconds).alias("_s"))
    return with_prefix(rate.withColumn("per_second", F.round(ratio(F.col("operations"), F.col("_s")), 6)).drop("_s"), latency(ops.withColumn("ok", F.lit(True)), *group), list(group), *QUANTILES, "max")


def sync_samples(samples: DataFrame, value: str, *group: str) -> DataFrame:
    """How many samples of a sync's duration there are, and their nearest-rank p50 and p99."""
    n = samples.groupBy(*group).agg(F.count(value).alias("samples"))
    return with_prefix(n, order_statistics(samples, list(group), value, {"p50": nearest(0.5), "p99": nearest(0.99)}), list(group), "p50", "p99")


def failover(probes: DataFrame) -> DataFrame:
    """From when the leader's stop began, was done, and the first write succeeded (times): milliseconds from stop to write,
    of the stop, and after it; ok where the probe has no error."""
    ms = lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) / 1000
    return probes.withColumns({"ok": F.col("error").isNull(), "failover_ms": ms("stop_start", "done"), "close_ms": ms("stop_start", "closed"), "after_close_ms": ms("closed", "done")})


def exposition(readings: DataFrame) -> DataFrame:
    """Readings (name, labels as a map, value) as the lines of a metrics endpoint."""
    pairs = F.array_sort(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit('="'), F.regexp_replace(e["value"], r'(["\\])', r"\\$1"), F.lit('"'))))
    inner = F.when(F.size(pairs) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    return readings.select(F.concat(F.col("name"), inner, F.lit(" "), F.col("value").cast("string")).alias("line"))


def sweep(rows: DataFrame) -> DataFrame:
    """Runs by duration, arm, clients and repetition, with the share of appends that were resends of answers."""
    return rows.withColumn("share", share(F.col("ack_resends"), F.col("appends"))).orderBy("duration", "arm", "clients", "repetition")


def workloads(ops: DataFrame, group: list[str], order: str) -> DataFrame:
    """Groups in the order in which they were first seen."""
    return ops.groupBy(*group).agg(F.min(order).alias("first_seen"), F.count(F.lit(1)).alias("operations"))


def share(part: Column, total: Column) -> Column:
    """part / total; null if the total isn't above 0."""
    return F.when(total > 0, part / total)


def histogram(ops: DataFrame, value: str, bounds: list[float], *group: str) -> DataFrame:
    """Cumulative counts at each upper bound, as a metrics endpoint gives them."""
    sums = [F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    wide = ops.groupBy(*group).agg(*sums, F.count(F.lit(1)).alias("le_inf"))
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"le_{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("le_inf").alias("n")))
    return wide.select(*group, F.explode(pairs).alias("b")).select(*group, F.col("b.le").alias("le"), F.col("b.n").alias("n"))


def exponential_bounds(start: float, factor: float, n: int) -> list[float]:
    return [start * factor**k for k in range(n)]


def histogram_quantile(hist: DataFrame, q: float, *group: str) -> DataFrame:
    """The quantile interpolated within its bucket, from cumulative buckets (le, n); buckets are few."""
    from pyspark.sql import Window

    w = Window.partitionBy(*group).orderBy("le")
    b = hist.withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("before", F.coalesce(F.lag("n").over(w), F.lit(0))).withColumn("total", F.max("n").over(Window.partitionBy(*group)))
    hit = b.filter((F.col("n") >= F.col("total") * q) & (F.col("before") < F.col("total") * q))
    inner = F.col("low") + (F.col("le") - F.col("low")) * (F.col("total") * q - F.col("before")) / (F.col("n") - F.col("before"))
    return hit.select(*group, F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inner).alias("quantile"))


def schedule(spark, arms: list[str], clients: list[int], repetitions: int) -> DataFrame:
    """Interleaved runs: in repetition r the arms begin one further on."""
    n = len(arms)
    reps = spark.range(1, repetitions + 1).withColumnRenamed("id", "repetition")
    names = F.array(*map(F.lit, arms))
    slots = reps.select("repetition", F.posexplode(F.array(*map(F.lit, clients))).alias("c", "clients")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    arm = F.element_at(names, (F.pmod(F.col("i") + F.col("repetition") - 1, F.lit(n)) + 1).cast("int"))
    place = (F.col("repetition") - 1) * (len(clients) * n) + F.col("c") * n + F.col("i") + 1
    return slots.select(place.alias("slot"), "repetition", F.col("clients").cast("long").alias("clients"), arm.alias("arm"))


def leader(statuses: DataFrame, group: str) -> DataFrame:
    """Of those that call themselves leader, the one with the highest term; of equals the first."""
    return statuses.filter("role = 'leader'").groupBy(group).agg(F.max_by(F.struct("node", "tick", "term"), F.struct("term", -F.col("tick"))).alias("l")).select(group, "l.node", "l.term", "l.tick")


def counter_rate(readings: DataFrame, group: list[str], at: str, value: str) -> DataFrame:
    """Growth of a counter from reading to reading; a reset counts from zero."""
    from ..functions.running import previous

    back = previous(readings, group, at, [value])
    grown = F.col(value) - F.col(f"prev_{value}")
    return back.withColumn("growth", F.when(grown < 0, F.col(value)).otherwise(grown))
