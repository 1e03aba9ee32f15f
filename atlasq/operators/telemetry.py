"""Bounded analytics over runtime metrics: dependency and latency rollups, ranking, budgets and coverage.

Inputs are metric buckets: ``source, target, target_type, outcome, calls, duration_us`` for dependencies, and
``service, transaction, transaction_type, ts, calls, duration_us, known, success`` for latency. Sums are kept exact; rates
are plain doubles and null where nothing was counted.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr as E
from ..plans.scratch import checkpointed

#: The default budgets.
MAX_RELATIONS, MAX_BYTES, MAX_BUCKETS = 80, 50_000, 5_000
VIEW_LIMITS = {"services": 30, "transactions": 50, "dependencies": 80, "timeline": 500, "traces": 20, "spans": 100}


def in_window(df: DataFrame, start: Column, end: Column, ts: str = "ts") -> DataFrame:
    """Half open: start <= ts < end."""
    return df.where((F.col(ts) >= start) & (F.col(ts) < end))


def window_index(ts: Column, end: Column, seconds: int) -> Column:
    """Number of the tumbling window counted back from ``end``, 0 the newest; a window holds its start, not its end."""
    gap = F.unix_micros(end) - F.unix_micros(ts)
    return (F.ceil(gap / F.lit(seconds * 1_000_000)) - 1).cast("long")


def dependency_metrics(buckets: DataFrame) -> DataFrame:
    """Calls, failures and time by (source, target, target_type); a null type is a group, empty ends are skipped."""
    rows = buckets.where((F.coalesce("source", F.lit("")) != "") & (F.coalesce("target", F.lit("")) != ""))
    failed = F.sum(F.when(F.col("outcome") == "failure", F.col("calls")).otherwise(0))
    out = rows.groupBy("source", "target", "target_type").agg(F.sum("calls").alias("calls"), failed.alias("failure_calls"), F.sum("duration_us").cast("double").alias("duration_us"))
    return out.withColumn("error_rate", E.ratio(F.col("failure_calls"), F.col("calls"))).withColumn("average_ms", E.average_ms(F.col("duration_us"), F.col("calls")))


def rounded(df: DataFrame) -> DataFrame:
    """Rates to six and times to three decimals, half to even on the decimal value."""
    return df.withColumns({c: F.bround(c, 6 if c.endswith(("rate", "coverage")) else 3) for c, kind in df.dtypes if kind == "double" and c.endswith(("rate", "coverage", "_ms"))})


def digest_order() -> list[Column]:
    return [F.col("calls").desc(), F.col("source"), F.col("target"), F.col("target_type").asc_nulls_first()]


def dependency_order() -> list[Column]:
    return [F.coalesce("average_ms", F.lit(0.0)).desc(), F.col("calls").desc(), F.col("source"), F.col("target"), F.col("target_type").asc_nulls_first()]


def latency_order(names: list[str]) -> list[Column]:
    return [F.coalesce("p95_ms", F.lit(0.0)).desc(), F.coalesce("error_rate", F.lit(0.0)).desc(), F.col("calls").desc(), *(F.col(c).asc_nulls_first() for c in names)]


def top(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    return df.orderBy(*order).limit(limit)


def hourly_latency(rows: DataFrame, keys: list[str], window: Column, exact: bool = True) -> DataFrame:
    """One bucket for each window and key, with its own p95."""
    p95 = F.percentile("duration_us", 0.95) if exact else F.percentile_approx("duration_us", 0.95, 10_000)
    known, success = F.sum(F.col("known").cast("long")), F.sum(F.col("success").cast("long"))
    return rows.groupBy(window.alias("window"), *keys).agg(F.sum("calls").alias("calls"), F.sum("duration_us").cast("double").alias("duration_us"), p95.cast("double").alias("p95_us"), known.alias("known_calls"), success.alias("success_calls"))


def merged_latency(buckets: DataFrame, keys: list[str]) -> DataFrame:
    """Windows added up; the p95 is the largest of the windows, never computed anew."""
    added = buckets.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("calls", "known_calls", "success_calls")), F.sum(F.col("duration_us").cast("decimal(38,6)")).cast("double").alias("duration_us"), F.max("p95_us").alias("p95_us"))
    return derived_latency(added)


def derived_latency(df: DataFrame) -> DataFrame:
    failures = F.greatest(F.lit(0), F.col("known_calls") - F.col("success_calls"))
    return (
        df.withColumn("failure_calls", failures)
        .withColumn("error_rate", E.ratio(F.col("failure_calls"), F.col("known_calls")))
        .withColumn("outcome_coverage", E.ratio(F.col("known_calls"), F.col("calls")))
        .withColumn("average_ms", E.average_ms(F.col("duration_us"), F.col("calls")))
        .withColumn("p95_ms", F.col("p95_us") / 1000)
    )


def transaction_rollup(latency: DataFrame, label: Column, kind: Column) -> DataFrame:
    """Operations of a service under one safe label: time is rebuilt from the averages, p95 is the largest."""
    rows = latency.withColumn("label", label).withColumn("kind", kind)
    time = F.sum((F.col("average_ms") * F.col("calls") * 1000).cast("decimal(38,3)")).cast("double")
    added = rows.groupBy("service", "label", "kind").agg(*(F.sum(c).alias(c) for c in ("calls", "known_calls", "success_calls")), time.alias("duration_us"), F.max("p95_us").alias("p95_us"), F.count("*").alias("operation_count"))
    return derived_latency(added)


def outcome_summary(latency: DataFrame) -> DataFrame:
    """Totals over services: failure rate of known outcomes, and how many are known."""
    out = latency.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("calls", "known_calls", "failure_calls")))
    return out.withColumn("failure_rate", E.ratio(F.col("failure_calls"), F.col("known_calls"))).withColumn("coverage", E.ratio(F.col("known_calls"), F.col("calls")))


def coverage_envelope(df: DataFrame, limit: int, capped: Column | None = None) -> DataFrame:
    """How many were seen and exported, and why the rest was not; absence and truncation differ."""
    seen = df.agg(F.count("*").alias("seen"))
    reasons = [F.when(F.col("seen") > limit, F.lit("limit"))] + ([] if capped is None else [F.when(capped, F.lit("bucket_cap"))])
    return seen.withColumn("exported", F.least("seen", F.lit(limit))).withColumn("truncated", F.col("seen") > limit).withColumn("reasons", F.array_join(F.array_compact(F.array(*reasons)), ","))


def capped_newest_first(buckets: DataFrame, cap: int, keys: list[str]) -> DataFrame:
    """The first ``cap`` buckets, newest window (lowest number) first; only the cap's rows are sorted to one place."""
    return buckets.orderBy("window", *keys).limit(cap)


def byte_budget(df: DataFrame, order: list[Column], max_bytes: int = MAX_BYTES, max_relations: int = MAX_RELATIONS) -> tuple[list[dict], bool]:
    """The longest prefix of at most ``max_relations`` rows whose compact JSON document, with its truncation mark, fits."""
    rows = [json.loads(r["j"]) for r in df.orderBy(*order).limit(max_relations + 1).select(F.to_json(F.struct("*")).alias("j")).collect()]

    def size(n: int) -> int:
        return len(json.dumps({"relations": rows[:n], "truncated": n < len(rows)}, separators=(",", ":"), ensure_ascii=False).encode())

    if size(0) > max_bytes:
        raise ValueError("the document without rows exceeds the budget")
    n = min(len(rows), max_relations)
    while n and size(n) > max_bytes:
        n -= 1
    return rows[:n], n < len(rows)


def byte_budget_rows(df: DataFrame, order: list[Column], max_bytes: int, limit: int = MAX_RELATIONS) -> DataFrame:
    """The same cut on rows alone, by a running sum of their JSON sizes over at most ``limit`` rows."""
    rows = df.orderBy(*order).limit(limit).withColumn("bytes", F.octet_length(F.to_json(F.struct(*df.columns))))
    running = F.sum("bytes").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("bytes_until", running).where(F.col("bytes_until") <= max_bytes)


def triage(services: DataFrame, transactions: DataFrame, dependencies: DataFrame, limit: int = 3) -> DataFrame:
    """What to look at first: calls times error rate times 1000, plus time times log10 of calls."""
    def of(df: DataFrame, kind: str, name: Column, time: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), name.alias("name"), "calls", "error_rate", time.alias("time_ms"))

    rows = of(services, "service", F.col("service"), F.col("p95_ms"))
    rows = rows.union(of(transactions, "transaction", F.concat_ws(" ", "service", "label"), F.col("p95_ms")))
    rows = rows.union(of(dependencies, "dependency", F.concat_ws(" -> ", "source", "target", "target_type"), F.col("average_ms")))
    score = F.col("calls") * F.coalesce("error_rate", F.lit(0.0)) * 1000 + F.coalesce("time_ms", F.lit(0.0)) * F.log10(F.greatest(F.lit(1), "calls"))
    return rows.withColumn("score", score).orderBy(F.col("score").desc(), "kind", "name").limit(limit)


def anomalies(services: DataFrame, dependencies: DataFrame, least_rate: float, limit: int = 5, traces: DataFrame | None = None, coverage: DataFrame | None = None) -> DataFrame:
    """Candidates in order of their kind, then of their rate: services, dependencies, failed traces (trace_id, failures, spans),
    and coverage that was cut (what, truncated)."""
    one = services.where(F.col("error_rate") >= least_rate).select(F.lit(0).alias("priority"), F.lit("service").alias("kind"), F.col("service").alias("name"), "error_rate")
    two = dependencies.where(F.col("error_rate") >= least_rate).select(F.lit(1).alias("priority"), F.lit("dependency").alias("kind"), F.concat_ws(" -> ", "source", "target", "target_type").alias("name"), "error_rate")
    both = one.union(two)
    if traces is not None:
        both = both.union(traces.where("failures > 0").select(F.lit(2), F.lit("trace"), F.col("trace_id").cast("string"), E.ratio(F.col("failures"), F.col("spans"))))
    if coverage is not None:
        both = both.union(coverage.where("truncated").select(F.lit(3), F.lit("coverage"), "what", F.lit(None).cast("double")))
    return both.orderBy("priority", F.col("error_rate").desc(), "name").limit(limit)


def hotspots(dependencies: DataFrame) -> DataFrame:
    """Dependencies with errors, or nearly as slow as the slowest."""
    slowest = dependencies.agg(F.max("average_ms").alias("slowest"))
    return dependencies.crossJoin(F.broadcast(slowest)).where((F.col("error_rate") > 0) | (F.col("average_ms") >= 0.7 * F.col("slowest"))).drop("slowest")  # one row is broadcast


def running(df: DataFrame, by: list[str], order: list[str], weight: Column, name: str) -> DataFrame:
    """The sum of weights of all rows of a group up to each row, in a total order. Rows are dealt by ranges of that order, so
    a group of any size spreads over tasks: each range has its own running sum, and begins at the sum of the ranges before."""
    ranged = checkpointed(df.withColumn("_w", weight).repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()))
    sums = ranged.groupBy("_p", *by).agg(F.sum("_w").alias("_s"))
    before = sums.withColumn("_b", F.coalesce(F.sum("_s").over(W.partitionBy(*by).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_s")  # a row a range
    out = ranged.withColumn(name, F.sum("_w").over(W.partitionBy("_p", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    same = out["_p"] == before["_p"]
    for c in by:
        same = same & out[c].eqNullSafe(before[c])
    return out.join(before, same).select(*(out[c] for c in df.columns), (out[name] + before["_b"]).cast("long").alias(name))


def soft_terciles(df: DataFrame, score: str, key: str, kind: str) -> DataFrame:
    """Three tiers for each kind, sizes differing by one at most, the larger ones first: tier, rank, population and the tier's
    first and last rank."""
    sizes = df.groupBy(kind).agg(F.count("*").alias("population"))
    ranked = running(df, [kind], [score, key], F.lit(1), "rank")
    ranked = ranked.join(sizes, ranked[kind].eqNullSafe(sizes[kind])).drop(sizes[kind])
    small, more = F.floor(F.col("population") / 3), F.col("population") % 3
    large = more * (small + 1)
    tier = F.when(F.col("rank") <= large, F.ceil(F.col("rank") / (small + 1))).otherwise(more + F.ceil((F.col("rank") - large) / F.greatest(small, F.lit(1))))
    last = F.col("tier") * small + F.least("tier", more)
    return ranked.withColumn("tier", tier.cast("int")).withColumn("tier_last", last.cast("int")).withColumn("tier_first", (F.col("tier_last") - small - F.when(F.col("tier") <= more, 1).otherwise(0) + 1).cast("int")).withColumn("rank", F.col("rank").cast("int"))


def volume_levels(df: DataFrame, value: str = "calls") -> DataFrame:
    """low, medium or high by how many values are at most as large; equal values share a level. Values are counted first, so
    the ordered pass sees each distinct value once."""
    counts = running(df.groupBy(value).agg(F.count("*").alias("n")), [], [value], F.col("n"), "volume_rank")
    total = F.broadcast(df.agg(F.count("*").alias("_total")))  # one row
    third, rank = F.greatest(F.lit(1.0), F.col("_total") / 3), F.col("volume_rank")
    level = F.when(rank <= third, "low").when(rank <= 2 * third, "medium").otherwise("high")
    return df.join(counts.crossJoin(total).select(value, "volume_rank", level.alias("level")), value)


def floor_percentile(values: Column, q: float) -> Column:
    """The sorted value at floor((n - 1) * q)."""
    return E.let(F.array_sort(F.collect_list(values)), lambda s: F.get(s, F.floor((F.size(s) - 1) * q).cast("int")))


def duration_impact(rows: DataFrame, group: list[str]) -> DataFrame:
    """Total time of each row's group, and rows ordered by it."""
    total = F.sum("duration_us").over(W.partitionBy(*group))
    return rows.withColumn("group_duration_us", total)


def whole_query_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """All rows of the first input, or of the second where the first has none at all."""
    return fallback if primary.isEmpty() else primary
