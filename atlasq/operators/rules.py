"""Audit rules and issue lists over endpoints, edges and modules: (rule, severity, subject, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from .graph import two_way_pairs

COLUMNS = ["rule", "severity", "subject", "detail"]


def _found(df: DataFrame, rule: str, severity: str, subject: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def dynamic_topics(endpoints: DataFrame) -> DataFrame:
    rows = endpoints.where(F.col("role").isin("produce", "consume") & F.col("topic_dynamic"))
    return _found(rows, "dynamic-kafka-topic", "WARNING", F.col("system"), F.col("id"))


def dynamic_targets(endpoints: DataFrame) -> DataFrame:
    rows = endpoints.where((F.col("role") == "call") & F.col("topic").endswith(" " + E.DYNAMIC))
    return _found(rows, "dynamic-http-target", "WARNING", F.col("system"), F.col("id"))


def orphan_producers(endpoints: DataFrame, edges: DataFrame) -> DataFrame:
    """Services that publish a static topic which no other service consumes from them."""
    made = endpoints.where((F.col("role") == "produce") & ~F.col("topic_dynamic")).select(F.col("system").alias("source"), "topic").distinct()
    return _found(made.join(edges.select("source", "topic").distinct(), ["source", "topic"], "left_anti"), "orphan-kafka-producer", "WARNING", F.col("source"), F.col("topic"))


def orphan_consumers(endpoints: DataFrame, edges: DataFrame) -> DataFrame:
    used = endpoints.where((F.col("role") == "consume") & ~F.col("topic_dynamic")).select(F.col("system").alias("target"), "topic").distinct()
    return _found(used.join(edges.select("target", "topic").distinct(), ["target", "topic"], "left_anti"), "orphan-kafka-consumer", "WARNING", F.col("target"), F.col("topic"))


def topic_types(endpoints: DataFrame) -> DataFrame:
    """(topic, produced, consumed, producers, consumers): sorted sets of message types, and how many sites there are."""
    side = {"produced": "produce", "consumed": "consume"}
    sets = [F.sort_array(F.collect_set(F.when(F.col("role") == role, F.col("message_type")))).alias(name) for name, role in side.items()]
    counts = [F.sum(F.when(F.col("role") == role, 1).otherwise(0)).alias(name) for name, role in (("producers", "produce"), ("consumers", "consume"))]
    return endpoints.where(F.col("role").isin("produce", "consume") & ~F.col("topic_dynamic")).groupBy("topic").agg(*sets, *counts)


def contract_mismatch(endpoints: DataFrame) -> DataFrame:
    """Both sides typed and unequal."""
    rows = topic_types(endpoints).where((F.size("produced") > 0) & (F.size("consumed") > 0) & (F.col("produced") != F.col("consumed")))
    return _found(rows, "kafka-message-contract-mismatch", "WARNING", F.col("topic"), F.concat_ws(" / ", F.array_join("produced", ","), F.array_join("consumed", ",")))


def contract_unknown(endpoints: DataFrame) -> DataFrame:
    """Producers and consumers, one side of them untyped."""
    rows = topic_types(endpoints).where((F.col("producers") > 0) & (F.col("consumers") > 0) & ((F.size("produced") == 0) | (F.size("consumed") == 0)))
    return _found(rows, "kafka-message-contract-unknown", "INFO", F.col("topic"), F.concat_ws(" / ", F.array_join("produced", ","), F.array_join("consumed", ",")))


def rest_cycles(edges: DataFrame) -> DataFrame:
    return _found(two_way_pairs(edges), "synchronous-rest-cycle", "ERROR", F.col("source"), F.col("target"))


def idle_modules(modules: DataFrame, activity: DataFrame) -> DataFrame:
    """Modules that start no application, are no aggregators, and still have runtime responsibilities."""
    rows = modules.where(~F.col("starts_application") & (F.col("kind") != "aggregator")).join(activity.select(F.col("module").alias("name")).distinct(), "name", "left_semi")
    return _found(rows, "non-runtime-module-activity", "WARNING", F.col("name"), F.col("path"))


def http_in_consumers(calls_inside: DataFrame) -> DataFrame:
    """calls_inside: what ``resolve.inside_ranges`` finds of REST calls within consumer lines."""
    return _found(calls_inside, "synchronous-http-in-kafka-consumer", "WARNING", F.col("system"), F.col("id"))


def orphan_integrations(summary: DataFrame, sides: tuple[str, str]) -> DataFrame:
    """Topics or APIs that lack one side; both sides in one service count as present. summary: (name, and an array a side)."""
    a, b = sides
    missing = F.when(F.size(a) == 0, a).when(F.size(b) == 0, b)
    return summary.withColumn("missing", missing).where("missing IS NOT NULL").select("name", "missing")


def issues(parts: list[DataFrame]) -> DataFrame:
    """All issues: the more severe first, then by rule and text."""
    out = parts[0].select(COLUMNS)
    for part in parts[1:]:
        out = out.unionByName(part.select(COLUMNS))
    return out.orderBy(E.severity_rank(F.col("severity")).desc(), "rule", "subject", "detail")


def issue_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("rule", "severity").agg(F.count("*").alias("n"))


def unmatched_calls(calls: DataFrame, edges: DataFrame) -> DataFrame:
    return _found(calls.join(edges.select(F.col("call_id").alias("id")).distinct(), "id", "left_anti"), "unmatched_http_call", "INFO", F.col("system"), F.col("id"))


def missing_columns(df: DataFrame, required: dict[str, str]) -> list[str]:
    """Report schema check: required columns that are absent or of another type."""
    kinds = dict(df.dtypes)
    return sorted(c for c, kind in required.items() if not kinds.get(c, "").startswith(kind))
