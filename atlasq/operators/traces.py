"""Trace projection: selection, span trees, waterfalls, failures and redaction.

Spans have ``trace_id, span_id, parent_id, service, ts, duration_us, outcome`` and label fields. Depth is found by parent
joins in rounds, at most MAX_DEPTH, so cycles in the data end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: deeper spans count as this deep.
MAX_DEPTH = 20


def multi_service_traces(spans: DataFrame, window: Column, cap: int | None = None) -> DataFrame:
    """Traces with more than one service within a window, newest window first, latest first within it."""
    found = spans.groupBy(window.alias("window"), "trace_id").agg(F.countDistinct("service").alias("services"), F.max("ts").alias("latest")).where("services > 1")
    best = found.groupBy("trace_id").agg(F.min(F.struct("window", (-F.col("latest")).alias("o"), "services", "latest")).alias("b")).select("trace_id", F.col("b.window").alias("window"), F.col("b.services").alias("services"), F.col("b.latest").alias("latest"))
    return best if cap is None else best.orderBy("window", F.col("latest").desc(), "trace_id").limit(cap)


def spans_of(spans: DataFrame, traces: DataFrame) -> DataFrame:
    return spans.join(traces.select("trace_id"), "trace_id", "left_semi")


def capped_spans(spans: DataFrame, cap: int) -> DataFrame:
    """The earliest ``cap`` spans of each trace, with the trace's size and whether it was cut."""
    order = W.partitionBy("trace_id").orderBy("ts", "span_id")
    sized = spans.withColumn("step", F.row_number().over(order)).withColumn("trace_size", F.count("*").over(W.partitionBy("trace_id")))
    return sized.where(F.col("step") <= cap).withColumn("truncated", F.col("trace_size") > cap)


def one_parent(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, parent_id) once for each span: repeated rows are one, of several parents the lowest counts, and rows
    without a span id are none."""
    return spans.where("span_id IS NOT NULL").groupBy("trace_id", "span_id").agg(F.min("parent_id").alias("parent_id"))


def span_depth(spans: DataFrame) -> DataFrame:
    """depth of each span: 0 where the parent is absent. One join a round, for as many rounds as the deepest tree has,
    MAX_DEPTH at most."""
    nodes = one_parent(spans)
    known = nodes.select("trace_id", F.col("span_id").alias("parent_id"))
    linked = nodes.join(known.distinct(), ["trace_id", "parent_id"])
    link = linked.select("trace_id", F.col("span_id").alias("child"), F.col("parent_id").alias("above"))
    depth = nodes.select("trace_id", "span_id").distinct().withColumn("depth", F.lit(0)).withColumn("at", F.col("span_id"))
    for _ in range(MAX_DEPTH):
        step = depth.join(link, (depth["trace_id"] == link["trace_id"]) & (depth["at"] == link["child"]), "left")
        depth = step.select(depth["trace_id"], "span_id", F.when(F.col("above").isNotNull(), F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"), F.col("above").alias("at"))
    return depth.select("trace_id", "span_id", "depth")


def span_depth_by_paths(spans: DataFrame) -> DataFrame:
    """The same by one grouping: a trace's spans are one row, and each climbs its parents inside it. For traces of bounded
    size, as after ``capped_spans``."""
    tree = one_parent(spans).groupBy("trace_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("span_id", "parent_id")))).alias("parents"))
    climbed = F.transform(
        F.map_keys("parents"),
        lambda span: F.struct(
            span.alias("span_id"),
            F.aggregate(
                F.sequence(F.lit(1), F.lit(MAX_DEPTH)),
                F.struct(span.alias("at"), F.lit(0).alias("depth")),
                lambda s, _: F.when(F.map_contains_key("parents", F.coalesce(F.element_at("parents", s["at"]), F.lit(-1))), F.struct(F.element_at("parents", s["at"]).alias("at"), (s["depth"] + 1).alias("depth"))).otherwise(s),
                lambda s: s["depth"],
            ).alias("depth"),
        ),
    )
    return tree.select("trace_id", F.explode(climbed).alias("x")).select("trace_id", "x.span_id", "x.depth")


def waterfall(spans: DataFrame) -> DataFrame:
    """One row for each trace: root service, offsets from the root's start, total time, ordered route, failures.

    The root is the first span whose parent is absent; the trace lasts as long as its root, or else until its last span ends.
    """
    order = W.partitionBy("trace_id").orderBy("ts", "span_id")
    ids = spans.select("trace_id", F.col("span_id").alias("parent_id")).distinct().withColumn("has_parent", F.lit(True))
    rows = spans.join(ids, ["trace_id", "parent_id"], "left").withColumn("is_root", F.col("has_parent").isNull())
    first_root = F.min(F.when(F.col("is_root"), F.struct("ts", "span_id", "service", "duration_us"))).over(W.partitionBy("trace_id"))
    rows = rows.withColumn("root", F.coalesce(first_root, F.first(F.struct("ts", "span_id", "service", "duration_us")).over(order)))
    rows = rows.withColumn("offset_us", F.greatest(F.lit(0), F.col("ts") - F.col("root.ts")))
    route = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ts", "span_id", "service"))), lambda x: x["service"])), ">")
    out = rows.groupBy("trace_id").agg(
        F.first("root.service").alias("root_service"), F.count("*").alias("spans"), F.countDistinct("service").alias("services"),
        F.sum(F.when(F.col("outcome") == "failure", 1).otherwise(0)).alias("failures"),
        F.coalesce(F.first("root.duration_us"), F.max(F.col("offset_us") + F.col("duration_us"))).alias("duration_us"), F.max(F.col("offset_us") + F.col("duration_us")).alias("end_us"), route.alias("route"),
    )
    return out


def numbered(traces: DataFrame, order: list[Column], prefix: str = "waterfall-") -> DataFrame:
    """Opaque references in a stable order, for the bounded set of exported traces."""
    return traces.withColumn("ref", F.concat(F.lit(prefix), F.row_number().over(W.orderBy(*order))))


def without_ids(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """References in place of trace and span ids."""
    return rows.join(refs.select("trace_id", "ref"), "trace_id").drop("trace_id", "span_id", "parent_id")


def slow_spans(spans: DataFrame, by: list[str], q: float = 0.95) -> DataFrame:
    """Spans at least as long as the q-percentile of their group: the sorted duration at floor((n - 1) q), found from the
    counts of durations, not from a list of them."""
    counts = spans.groupBy(*by, "duration_us").agg(F.count("*").alias("n"))
    order = W.partitionBy(*by).orderBy("duration_us")
    until = F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("n").over(W.partitionBy(*by))
    bound = counts.withColumn("until", until).withColumn("total", total).where(F.col("until") > F.floor((F.col("total") - 1) * q)).groupBy(*by).agg(F.min("duration_us").alias("bound"))
    return spans.join(bound, by).where(F.col("duration_us") >= F.col("bound"))


def failure_matrix(spans: DataFrame, steps: list[int]) -> DataFrame:
    """Failures by service and step in the trace, one column a step."""
    order = W.partitionBy("trace_id").orderBy("ts", "span_id")
    rows = spans.withColumn("step", F.row_number().over(order)).where(F.col("outcome") == "failure")
    cells = [F.sum(F.when(F.col("step") == k, 1).otherwise(0)).alias(f"step_{k}") for k in steps]
    return rows.groupBy("service").agg(*cells, F.count("*").alias("failures"))


def failure_signatures(spans: DataFrame, category: Column, limit: int | None = None) -> DataFrame:
    """Failures by service and category, with the longest as exemplar."""
    rows = spans.where(F.col("outcome") == "failure").withColumn("category", category)
    longest = F.max(F.struct("duration_us", "trace_id", "span_id"))
    out = rows.groupBy("service", "category").agg(F.count("*").alias("failures"), longest.alias("x"))
    out = out.select("service", "category", "failures", F.col("x.trace_id").alias("trace_id"), F.col("x.span_id").alias("span_id"), F.col("x.duration_us").alias("duration_us"))
    return out if limit is None else out.orderBy(F.col("failures").desc(), "service", "category").limit(limit)


def span_events(rows: DataFrame) -> DataFrame:
    """Rows of spans: by their kind, or because they name an operation in either layout."""
    return rows.where((F.col("event") == "span") | F.col("span_name").isNotNull() | F.col("name").isNotNull())


def coalesced(rows: DataFrame) -> DataFrame:
    """One layout for spans of both: id, parent, name and microseconds, where the second layout has nanoseconds. Rows without
    id, time, service or name go."""
    def first(*names: str) -> Column:
        return F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names))

    time = F.coalesce("transaction_duration_us", "span_duration_us", F.col("duration") / 1000)
    out = rows.select("trace_id", first("span_id", "native_span_id").alias("span_id"), first("parent_id", "native_parent_id").alias("parent_id"), "service", "ts", first("transaction_name", "span_name", "name").alias("name"), time.alias("duration_us"), "outcome")
    return out.where("span_id IS NOT NULL AND ts IS NOT NULL AND service IS NOT NULL AND name IS NOT NULL")


def trace_order(traces: DataFrame) -> list[Column]:
    """By source kind, then the source's name in any case, then time."""
    rank = F.when(traces["source_kind"] == "http_service", 0).when(traces["source_kind"] == "topic", 1).when(traces["source_kind"] == "service", 2).otherwise(3)
    return [rank, F.lower(traces["source"]), traces["ts"]]


def timeline(spans: DataFrame, traces: DataFrame | None, cap: int) -> DataFrame:
    """Spans of the selected traces (all without a selection) in time, ``cap`` at most."""
    return (spans if traces is None else spans_of(spans, traces)).orderBy("ts", "trace_id", "span_id").limit(cap)


def shown(rows: DataFrame) -> DataFrame:
    """The second redaction: labels, kinds and categories once more through their allowlists, whatever came before."""
    from ..functions import expr as E

    label = F.when(F.col("label").rlike(E.LABEL_TOPIC) | (F.split_part("label", F.lit(" "), F.lit(1)).isin(*E.LABEL_METHODS) & F.split_part("label", F.lit(" "), F.lit(2)).rlike(E.LABEL_ROUTE)), F.col("label"))
    return rows.withColumns({"label": label, "span_type": E.span_type(F.col("span_type")), "error": F.when(F.col("error").isin(*E.ERROR_MARKS, "failure"), F.col("error"))})


def embedded(json: Column) -> Column:
    """JSON that may stand inside a script element."""
    return F.replace(json, F.lit("</"), F.lit("<\\/"))


def contributions(spans: DataFrame) -> DataFrame:
    """Time of each service within a trace."""
    return spans.groupBy("trace_id", "service").agg(F.sum("duration_us").alias("duration_us"))


def longest_then_chronological(spans: DataFrame, n: int = 10) -> DataFrame:
    return spans.orderBy(F.col("duration_us").desc(), "trace_id", "span_id").limit(n).orderBy("ts", "trace_id", "span_id")


def source_kind(spans: DataFrame) -> DataFrame:
    """topic where a messaging transaction's parent publishes, else http_service where one has a method, else service."""
    parent = spans.select("trace_id", F.col("span_id").alias("parent_id"), F.col("name").alias("parent_name"))
    rows = spans.join(parent, ["trace_id", "parent_id"], "left")
    topic = F.bool_or((F.col("kind") == "messaging") & F.col("parent_name").endswith(" publish"))
    http = F.bool_or(F.col("method").isNotNull())
    return rows.groupBy("trace_id").agg(F.when(F.coalesce(topic, F.lit(False)), "topic").when(F.coalesce(http, F.lit(False)), "http_service").otherwise("service").alias("source_kind"))
