"""Queries over the testbed, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import catalog, graph, incremental, resolve, rules, search, telemetry, traces
from . import testbed as T
from .testbed import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


_DEP = "source, target, target_type, calls, failure_calls, duration_us, error_rate, average_ms"
_LAT_SUMS = "count(*) AS calls, sum(CAST(known AS BIGINT)) AS known_calls, sum(CAST(success AS BIGINT)) AS success_calls"
_LAT_DERIVED = "calls, known_calls, success_calls, duration_us, p95_us, greatest(0, known_calls - success_calls) AS failure_calls, CAST(greatest(0, known_calls - success_calls) AS DOUBLE) / nullif(known_calls, 0) AS error_rate, CAST(known_calls AS DOUBLE) / nullif(calls, 0) AS outcome_coverage, duration_us / (CAST(calls AS DOUBLE) * 1000) AS average_ms, p95_us / 1000 AS p95_ms"


def _hours(keys: str) -> str:
    return f"SELECT {keys}, w, {_LAT_SUMS}, CAST(sum(duration_us) AS DOUBLE) AS duration_us, quantile_cont(CAST(duration_us AS DOUBLE), 0.95) AS p95_us FROM lat GROUP BY ALL"


def _merged(keys: str) -> str:
    return f"SELECT {keys}, {_LAT_DERIVED} FROM (SELECT {keys}, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(known_calls) AS BIGINT) AS known_calls, CAST(sum(success_calls) AS BIGINT) AS success_calls, CAST(sum(CAST(duration_us AS DECIMAL(38,6))) AS DOUBLE) AS duration_us, max(p95_us) AS p95_us FROM hours GROUP BY {keys})"


def _latency(spark: SparkSession, d: str, keys: list[str]) -> DataFrame:
    rows = T.latency_rows(spark, d)
    return telemetry.merged_latency(telemetry.hourly_latency(rows, keys, T.window_number(F.col("ts"))), keys)


@query(with_views(f"SELECT {_DEP} FROM depm", "depm"))
def dep_relations(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.dependency_metrics(T.dependency_buckets(spark, d))


@query(with_views(f"SELECT {_DEP} FROM depm ORDER BY calls DESC, source, target, target_type NULLS FIRST LIMIT 80", "depm"))
def dep_topk(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.top(dep_relations(spark, d), telemetry.digest_order(), telemetry.MAX_RELATIONS)


@query(with_views(f"SELECT {_DEP} FROM depm ORDER BY coalesce(average_ms, 0) DESC, calls DESC, source, target, target_type NULLS FIRST LIMIT 80", "depm"))
def dep_report_order(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.top(dep_relations(spark, d), telemetry.dependency_order(), telemetry.VIEW_LIMITS["dependencies"])


@query(with_views("SELECT w AS \"window\", service, calls, CAST(duration_us AS DOUBLE) AS duration_us, p95_us, CAST(known_calls AS BIGINT) AS known_calls, CAST(success_calls AS BIGINT) AS success_calls FROM hours", "lat", hours=_hours("service")))
def latency_hourly(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.hourly_latency(T.latency_rows(spark, d), ["service"], T.window_number(F.col("ts")))


@query(with_views(_merged("service"), "lat", hours=_hours("service")))
def latency_service(spark: SparkSession, d: str) -> DataFrame:
    return _latency(spark, d, ["service"])


@query(with_views(_merged("service, transaction"), "lat", hours=_hours("service, transaction")))
def latency_transaction(spark: SparkSession, d: str) -> DataFrame:
    return _latency(spark, d, ["service", "transaction"])


@query(with_views("SELECT CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(known_calls) AS BIGINT) AS known_calls, CAST(sum(failure_calls) AS BIGINT) AS failure_calls, CAST(sum(failure_calls) AS DOUBLE) / sum(known_calls) AS failure_rate, CAST(sum(known_calls) AS DOUBLE) / sum(calls) AS coverage FROM merged", "lat", hours=_hours("service"), merged=_merged("service")))
def outcome_summary(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.outcome_summary(_latency(spark, d, ["service"]))


_LABEL = "CASE WHEN transaction IN ('view', 'click') THEN 'browse' ELSE 'act' END"


@query(with_views(f"SELECT service, label, 'other' AS kind, operation_count, {_LAT_DERIVED} FROM (SELECT service, {_LABEL} AS label, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(known_calls) AS BIGINT) AS known_calls, CAST(sum(success_calls) AS BIGINT) AS success_calls, CAST(sum(CAST(average_ms * calls * 1000 AS DECIMAL(38,3))) AS DOUBLE) AS duration_us, max(p95_us) AS p95_us, count(*) AS operation_count FROM merged GROUP BY ALL)", "lat", hours=_hours("service, transaction"), merged=_merged("service, transaction")))
def txn_rollup(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("transaction").isin("view", "click"), "browse").otherwise("act")
    return telemetry.transaction_rollup(_latency(spark, d, ["service", "transaction"]), label, E.transaction_kind(F.col("transaction")))


@query(with_views("SELECT count(*) AS seen, least(count(*), 80) AS exported, count(*) > 80 AS truncated, CASE WHEN count(*) > 80 THEN 'limit' ELSE '' END AS reasons FROM depm", "depm"))
def coverage_envelope(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.coverage_envelope(dep_relations(spark, d), telemetry.MAX_RELATIONS)


@query(with_views("SELECT service, w AS \"window\", calls FROM hours ORDER BY w, service LIMIT 500", "lat", hours=_hours("service")))
def newest_buckets(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.capped_newest_first(latency_hourly(spark, d), 500, ["service"]).select("service", "window", "calls")


_TXNS = f"WITH hours AS ({_hours('service, transaction')}), merged AS ({_merged('service, transaction')}) SELECT service, label, {_LAT_DERIVED} FROM (SELECT service, {_LABEL} AS label, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(known_calls) AS BIGINT) AS known_calls, CAST(sum(success_calls) AS BIGINT) AS success_calls, CAST(sum(CAST(average_ms * calls * 1000 AS DECIMAL(38,3))) AS DOUBLE) AS duration_us, max(p95_us) AS p95_us FROM merged GROUP BY ALL)"
_RANKED = "SELECT *, (SELECT count(*) FROM totals b WHERE b.calls <= a.calls) AS volume_rank, greatest(1, (SELECT count(*) FROM totals) / 3.0) AS third FROM totals a"


@query(with_views("SELECT source, target, calls, CAST(volume_rank AS BIGINT) AS volume_rank, CASE WHEN volume_rank <= third THEN 'low' WHEN volume_rank <= 2 * third THEN 'medium' ELSE 'high' END AS level FROM ranked", "trade", totals="SELECT source, target, count(*) AS calls FROM trade GROUP BY ALL", ranked=_RANKED))
def volume_tercile(spark: SparkSession, d: str) -> DataFrame:
    totals = T.trade(spark, d).groupBy("source", "target").agg(F.count("*").alias("calls"))
    return telemetry.volume_levels(totals).select("source", "target", "calls", "volume_rank", "level")


@query(with_views("SELECT *, min(rank) OVER (PARTITION BY kind, tier) AS tier_first, max(rank) OVER (PARTITION BY kind, tier) AS tier_last FROM (SELECT node, kind, degree, ntile(3) OVER o AS tier, row_number() OVER o AS rank, count(*) OVER (PARTITION BY kind) AS population FROM (SELECT topic AS node, role AS kind, count(*) AS degree FROM kafka GROUP BY ALL) WINDOW o AS (PARTITION BY kind ORDER BY degree, node))", "kafka"))
def complexity_tercile(spark: SparkSession, d: str) -> DataFrame:
    counts = T.topic_endpoints(spark, d).groupBy(F.col("topic").alias("node"), F.col("role").alias("kind")).agg(F.count("*").alias("degree"))
    return telemetry.soft_terciles(counts, "degree", "node", "kind").select("node", "kind", "degree", "tier", "rank", "population", "tier_first", "tier_last")


@query(with_views("SELECT * FROM (SELECT 'dependency' AS kind, source || ' -> ' || target || ' -> ' || target_type AS name, calls, error_rate, average_ms AS time_ms FROM depm UNION ALL SELECT 'service', service, calls, error_rate, p95_ms FROM merged UNION ALL SELECT 'transaction', service || ' ' || label, calls, error_rate, p95_ms FROM txns) ORDER BY calls * coalesce(error_rate, 0) * 1000 + coalesce(time_ms, 0) * log10(greatest(1, calls)) DESC, kind, name LIMIT 3", "depm", "lat", txns=_TXNS, hours=_hours("service"), merged=_merged("service")))
def triage_top(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.triage(_latency(spark, d, ["service"]), txn_rollup(spark, d), dep_relations(spark, d)).drop("score")


@query(with_views("SELECT priority, kind, name, error_rate FROM (SELECT 0 AS priority, 'service' AS kind, service AS name, error_rate FROM merged WHERE error_rate >= 0.2 UNION ALL SELECT 1, 'dependency', source || ' -> ' || target || ' -> ' || target_type, error_rate FROM depm WHERE error_rate >= 0.2 UNION ALL SELECT 2, 'trace', CAST(trace_id AS VARCHAR), count(*) FILTER (outcome = 'failure') / CAST(count(*) AS DOUBLE) FROM spans GROUP BY trace_id HAVING count(*) FILTER (outcome = 'failure') > 0 UNION ALL SELECT 3, 'coverage', 'dependencies', NULL FROM depm HAVING count(*) > 80) ORDER BY priority, error_rate DESC NULLS LAST, name LIMIT 2000", "depm", "lat", "spans", hours=_hours("service"), merged=_merged("service")))
def anomaly_candidates(spark: SparkSession, d: str) -> DataFrame:
    dependencies = dep_relations(spark, d)
    cut = telemetry.coverage_envelope(dependencies, telemetry.MAX_RELATIONS).select(F.lit("dependencies").alias("what"), "truncated")
    return telemetry.anomalies(_latency(spark, d, ["service"]), dependencies, 0.2, 2000, traces.waterfall(T.spans(spark, d)), cut)


@query(with_views(f"SELECT {_DEP} FROM depm WHERE error_rate > 0 OR average_ms >= 0.7 * (SELECT max(average_ms) FROM depm)", "depm"))
def hotspots(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.hotspots(dep_relations(spark, d))


@query(with_views("SELECT source, target, target_type, duration_us, CAST(sum(CAST(duration_us AS DECIMAL(38,2))) OVER (PARTITION BY source) AS DOUBLE) AS group_duration_us FROM depm", "depm"))
def duration_impact(spark: SparkSession, d: str) -> DataFrame:
    rows = dep_relations(spark, d).withColumn("duration_us", F.col("duration_us").cast("decimal(28,2)"))
    out = telemetry.duration_impact(rows, ["source"])
    return out.select("source", "target", "target_type", F.col("duration_us").cast("double").alias("duration_us"), F.col("group_duration_us").cast("double").alias("group_duration_us"))


_MATCH = "SELECT DISTINCT c.system AS source, s.system AS target, c.id AS call_id, s.id AS serve_id, s.topic AS topic, list_filter(string_split(split_part(substr(c.topic, 5), '?', 1), '/'), lambda x: x <> '') AS a, list_filter(string_split(split_part(substr(s.topic, 5), '?', 1), '/'), lambda x: x <> '') AS b FROM rest c JOIN rest s ON c.role = 'call' AND s.role = 'serve' AND lower(c.label) = rtrim(lower(s.system), '.') AND c.system <> s.system"
_ROUTE = "SELECT source, target, call_id, serve_id, topic FROM m WHERE len(a) > 0 AND len(a) = len(b) AND len(list_filter(list_zip(a, b), lambda z: z[1] = z[2] OR (z[1] LIKE '{%}') OR (z[2] LIKE '{%}'))) = len(a)"


@query(with_views(_ROUTE, "rest", m=_MATCH))
def route_match(spark: SparkSession, d: str) -> DataFrame:
    return resolve.rest_edges(T.rest_endpoints(spark, d), T.host_names(spark, d))


@query(with_views("SELECT system, id FROM rest WHERE role = 'call' AND id NOT IN (SELECT call_id FROM r)", "rest", m=_MATCH, r=_ROUTE))
def unmatched_calls(spark: SparkSession, d: str) -> DataFrame:
    endpoints = T.rest_endpoints(spark, d)
    found = rules.unmatched_calls(endpoints.where("role = 'call'"), resolve.matched_calls(endpoints, T.host_names(spark, d)))
    return found.select(F.col("subject").alias("system"), F.col("detail").cast("long").alias("id"))


@query(with_views("SELECT alias, min(service) AS service FROM (SELECT DISTINCT 'svc' || length(split_part(host, '.', 2)) AS service, lower(split_part(host, '.', 2)) AS alias FROM rest UNION SELECT DISTINCT 'svc' || length(split_part(host, '.', 2)), 'svc' || length(split_part(host, '.', 2)) FROM rest) WHERE alias <> '' GROUP BY alias HAVING count(DISTINCT service) = 1", "rest"))
def alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("snippet", r"^[a-z]+://([^/?#]+)", 1)
    second = F.split_part(host, F.lit("."), F.lit(2))
    return resolve.unique_aliases(T.rest_endpoints(spark, d).select(F.concat(F.lit("svc"), F.length(second).cast("string")).alias("service"), second.alias("alias")))


@query(with_views("SELECT source, target, topic FROM kafka_edges", "kafka_edges"))
def kafka_edges(spark: SparkSession, d: str) -> DataFrame:
    return resolve.topic_edges(T.topic_endpoints(spark, d))


@query(with_views("SELECT rule, severity, subject, detail FROM (SELECT DISTINCT 'orphan-kafka-producer' AS rule, 'WARNING' AS severity, system AS subject, topic AS detail FROM kafka k WHERE role = 'produce' AND NOT EXISTS (SELECT 1 FROM kafka_edges e WHERE e.source = k.system AND e.topic = k.topic) UNION ALL SELECT DISTINCT 'orphan-kafka-consumer', 'WARNING', system, topic FROM kafka k WHERE role = 'consume' AND NOT EXISTS (SELECT 1 FROM kafka_edges e WHERE e.target = k.system AND e.topic = k.topic))", "kafka_edges"))
def orphans(spark: SparkSession, d: str) -> DataFrame:
    endpoints = T.topic_endpoints(spark, d)
    edges = resolve.topic_edges(endpoints)
    return rules.orphan_producers(endpoints, edges).unionByName(rules.orphan_consumers(endpoints, edges))


_TYPES = "SELECT topic, coalesce(list_sort(list(DISTINCT message_type) FILTER (role = 'produce')), []) AS p, coalesce(list_sort(list(DISTINCT message_type) FILTER (role = 'consume')), []) AS c FROM kafka GROUP BY topic"


@query(with_views("SELECT 'kafka-message-contract-mismatch' AS rule, 'WARNING' AS severity, topic AS subject, array_to_string(p, ',') || ' / ' || array_to_string(c, ',') AS detail FROM t WHERE len(p) > 0 AND len(c) > 0 AND p <> c", "kafka", t=_TYPES))
def contract_mismatch(spark: SparkSession, d: str) -> DataFrame:
    return rules.contract_mismatch(T.topic_endpoints(spark, d))


@query(with_views("SELECT topic AS name, array_to_string(list_sort(list(DISTINCT system) FILTER (role = 'produce')), ',') AS produce, array_to_string(list_sort(list(DISTINCT system) FILTER (role = 'consume')), ',') AS consume FROM kafka GROUP BY topic", "kafka"))
def topic_summary(spark: SparkSession, d: str) -> DataFrame:
    out = catalog.summary_of(T.topic_endpoints(spark, d), ("produce", "consume"))
    return out.select("name", F.nullif(F.array_join("produce", ","), F.lit("")).alias("produce"), F.nullif(F.array_join("consume", ","), F.lit("")).alias("consume"))


@query(with_views("SELECT a.source, a.target FROM pairs a JOIN pairs b ON a.source = b.target AND a.target = b.source WHERE a.source < a.target", "pairs"))
def two_way_cycle(spark: SparkSession, d: str) -> DataFrame:
    return graph.two_way_pairs(T.all_edges(spark, d))


_REACH = "SELECT source, target FROM pairs UNION SELECT r.source, e.target FROM reach r JOIN pairs e ON r.target = e.source"


@query(with_views("SELECT source, target FROM reach", "pairs", recursive=True, reach=_REACH))
def closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(T.all_edges(spark, d))


@query(with_views("SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM (SELECT a.source AS node, least(a.source, min(a.target)) AS component FROM reach a JOIN reach b ON a.source = b.target AND a.target = b.source GROUP BY a.source)", "pairs", recursive=True, reach=_REACH))
def scc_cycles(spark: SparkSession, d: str) -> DataFrame:
    return graph.strong_components(T.all_edges(spark, d))


# Distances first, then only the ways along which they grow.
_LEVELS = "SELECT n_name AS start, n_name AS node, 0 AS d FROM nation WHERE n_name IN (SELECT source FROM pairs UNION SELECT target FROM pairs) UNION SELECT l.start, e.target, l.d + 1 FROM levels l JOIN pairs e ON e.source = l.node WHERE l.d < 12"
_WALK = "SELECT start, node, node AS path, 0 AS length FROM levels WHERE d = 0 UNION ALL SELECT w.start, e.target, w.path || ' -[]-> ' || e.target, w.length + 1 FROM walk w JOIN pairs e ON w.node = e.source JOIN dist ON dist.start = w.start AND dist.node = e.target AND dist.d = w.length + 1"


@query(with_views("SELECT start, node AS \"end\", length, path FROM walk", "pairs", recursive=True, levels=_LEVELS, dist="SELECT start, node, min(d) AS d FROM levels GROUP BY ALL", walk=_WALK))
def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    """From every node to every node."""
    edges = T.all_edges(spark, d)
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    return graph.shortest_paths(edges, nodes, nodes)


@query(with_views("SELECT source AS node, 'out' AS direction, 'rest' AS relation, target AS neighbour FROM pairs UNION SELECT target, 'in', 'rest', source FROM pairs", "pairs"))
def neighbors(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(T.all_edges(spark, d))


@query(with_views("SELECT node, count(*) AS degree, count(*) AS n_rest FROM (SELECT source AS node FROM pairs UNION ALL SELECT target FROM pairs) GROUP BY node", "pairs"))
def degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(T.all_edges(spark, d), ["rest"])


_FLOW = "SELECT topic, 1 AS depth, topic || ' > ' || system AS path, [system] AS services, system, false AS cycle_detected FROM uses UNION ALL SELECT f.topic, f.depth + 1, f.path || ' > ' || m.topic || ' > ' || u.system, list_append(f.services, u.system), u.system, list_contains(f.services, u.system) FROM flow f JOIN makes m ON m.system = f.system JOIN uses u ON u.topic = m.topic WHERE NOT f.cycle_detected AND f.depth < 2"


@query(with_views("SELECT topic, depth, path, cycle_detected FROM flow", "kafka", recursive=True, uses="SELECT DISTINCT topic, system FROM kafka WHERE role = 'consume'", makes="SELECT DISTINCT topic, system FROM kafka WHERE role = 'produce'", flow=_FLOW))
def flow_trace(spark: SparkSession, d: str) -> DataFrame:
    rows = T.topic_endpoints(spark, d)
    use, make = (rows.where(F.col("role") == role).select("topic", F.col("system").alias("service")) for role in ("consume", "produce"))
    return graph.flow_trace(use, make, use.select("topic").distinct(), max_depth=2)


@query(with_views("SELECT trace_id, w AS \"window\", services, latest FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY w, latest DESC) AS n FROM (SELECT trace_id, ts // 3600 AS w, count(DISTINCT service) AS services, max(ts) AS latest FROM spans GROUP BY ALL HAVING count(DISTINCT service) > 1)) WHERE n = 1", "spans"))
def multi_service_traces(spark: SparkSession, d: str) -> DataFrame:
    return traces.multi_service_traces(T.spans(spark, d), F.expr("ts div 3600"))


_DEPTHS = "SELECT trace_id, span_id, 0 AS depth FROM spans s WHERE NOT EXISTS (SELECT 1 FROM spans p WHERE p.trace_id = s.trace_id AND p.span_id = s.parent_id) UNION ALL SELECT s.trace_id, s.span_id, d.depth + 1 FROM depths d JOIN spans s ON s.trace_id = d.trace_id AND s.parent_id = d.span_id WHERE d.depth < 20"


@query(with_views("SELECT trace_id, span_id, depth FROM depths", "spans", recursive=True, depths=_DEPTHS))
def span_depth(spark: SparkSession, d: str) -> DataFrame:
    return traces.span_depth_by_paths(T.spans(spark, d))


@query(with_views("SELECT s.trace_id, r.service AS root_service, count(*) AS spans, count(DISTINCT s.service) AS services, count(*) FILTER (s.outcome = 'failure') AS failures, r.duration_us AS duration_us, max(greatest(0, s.ts - r.ts) + s.duration_us) AS end_us FROM spans s JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ts, span_id) AS n FROM spans) WHERE n = 1) r ON s.trace_id = r.trace_id GROUP BY ALL", "spans"))
def waterfall(spark: SparkSession, d: str) -> DataFrame:
    return traces.waterfall(T.spans(spark, d)).drop("route")


@query(with_views("SELECT trace_id, span_id, n AS step, size AS trace_size, size > 4 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ts, span_id) AS n, count(*) OVER (PARTITION BY trace_id) AS size FROM spans) WHERE n <= 4", "spans"))
def capped_spans(spark: SparkSession, d: str) -> DataFrame:
    return traces.capped_spans(T.spans(spark, d), 4).select("trace_id", "span_id", "step", "trace_size", "truncated")


@query(with_views("SELECT trace_id, span_id, s.service, duration_us, bound FROM spans s JOIN (SELECT service, list_sort(list(duration_us))[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1] AS bound FROM spans GROUP BY service) b ON s.service = b.service WHERE duration_us >= bound", "spans"))
def slow_spans(spark: SparkSession, d: str) -> DataFrame:
    return traces.slow_spans(T.spans(spark, d), ["service"]).select("trace_id", "span_id", "service", "duration_us", "bound")


_STEPS = range(1, 11)


@query(with_views(f"SELECT service, {', '.join(f'count(*) FILTER (n = {k}) AS step_{k}' for k in _STEPS)}, count(*) AS failures FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ts, span_id) AS n FROM spans) WHERE outcome = 'failure' GROUP BY service", "spans"))
def failure_matrix(spark: SparkSession, d: str) -> DataFrame:
    return traces.failure_matrix(T.spans(spark, d), list(_STEPS))


@query(with_views("SELECT service, category, n AS failures, x.trace_id AS trace_id, x.span_id AS span_id, x.duration_us AS duration_us FROM (SELECT service, name AS category, count(*) AS n, max({'duration_us': duration_us, 'trace_id': trace_id, 'span_id': span_id}) AS x FROM spans WHERE outcome = 'failure' GROUP BY ALL)", "spans"))
def failure_signatures(spark: SparkSession, d: str) -> DataFrame:
    return traces.failure_signatures(T.spans(spark, d), F.col("name"))


@query(with_views("SELECT trace_id, service, CAST(sum(duration_us) AS BIGINT) AS duration_us FROM spans GROUP BY ALL", "spans"))
def trace_contributions(spark: SparkSession, d: str) -> DataFrame:
    return traces.contributions(T.spans(spark, d))


@query(with_views("SELECT trace_id, span_id, ts, duration_us FROM spans ORDER BY duration_us DESC, trace_id, span_id LIMIT 10", "spans"))
def longest_spans(spark: SparkSession, d: str) -> DataFrame:
    return traces.longest_then_chronological(T.spans(spark, d)).select("trace_id", "span_id", "ts", "duration_us")


@query("SELECT doc_id, CASE WHEN text = '' THEN NULL WHEN contains(lower(text), 'timeout') THEN 'timeout' WHEN contains(lower(text), 'connect') THEN 'connection' WHEN contains(lower(text), 'valid') THEN 'validation' WHEN contains(lower(text), 'authoriz') OR contains(lower(text), 'forbidden') THEN 'authorization' WHEN contains(lower(text), 'throttl') OR contains(lower(text), 'rate') THEN 'throttling' ELSE 'failure' END AS category FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def error_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "documents").select("doc_id", E.error_category(F.col("text")).alias("category"))


_SCORE = "(CASE WHEN lower({c}) = 'worthless trash' THEN 8 WHEN contains(lower({c}), 'worthless trash') THEN 4 ELSE 0 END + CASE WHEN {p} = 'worthless trash' THEN 6 WHEN contains({p}, 'worthless trash') THEN 3 ELSE 0 END) * {w} + CASE WHEN list_contains({t}, 'worthless') THEN {w} ELSE 0 END + CASE WHEN list_contains({t}, 'trash') THEN {w} ELSE 0 END"
_FIELDS = {"rule_id": 6, "message": 4, "path": 3, "severity": 1}
_PARTS = {c: {"c": c, "w": w, "p": f"array_to_string(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+'), ' ')", "t": f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+')"} for c, w in _FIELDS.items()}
_EVERY = " AND ".join("(" + " OR ".join(f"list_contains({p['t']}, '{word}')" for p in _PARTS.values()) + ")" for word in ("worthless", "trash"))


@query(with_views(f"SELECT id, rule_id, path, severity, {' + '.join(_SCORE.format(**p) for p in _PARTS.values())} AS score FROM finding WHERE {_EVERY}", "finding"))
def lexical_search(spark: SparkSession, d: str) -> DataFrame:
    return search.search(T.findings(spark, d), "worthless trash").select("id", "rule_id", "path", "severity", "score")


@query(with_views("SELECT severity, count(*) AS n FROM finding GROUP BY severity", "finding"))
def findings_by_severity(spark: SparkSession, d: str) -> DataFrame:
    return search.summary(T.findings(spark, d))[0]


@query(with_views("SELECT rule_id, count(*) AS n FROM finding GROUP BY rule_id ORDER BY n DESC, rule_id LIMIT 10", "finding"))
def findings_top_rules(spark: SparkSession, d: str) -> DataFrame:
    return search.summary(T.findings(spark, d))[1]


@query(with_views("SELECT id, path, severity FROM finding WHERE severity IN ('WARNING', 'ERROR') AND path LIKE 'en/%1'", "finding"))
def findings_filter(spark: SparkSession, d: str) -> DataFrame:
    return search.filtered(T.findings(spark, d), least_severity="WARNING", path_glob="en/*1").select("id", "path", "severity")


@query(with_views("SELECT coalesce(p.path, c.path) AS path, CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'deleted' WHEN p.h = c.h THEN 'unchanged' ELSE 'modified' END AS status FROM prev p FULL JOIN cur c ON p.path = c.path", "prev", "cur"))
def hash_delta(spark: SparkSession, d: str) -> DataFrame:
    return incremental.hash_delta(*T.file_states(spark, d))


@query(with_views("SELECT path, h AS sha256 FROM prev WHERE path NOT IN (SELECT path FROM cur) UNION ALL SELECT path, h FROM cur", "prev", "cur"))
def replace_by_path(spark: SparkSession, d: str) -> DataFrame:
    before, now = T.file_states(spark, d)
    return incremental.replaced_by_path(before, now, now)


@query("SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS n FROM documents) WHERE n = 1")
def first_wins(spark: SparkSession, d: str) -> DataFrame:
    return incremental.first_wins(T.table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), ["source"], [F.col("n_chars"), F.col("doc_id")]).select("doc_id", "source", "lang")


@query(with_views("SELECT id, substr(sha256(role || '|' || topic || '|' || url || '|' || id || ':' || (id + 3)), 1, 16) AS stable_id FROM rest", "rest"))
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return T.rest_endpoints(spark, d).select("id", E.endpoint_id(F.col("role"), F.col("topic"), F.col("snippet"), F.col("id"), F.col("id") + 3).alias("stable_id"))


@query("SELECT p.event_id, r.o_orderkey FROM events p JOIN (SELECT o_orderkey, o_custkey % 150 AS user_id, o_orderkey % 20000 AS lo, o_orderkey % 20000 + 400 AS hi FROM orders) r ON p.user_id = r.user_id AND p.event_id BETWEEN r.lo AND r.hi")
def range_join(spark: SparkSession, d: str) -> DataFrame:
    points = T.table(spark, d, "events").select("event_id", "user_id")
    ranges = T.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("user_id"), (F.col("o_orderkey") % 20000).alias("lo"), (F.col("o_orderkey") % 20000 + 400).alias("hi"))
    return resolve.inside_ranges(points, ranges, ["user_id"], "event_id", "lo", "hi", 400).select("event_id", "o_orderkey")


@query(with_views("SELECT url AS path, (SELECT max_by(f, length(f)) FROM folders WHERE starts_with(substr(path, 2), f || '/') OR f = '') AS owner FROM raw_rest", "raw_rest", folders="SELECT DISTINCT split_part(path, '/', 2) AS f FROM raw_rest WHERE id % 3 = 0 UNION SELECT DISTINCT split_part(path, '/', 2) || '/' || split_part(path, '/', 3) FROM raw_rest WHERE id % 7 = 0"))
def nearest_ancestor(spark: SparkSession, d: str) -> DataFrame:
    pages = T.table(spark, d, "pages").select("page_id", "url", F.substring(E.rest_path(F.col("url")), 2, 1_000_000).alias("path"))
    parts = F.split("path", "/")
    one = pages.where("page_id % 3 = 0").select(F.get(parts, F.lit(0)).alias("folder"))
    two = pages.where("page_id % 7 = 0").select(F.concat(F.get(parts, F.lit(0)), F.lit("/"), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("folder"))
    owners = one.union(two).distinct().select("folder", F.col("folder").alias("owner"))
    found = resolve.nearest_owner(pages.select("path").distinct(), owners)
    return pages.join(found, "path", "left").select(F.col("url").alias("path"), "owner")


@query(with_views("SELECT system, topic FROM kafka WHERE role = 'produce' AND system NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 1) UNION ALL SELECT n_name, 'manifest' FROM nation WHERE n_regionkey = 1", "kafka"))
def manifest_precedence(spark: SparkSession, d: str) -> DataFrame:
    code = T.topic_endpoints(spark, d).where("role = 'produce'").select("system", "topic")
    manifest = T.table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_name").alias("system"), F.lit("manifest").alias("topic"))
    return resolve.manifest_first(code, manifest)


_NAMES = "SELECT DISTINCT split_part(host, '.', 2) AS name FROM rest WHERE id % 2 = 0"
_KNOWN = "SELECT DISTINCT replace(split_part(host, '.', 1) || split_part(host, '.', 2), '.', '-') AS matched FROM rest"
_FUZZY = "SELECT n.name, k.matched, CASE WHEN translate(lower(name), '-_.', '') = translate(lower(matched), '-_.', '') THEN 0 ELSE 1 END AS class, CAST(least(length(translate(lower(name), '-_.', '')), length(translate(lower(matched), '-_.', ''))) AS DOUBLE) / greatest(length(translate(lower(name), '-_.', '')), length(translate(lower(matched), '-_.', ''))) AS score FROM names n JOIN known k ON contains(translate(lower(name), '-_.', ''), translate(lower(matched), '-_.', '')) OR contains(translate(lower(matched), '-_.', ''), translate(lower(name), '-_.', ''))"


@query(with_views("SELECT name, CASE WHEN n IS NULL THEN 'unmapped' WHEN class = 0 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'heuristic' END AS status, CASE WHEN n = 1 OR class = 0 THEN matched END AS matched, CASE WHEN n = 1 OR class = 0 THEN score END AS score FROM names LEFT JOIN (SELECT name, count(*) AS n, min(class) AS class, min(matched) AS matched, max(score) AS score FROM (SELECT *, rank() OVER (PARTITION BY name ORDER BY class, score DESC) AS r FROM f) WHERE r = 1 GROUP BY name) USING (name)", "rest", names=_NAMES, known=_KNOWN, f=_FUZZY))
def fuzzy_names(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("snippet", r"^[a-z]+://([^/?#]+)", 1)
    rows = T.rest_endpoints(spark, d).select("id", F.split_part(host, F.lit("."), F.lit(1)).alias("a"), F.split_part(host, F.lit("."), F.lit(2)).alias("b"))
    return resolve.fuzzy_names(rows.where("id % 2 = 0").select(F.col("b").alias("name")), rows.select(F.replace(F.concat("a", "b"), F.lit("."), F.lit("-")).alias("name")))


@query("SELECT asked, CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS status, CASE WHEN n = 1 THEN name END AS name FROM (SELECT DISTINCT upper(p_type) AS asked FROM part UNION SELECT DISTINCT p_name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part) LEFT JOIN (SELECT asked, count(DISTINCT name) AS n, min(name) AS name FROM (SELECT asked, name, rank() OVER (PARTITION BY asked ORDER BY class) AS r FROM (SELECT a.asked, b.name, CASE WHEN a.asked = b.name THEN 0 ELSE 1 END AS class FROM (SELECT DISTINCT upper(p_type) AS asked FROM part UNION SELECT DISTINCT p_name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part) a JOIN (SELECT DISTINCT p_name AS name FROM part) b ON contains(lower(b.name), lower(a.asked)))) WHERE r = 1 GROUP BY asked) USING (asked)")
def name_resolve(spark: SparkSession, d: str) -> DataFrame:
    part = T.table(spark, d, "part")
    asked = part.select(F.upper("p_type").alias("asked")).union(part.select("p_name")).union(part.select(F.split_part("p_name", F.lit(" "), F.lit(1))))
    return resolve.name_resolutions(asked, part.select(F.col("p_name").alias("name")))


_JSON = """'{"source":"' || source || '","target":"' || target || '","target_type":"' || target_type || '","calls":' || calls || ',"failure_calls":' || failure_calls || '}'"""


@query(with_views(f"SELECT source, target, target_type, calls, failure_calls, truncated FROM (SELECT *, n < least(t, 81) AS truncated, max(n) OVER () AS last FROM (SELECT *, 14 + sum(length({_JSON})) OVER (ORDER BY n) + n - 1 + 14 + CASE WHEN n < least(t, 81) THEN 4 ELSE 5 END + 1 AS size FROM (SELECT *, row_number() OVER (ORDER BY calls DESC, source, target, target_type) AS n, count(*) OVER () AS t FROM depm)) WHERE n <= 80 AND size <= 5000) QUALIFY true".replace("n < least(t, 81) AS truncated, max(n) OVER () AS last", "max(n) OVER () < least(t, 81) AS truncated").replace(" QUALIFY true", ""), "depm"))
def byte_budget(spark: SparkSession, d: str) -> DataFrame:
    """The longest prefix whose document, mark of truncation included, fits into 5000 bytes."""
    columns = ["source", "target", "target_type", "calls", "failure_calls"]
    rows, cut = telemetry.byte_budget(dep_relations(spark, d).select(*columns), telemetry.digest_order(), 5_000)
    return spark.createDataFrame([(*(r[c] for c in columns), cut) for r in rows], "source string, target string, target_type string, calls bigint, failure_calls bigint, truncated boolean")


def entry(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: dependency metrics of the busiest relations."""
    return dep_topk(spark, d)
