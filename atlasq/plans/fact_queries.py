"""More queries over the testbed: scalar functions, resolution, rules, state and sources, each with the SQL of the same result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import catalog, graph, incremental, resolve, rules, search, telemetry, traces
from ..sources import files, java, manifests, snapshot
from . import testbed as T
from .queries import _hours, _latency, _merged, dep_relations, query
from .scratch import folder
from .testbed import with_views

_T = T.table


def _pick(key: Column, *values: str) -> Column:
    """One of the values by the remainder of the key."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (key % len(values) + 1).cast("int"))


def _pick_sql(key: str, *values: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST({key} % {len(values)} + 1 AS BIGINT))"


# Scalar functions


@query("SELECT doc_id, substr(sha256(concat_ws('|', source, lang, trim(regexp_replace(substr(text, 1, 200), '[ \\t\\n\\f\\r\\x0B]+', ' ', 'g')))), 1, 16) AS id FROM documents")
def finding_ids(spark: SparkSession, d: str) -> DataFrame:
    return _T(spark, d, "documents").select("doc_id", E.finding_id(F.col("source"), F.col("lang"), F.substring("text", 1, 200)).alias("id"))


@query("SELECT page_id, substr(sha256(concat_ws('|', 'microservice', 'a', 'calls', 'api', url, CASE WHEN page_id % 3 > 0 AND page_id % 2 = 0 THEN url END, CASE WHEN page_id % 3 > 0 AND page_id % 2 = 0 THEN CAST(page_id AS VARCHAR) END)), 1, 16) AS id FROM pages")
def relation_ids(spark: SparkSession, d: str) -> DataFrame:
    path, line = F.when(F.col("page_id") % 3 > 0, F.col("url")), F.when(F.col("page_id") % 2 == 0, F.col("page_id"))
    return _T(spark, d, "pages").select("page_id", E.relation_id(F.lit("microservice"), F.lit("a"), F.lit("calls"), F.lit("api"), F.col("url"), path, line).alias("id"))


_SEGMENTS = "list_filter(string_split(split_part(path, '?', 1), '/'), lambda x: x <> '')"


@query(with_views(f"SELECT id, matches FROM (SELECT id, (m1 = m2 OR m1 = 'ANY' OR m2 = 'ANY') AND len(s) > 1 AS matches FROM (SELECT id, {_SEGMENTS} AS s, {_pick_sql('id', 'GET', 'POST', 'ANY')} AS m1, {_pick_sql('id', 'GET', 'ANY', 'POST', 'PUT')} AS m2 FROM raw_rest))", "raw_rest"))
def wildcard_routes(spark: SparkSession, d: str) -> DataFrame:
    """Every path against a route of its first folder with all below."""
    path = E.rest_path(F.col("url"))
    call = F.concat(_pick(F.col("page_id"), "GET", "POST", "ANY"), F.lit(" "), path)
    serve = F.concat(_pick(F.col("page_id"), "GET", "ANY", "POST", "PUT"), F.lit(" /"), F.coalesce(F.get(E.segments(path), F.lit(0)), F.lit("none")), F.lit("/**"))
    return _T(spark, d, "pages").select(F.col("page_id").alias("id"), E.paths_match(call, serve).alias("matches"))


_CAMEL = "upper(left(split_part(p_name, ' ', 1), 1)) || substr(split_part(p_name, ' ', 1), 2) || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2)"


@query(f"SELECT p_partkey, lower(split_part(p_name, ' ', 1)) || '-' || lower(split_part(p_name, ' ', 2)) AS kebab, upper(split_part(p_name, ' ', 1)) || '_' || upper(split_part(p_name, ' ', 2)) AS topic, CASE WHEN regexp_matches(p_name, '[^aeiou]y$') THEN left(p_name, length(p_name) - 1) || 'ies' WHEN regexp_matches(p_name, '(s|x|z|ch|sh)$') THEN p_name || 'es' ELSE p_name || 's' END AS plural, '/api/' || p_brand || '/' || p_type AS joined, '/' || p_brand || '/' || p_type AS stripped, p_brand || ': ' || p_type AS resource, lower(replace(p_brand, '#', '')) AS observed, lower(p_brand) AS alias FROM (SELECT *, {_CAMEL} AS camel FROM part)")
def name_forms(spark: SparkSession, d: str) -> DataFrame:
    camel = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    joined = E.join_paths(F.lit("/api/"), F.col("p_brand"), F.concat(F.lit("//"), F.col("p_type")))
    return _T(spark, d, "part").select(
        "p_partkey", E.kebab(camel).alias("kebab"), E.topic_name(camel).alias("topic"), E.plural(F.col("p_name")).alias("plural"), joined.alias("joined"), E.strip_prefix(joined, F.lit(1)).alias("stripped"),
        E.qualified_resource(F.col("p_brand"), F.col("p_type")).alias("resource"), E.observed(F.replace(F.concat(F.lit(" "), F.col("p_brand"), F.lit("-_.")), F.lit("#"), F.lit(""))).alias("observed"), E.alias(F.concat(F.lit("\t "), F.col("p_brand"), F.lit(".. "))).alias("alias"),
    )


@query("SELECT s_suppkey, 'svc.' || s_nationkey AS key, CASE WHEN s_suppkey % 3 = 0 THEN 'fixed' WHEN s_suppkey % 2 = 0 THEN s_name END AS value FROM supplier")
def placeholders(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lit("svc."), F.col("s_nationkey").cast("string"))
    text = F.concat(F.lit("#{'${"), key, F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(":"), F.col("s_name"))).otherwise(""), F.lit("}'}"))
    known = F.when(F.col("s_suppkey") % 3 == 0, "fixed")
    return _T(spark, d, "supplier").select("s_suppkey", E.placeholder_key(text).alias("key"), E.resolved(known, text).alias("value"))


@query(f"SELECT event_id, coalesce(seconds, -1) AS seconds, coalesce(cpu, -1) AS cpu, coalesce(memory, -1) AS memory FROM (SELECT event_id, CASE WHEN event_id % 20 > 0 THEN event_id % 20 * CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 WHEN 3 THEN 86400 END END AS seconds, CASE event_id % 8 WHEN 0 THEN event_id % 20 WHEN 1 THEN event_id % 20 * 1000 WHEN 2 THEN event_id % 20 * 1000 + 500 END AS cpu, CASE event_id % 8 WHEN 0 THEN (event_id % 20) * 1024 WHEN 1 THEN (event_id % 20) * 1000000 WHEN 2 THEN (event_id % 20) * 1073741824 + 536870912 WHEN 3 THEN event_id % 20 END AS memory FROM events)")
def units(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("event_id") % 20).cast("string")
    time = F.concat(n, _pick(F.col("event_id"), "s", "m", "h", "d", "x"))
    cpu = F.concat(n, _pick(F.col("event_id"), "m", "", ".5", "Mi", "x", "m5", "..", "k"))
    memory = F.concat(n, _pick(F.col("event_id"), "Ki", "M", ".5Gi", "", ".5", "x", "KiB", "Z"))
    values = {"seconds": E.duration_seconds(time), "cpu": E.millicores(cpu).cast("long"), "memory": E.memory_bytes(memory)}
    return _T(spark, d, "events").select("event_id", *(F.coalesce(v, F.lit(-1)).alias(k) for k, v in values.items()))


_METHODS, _KINDS, _SUB = ("GET", "post", "FETCH", None), ("db", "external", "messaging", "custom", "DB"), ("kafka", "http", "mongodb")
_EV = f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'post' WHEN 2 THEN 'FETCH' END AS method, '/e/' || event_type || '?x=1' AS route, CASE WHEN event_id % 3 = 0 THEN 'top.' || event_type WHEN event_id % 3 = 1 THEN '-bad' END AS destination, {_pick_sql('event_id', 'db', 'external', 'messaging', 'custom', 'DB')} AS kind, {_pick_sql('event_id', 'kafka', 'http', 'mongodb')} AS subtype, {_pick_sql('event_id', 'request', 'messaging', 'job', 'HTTP', 'kafka-poll', 'x', 'y')} AS txn, {_pick_sql('event_id', 'transaction', 'span', 'metric')} AS event FROM events"


@query(
    "WITH e AS (" + _EV + ") SELECT event_id, CASE WHEN event_id % 4 < 2 THEN upper(method) || ' ' || split_part(route, '?', 1) WHEN event_id % 3 = 0 THEN destination END AS label, "
    "CASE WHEN event_id % 4 < 3 OR lower(txn) IN ('request', 'http') THEN 'HTTP' WHEN txn = 'messaging' THEN 'Messaging' WHEN subtype = 'kafka' THEN 'Kafka' WHEN lower(kind) = 'messaging' THEN 'Messaging' WHEN lower(kind) = 'db' THEN 'Database' WHEN lower(kind) = 'external' THEN 'External' ELSE 'Application' END AS origin, "
    "CASE WHEN event = 'span' THEN 'Span' WHEN lower(txn) IN ('request', 'http') THEN 'HTTP transaction' WHEN txn = 'messaging' THEN 'Messaging transaction' ELSE 'Transaction' END AS operation, "
    "CASE WHEN lower(kind) IN ('messaging', 'db', 'external') THEN lower(kind) ELSE 'other' END AS span_type, CASE WHEN event = 'transaction' THEN 'transaction' ELSE 'span' END AS event_kind, "
    "CASE WHEN lower(txn) IN ('request', 'http') THEN 'HTTP' WHEN txn = 'messaging' OR contains(txn, 'kafka') THEN 'messaging' ELSE 'other' END AS txn_kind FROM e"
)
def span_classes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    method = F.when(k % 4 == 0, "GET").when(k % 4 == 1, "post").when(k % 4 == 2, "FETCH")
    destination = F.when(k % 3 == 0, F.concat(F.lit("top."), "event_type")).when(k % 3 == 1, "-bad")
    kind, subtype, txn, event = _pick(k, *_KINDS), _pick(k, *_SUB), _pick(k, "request", "messaging", "job", "HTTP", "kafka-poll", "x", "y"), _pick(k, "transaction", "span", "metric")
    route = F.concat(F.lit("/e/"), "event_type", F.lit("?x=1"))
    return _T(spark, d, "events").select(
        "event_id", E.span_label(method, route, destination).alias("label"), E.span_origin(kind, subtype, method, F.lit(None).cast("string"), txn).alias("origin"), E.operation_label(F.col("event_type"), event, txn).alias("operation"),
        E.span_type(kind).alias("span_type"), E.event_kind(event).alias("event_kind"), E.transaction_kind(txn).alias("txn_kind"),
    )


_FOLDERS = ("src/main/", "src/test/", "src/intTest/", ".git/x/", "tests/", "Mock-api/", "lib/test-service/")


@query(f"WITH f AS (SELECT page_id, {_pick_sql('page_id', *_FOLDERS)} || 'f' || page_id || {_pick_sql('page_id', '.java', '.xml', '.properties')} AS path, {_pick_sql('page_id', 'svc', 'svc-test', 'ArchTeype', 'order')} AS name FROM pages) SELECT page_id, page_id % 7 IN (1, 2) AS test_source, page_id % 7 = 3 AS git, page_id % 7 IN (1, 4, 5) OR page_id % 4 IN (1, 2) AS excluded, page_id % 3 = 0 AND page_id % 7 < 3 AS java_source FROM f")
def path_predicates(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(_pick(F.col("page_id"), *_FOLDERS), F.lit("f"), F.col("page_id").cast("string"), _pick(F.col("page_id"), ".java", ".xml", ".properties"))
    name = _pick(F.col("page_id"), "svc", "svc-test", "ArchTeype", "order")
    return _T(spark, d, "pages").select("page_id", E.is_test_source(path).alias("test_source"), E.in_git_folder(path).alias("git"), E.is_excluded_module(path, name).alias("excluded"), E.glob(path, "src/*.java").alias("java_source"))


# Endpoints with places, for filters, relations and rules


def _endpoints(spark: SparkSession, d: str) -> DataFrame:
    """All REST and topic endpoints, with module, place, class, message type and snippet."""
    rest = T.rest_endpoints(spark, d).select(
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), "role", "system", F.when((F.col("role") == "call") & (F.col("id") % 6 == 0), "GET <dynamic>").otherwise(F.col("topic")).alias("topic"), (F.col("id") % 12 == 0).alias("topic_dynamic"),
        F.concat(F.lit("src/"), "system", F.lit("/R.java")).alias("path"), F.col("id").cast("int").alias("start_line"), F.concat(F.lit("${url."), (F.col("id") % 9).cast("string"), F.lit("} "), "snippet").alias("snippet"),
        F.when(F.col("id") % 8 > 0, F.col("system")).alias("module"), F.lit(None).cast("string").alias("message_type"), F.when(F.col("id") % 4 == 1, F.concat(F.lit("a."), "system")).alias("qualified_name"),
    )
    t = T.topic_endpoints(spark, d)
    topic = t.select(
        F.concat_ws("|", "role", "system", "topic", "message_type").alias("id"), "role", "system", "topic", F.endswith("topic", F.lit("9")).alias("topic_dynamic"), F.concat(F.lit("src/"), "system", F.lit("/K.java")).alias("path"), F.length("topic").alias("start_line"), F.lit("send(").alias("snippet"),
        F.col("system").alias("module"), F.when(F.col("message_type") != "SMALL", F.col("message_type")).alias("message_type"), F.lit(None).cast("string").alias("qualified_name"),
    )
    return rest.unionByName(topic)


_ENDPOINTS = (
    "SELECT 'r' || id AS id, role, system, CASE WHEN role = 'call' AND id % 6 = 0 THEN 'GET <dynamic>' ELSE topic END AS topic, id % 12 = 0 AS topic_dynamic, 'src/' || system || '/R.java' AS path, CAST(id AS INTEGER) AS start_line, '${url.' || (id % 9) || '} ' || url AS snippet, CASE WHEN id % 8 > 0 THEN system END AS module, CAST(NULL AS VARCHAR) AS message_type, CASE WHEN id % 4 = 1 THEN 'a.' || system END AS qualified_name FROM rest "
    "UNION ALL SELECT concat_ws('|', role, system, topic, message_type), role, system, topic, ends_with(topic, '9'), 'src/' || system || '/K.java', CAST(length(topic) AS INTEGER), 'send(', system, CASE WHEN message_type <> 'SMALL' THEN message_type END, NULL FROM kafka"
)


def _with_ends(sql: str, *names: str, **more: str) -> str:
    return with_views(sql, "rest", "kafka", *names, ends=_ENDPOINTS, **more)


@query(_with_ends("SELECT id, path, start_line FROM ends WHERE system LIKE 'caller%' AND role = 'call' AND path LIKE 'src/caller_/R.java' AND module = 'caller1'"))
def endpoints_filter(spark: SparkSession, d: str) -> DataFrame:
    return catalog.filtered_endpoints(_endpoints(spark, d), role="call", module="caller1", path_glob="src/caller?/R.java").select("id", "path", "start_line")


@query(_with_ends("SELECT module, count(*) AS n FROM ends GROUP BY module"))
def endpoints_by_module(spark: SparkSession, d: str) -> DataFrame:
    return catalog.by_module(_endpoints(spark, d), keep_null=True)


@query(_with_ends("SELECT id, module, role, topic, path || ':' || start_line AS site FROM ends"))
def endpoint_sites(spark: SparkSession, d: str) -> DataFrame:
    return catalog.endpoint_sites(_endpoints(spark, d))


@query(_with_ends("SELECT rule, severity, count(*) AS n FROM (SELECT 'dynamic-kafka-topic' AS rule, 'WARNING' AS severity FROM ends WHERE role IN ('produce', 'consume') AND topic_dynamic UNION ALL SELECT 'dynamic-http-target', 'WARNING' FROM ends WHERE role = 'call' AND topic LIKE '% <dynamic>' UNION ALL SELECT CASE WHEN p > 0 AND c > 0 THEN 'kafka-message-contract-mismatch' ELSE 'kafka-message-contract-unknown' END, CASE WHEN p > 0 AND c > 0 THEN 'WARNING' ELSE 'INFO' END FROM (SELECT coalesce(len(pt), 0) AS p, coalesce(len(ct), 0) AS c, pt, ct, ps, cs FROM (SELECT topic, list_sort(list(DISTINCT message_type) FILTER (role = 'produce' AND message_type IS NOT NULL)) AS pt, list_sort(list(DISTINCT message_type) FILTER (role = 'consume' AND message_type IS NOT NULL)) AS ct, count(*) FILTER (role = 'produce') AS ps, count(*) FILTER (role = 'consume') AS cs FROM ends WHERE role IN ('produce', 'consume') AND NOT topic_dynamic GROUP BY topic)) WHERE (p > 0 AND c > 0 AND pt <> ct) OR (ps > 0 AND cs > 0 AND (p = 0 OR c = 0))) GROUP BY rule, severity"))
def issue_counts(spark: SparkSession, d: str) -> DataFrame:
    e = _endpoints(spark, d)
    return rules.issue_counts(rules.issues([rules.dynamic_topics(e), rules.dynamic_targets(e), rules.contract_mismatch(e), rules.contract_unknown(e)]))


@query(_with_ends("SELECT rule, severity, subject, detail FROM (SELECT 'dynamic-http-target' AS rule, 'WARNING' AS severity, system AS subject, id AS detail FROM ends WHERE role = 'call' AND topic LIKE '% <dynamic>' UNION ALL SELECT 'synchronous-rest-cycle', 'ERROR', a.source, a.target FROM pairs a JOIN pairs b ON a.source = b.target AND a.target = b.source WHERE a.source < a.target)", "pairs"))
def issue_list(spark: SparkSession, d: str) -> DataFrame:
    return rules.issues([rules.dynamic_targets(_endpoints(spark, d)), rules.rest_cycles(T.all_edges(spark, d))])


@query(_with_ends("SELECT * FROM (SELECT topic AS name, CASE WHEN count(*) FILTER (role = 'produce') = 0 THEN 'produce' WHEN count(*) FILTER (role = 'consume') = 0 THEN 'consume' END AS missing FROM ends WHERE role IN ('produce', 'consume') GROUP BY topic) WHERE missing IS NOT NULL"))
def orphan_integrations(spark: SparkSession, d: str) -> DataFrame:
    found = rules.orphan_integrations(catalog.summary_of(_endpoints(spark, d), ("produce", "consume")), ("produce", "consume"))
    return found


@query(with_views("SELECT 'non-runtime-module-activity' AS rule, 'WARNING' AS severity, n_name AS subject, 'm/' || n_name AS detail FROM nation WHERE n_nationkey % 2 = 1 AND n_nationkey % 5 > 0 AND n_name IN (SELECT system FROM kafka)", "kafka"))
def idle_modules(spark: SparkSession, d: str) -> DataFrame:
    return rules.idle_modules(_modules(spark, d), T.topic_endpoints(spark, d).select(F.col("system").alias("module")))


def _modules(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return _T(spark, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("m/"), "n_name").alias("path"), (k % 2 == 0).alias("starts_application"), F.when(k % 5 == 0, "aggregator").otherwise("jar").alias("kind"))


@query("SELECT 'synchronous-http-in-kafka-consumer' AS rule, 'WARNING' AS severity, 'u' || e.user_id AS subject, CAST(e.event_id AS VARCHAR) AS detail FROM events e JOIN (SELECT event_id, user_id FROM events WHERE event_type = 'view') c ON e.user_id = c.user_id AND e.event_id BETWEEN c.event_id AND c.event_id + 40 WHERE e.event_type = 'click'")
def http_in_consumers(spark: SparkSession, d: str) -> DataFrame:
    e = _T(spark, d, "events").select("event_id", "user_id", "event_type")
    calls = e.where("event_type = 'click'").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("id"))
    consumers = e.where("event_type = 'view'").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("lo"), (F.col("event_id") + 40).alias("hi"))
    return rules.http_in_consumers(resolve.inside_ranges(calls, consumers, ["path"], "id", "lo", "hi", 40).withColumn("system", F.col("path")))


@query(_with_ends("SELECT module, array_to_string(list_sort(list(DISTINCT topic)), ',') AS topics FROM ends WHERE role = 'call' AND id NOT IN (SELECT 'r' || call_id FROM (SELECT c.id AS call_id FROM rest c WHERE c.id % 4 = 0)) GROUP BY module"))
def external_calls(spark: SparkSession, d: str) -> DataFrame:
    matched = _T(spark, d, "pages").where("page_id % 4 = 0").select(F.concat(F.lit("r"), F.col("page_id").cast("string")).alias("call_id"))
    return catalog.external_calls(_endpoints(spark, d), matched).select("module", F.array_join("topics", ",").alias("topics"))


_SIDE = "coalesce(array_to_string(list_sort(list(DISTINCT topic) FILTER (role = '{r}')), ','), '') AS {r}"


@query(_with_ends(f"SELECT module, {', '.join(_SIDE.format(r=r) for r in ('produce', 'consume', 'serve', 'call'))}, concat_ws(',', CASE WHEN count(*) FILTER (role IN ('produce', 'consume')) > 0 THEN 'kafka' END, CASE WHEN count(*) FILTER (role IN ('serve', 'call')) > 0 THEN 'rest' END) AS technologies FROM ends GROUP BY module"))
def module_summary(spark: SparkSession, d: str) -> DataFrame:
    out = catalog.module_summary(_endpoints(spark, d))
    return out.select("module", *(F.array_join(r, ",").alias(r) for r in ("produce", "consume", "serve", "call")), "technologies")


@query(_with_ends("SELECT e.id AS source_endpoint, (SELECT min(s.id) FROM ends s WHERE s.topic = e.topic AND s.role IN ('serve', 'consume')) AS target_endpoint FROM ends e JOIN (SELECT DISTINCT module, path, start_line, role FROM ends WHERE role IN ('call', 'produce') AND start_line % 3 = 0) r ON e.module = r.module AND e.path = r.path AND e.start_line = r.start_line AND e.role = r.role"))
def evidence(spark: SparkSession, d: str) -> DataFrame:
    e = _endpoints(spark, d)
    found = e.where("role IN ('call', 'produce') AND start_line % 3 = 0").select("module", "path", F.col("start_line").alias("line"), "role").distinct()
    return catalog.evidence_join(found, e).select("source_endpoint", "target_endpoint")


@query(_with_ends("SELECT id, CASE WHEN count(*) > 0 THEN 1 END AS edges FROM (SELECT DISTINCT 'microservice' AS kind, system AS id, role, topic FROM ends) GROUP BY id"))
def typed_graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = catalog.typed_graph(_endpoints(spark, d))
    ends = graph.neighbours(edges).select(F.col("node").alias("id")).distinct()
    return nodes.where("kind = 'microservice'").select("id").join(ends.withColumn("edges", F.lit(1)), "id", "left")


_TOPIC_NODE = "CASE WHEN topic_dynamic THEN system || ':' || topic ELSE topic END"


@query(_with_ends(f"SELECT DISTINCT CASE WHEN role IN ('produce', 'call') THEN system ELSE {_TOPIC_NODE} END AS source, CASE WHEN role IN ('produce', 'call') THEN {_TOPIC_NODE} ELSE system END AS target, role AS kind FROM ends"))
def typed_graph(spark: SparkSession, d: str) -> DataFrame:
    return catalog.typed_graph(_endpoints(spark, d))[1]


@query(_with_ends(f"SELECT (SELECT count(DISTINCT system) FROM ends) AS microservices, (SELECT count(DISTINCT {_TOPIC_NODE}) FROM ends WHERE role IN ('produce', 'consume')) AS topics, CAST(0 AS BIGINT) AS collections, (SELECT count(DISTINCT {_TOPIC_NODE}) FROM ends WHERE role IN ('serve', 'call')) AS apis, (SELECT count(*) FROM (SELECT DISTINCT system, role, {_TOPIC_NODE} FROM ends)) AS relations, CAST(0 AS BIGINT) AS configured"))
def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = catalog.typed_graph(_endpoints(spark, d))
    return catalog.graph_summary(nodes, edges.withColumn("label", F.lit("")))


@query(_with_ends("SELECT relation, count(*) AS n FROM (SELECT DISTINCT CASE role WHEN 'produce' THEN 'publishes' WHEN 'consume' THEN 'consumes' WHEN 'serve' THEN 'provides' ELSE 'calls' END AS relation, system, topic, path, start_line FROM ends UNION ALL SELECT DISTINCT 'publishes_to', source, target, '', 0 FROM kafka_edges UNION ALL SELECT DISTINCT 'calls_service', source, target, '', 0 FROM pairs) GROUP BY relation", "kafka_edges", "pairs"))
def relation_coverage(spark: SparkSession, d: str) -> DataFrame:
    rest = T.all_edges(spark, d).select("source", "target", F.lit("").alias("call_id"))
    topics = resolve.topic_edges(T.topic_endpoints(spark, d)).select("source", "target").distinct()
    return catalog.coverage(catalog.relations(_endpoints(spark, d), rest, topics))


_REL = "SELECT relation, confidence, count(*) AS n FROM ("
_KIND = "(SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'microservice' ELSE 'module' END FROM nation WHERE n_name = {c})"
_SURE = "CASE WHEN topic_dynamic THEN 'medium' ELSE 'high' END"


@query(_with_ends(
    _REL + "SELECT DISTINCT 'depends_on' AS relation, 'high' AS confidence, a.n_name AS s, b.n_name AS t, '' AS p FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey "
    f"UNION ALL SELECT DISTINCT 'implements', {_SURE}, qualified_name, topic || role, path || start_line FROM ends WHERE module IS NOT NULL AND qualified_name IS NOT NULL "
    f"UNION ALL SELECT DISTINCT 'uses_configuration', {_SURE}, coalesce(qualified_name, module), regexp_extract(snippet, '\\$\\{{([^}}:]+)', 1), path || start_line FROM ends WHERE module IS NOT NULL AND contains(snippet, '${{') "
    f"UNION ALL SELECT DISTINCT CASE WHEN role = 'produce' THEN 'publishes_type' ELSE 'consumes_type' END, {_SURE}, topic, message_type, path || start_line FROM ends WHERE role IN ('produce', 'consume') AND message_type IS NOT NULL "
    "UNION ALL SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'writes' ELSE 'reads' END, 'high', n_name, p_brand, 'p' || p_partkey FROM part JOIN nation ON p_partkey % 25 = n_nationkey "
    "UNION ALL SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'writes' ELSE 'reads' END, 'high', n_name || ':' || p_type, p_brand, 'p' || p_partkey FROM part JOIN nation ON p_partkey % 25 = n_nationkey WHERE p_partkey % 3 = 0"
    ") GROUP BY relation, confidence"))  # fmt: skip
def relation_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The relations besides those between services, counted by kind and confidence."""
    n = _T(spark, d, "nation")
    below = n.select(F.col("n_name").alias("target"), "n_regionkey", F.col("n_nationkey").alias("k"))
    dependencies = n.join(F.broadcast(below), "n_regionkey").where("n_nationkey < k").select(F.col("n_name").alias("source"), "target")  # 25 rows
    methods = _T(spark, d, "part").join(F.broadcast(n), F.col("p_partkey") % 25 == F.col("n_nationkey")).select(F.col("n_name").alias("module"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).alias("owner_method"), F.when(F.col("p_size") % 2 == 0, "save").otherwise("find").alias("operation"), F.col("p_brand").alias("collection"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), F.lit(1).alias("line"))
    found = catalog.more_relations(_endpoints(spark, d), dependencies, methods, _modules(spark, d))
    return found.groupBy("relation", "confidence").agg(F.count("*").alias("n"))


@query(_with_ends("SELECT 'dynamic_kafka_topics' AS list, module, topic, role, path, start_line AS line, (SELECT count(*) > 20 FROM ends WHERE role IN ('produce', 'consume') AND topic_dynamic) AS truncated FROM (SELECT * FROM ends WHERE role IN ('produce', 'consume') AND topic_dynamic ORDER BY module, topic, path, start_line LIMIT 20) UNION ALL SELECT 'unknown_kafka_message_types', module, topic, role, path, start_line, (SELECT count(*) > 20 FROM ends WHERE role IN ('produce', 'consume') AND message_type IS NULL) FROM (SELECT * FROM ends WHERE role IN ('produce', 'consume') AND message_type IS NULL ORDER BY module, topic, path, start_line LIMIT 20) UNION ALL SELECT 'unmatched_http_calls', module, topic, role, path, start_line, (SELECT count(*) > 20 FROM ends WHERE role = 'call') FROM (SELECT * FROM ends WHERE role = 'call' ORDER BY module NULLS FIRST, topic, path, start_line LIMIT 20)"))
def unresolved_lists(spark: SparkSession, d: str) -> DataFrame:
    return catalog.unresolved(_endpoints(spark, d), spark.createDataFrame([], "call_id string"))


@query(with_views("SELECT DISTINCT 'microservice' AS source_kind, source, 'kafka_topic' AS target_kind, topic AS target, topic AS label, 'kafka' AS kind FROM kafka_edges UNION SELECT 'kafka_topic', topic, 'microservice', target, topic, 'kafka' FROM kafka_edges UNION SELECT 'microservice', source, 'microservice', target, '', 'rest' FROM pairs", "kafka_edges", "pairs"))
def visual_edges(spark: SparkSession, d: str) -> DataFrame:
    flows = resolve.topic_edges(T.topic_endpoints(spark, d)).select("source", "target", F.lit("kafka").alias("kind"), F.col("topic").alias("label"))
    return catalog.visual_edges(T.all_edges(spark, d).unionByName(flows))


@query(with_views("SELECT service FROM (SELECT DISTINCT c_mktsegment AS service FROM customer UNION SELECT n_name FROM nation) WHERE service NOT IN (SELECT system FROM kafka UNION SELECT n_name FROM nation WHERE n_nationkey < 5)", "kafka"))
def missing_services(spark: SparkSession, d: str) -> DataFrame:
    runtime = _T(spark, d, "customer").select(F.col("c_mktsegment").alias("service")).union(_T(spark, d, "nation").select("n_name"))
    known = catalog.known_services(T.topic_endpoints(spark, d).withColumn("module", F.col("system")), _T(spark, d, "nation").where("n_nationkey < 5").select(F.col("n_name").alias("name")))
    return catalog.missing_services(runtime, known)


@query("SELECT s_suppkey, s_name AS service FROM supplier WHERE s_suppkey % 4 > 1")
def exportable_services(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("Test-"), "s_name")).when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("${"), "s_name", F.lit("}"))).otherwise(F.col("s_name"))
    return catalog.exportable(_T(spark, d, "supplier").select("s_suppkey", name.alias("service")))


@query("SELECT n_name AS name, 'm/' || n_name AS path FROM nation WHERE n_nationkey % 2 = 0")
def runtime_modules(spark: SparkSession, d: str) -> DataFrame:
    return catalog.runtime_modules(_modules(spark, d)).select("name", "path")


@query(_with_ends("SELECT * FROM (WITH n AS (SELECT DISTINCT system AS node, 'microservice' AS kind FROM ends UNION SELECT DISTINCT " + _TOPIC_NODE + ", CASE WHEN role IN ('produce', 'consume') THEN 'topic' ELSE 'api' END FROM ends), g AS (SELECT DISTINCT system, role, " + _TOPIC_NODE + " AS topic FROM ends), deg AS (SELECT node, count(*) AS relations FROM (SELECT system AS node FROM g UNION ALL SELECT topic FROM g) GROUP BY node), r AS (SELECT n.node, kind, coalesce(relations, 0) AS relations FROM n LEFT JOIN deg ON n.node = deg.node), f AS (SELECT 'NATION_' || (id % 25) AS node, severity FROM finding) SELECT r.node, kind, relations, CASE WHEN kind = 'microservice' THEN list_extract(['low', 'medium', 'high'], CAST(ntile(3) OVER (PARTITION BY kind ORDER BY relations, r.node) AS BIGINT)) END AS level, CASE WHEN kind = 'microservice' THEN (SELECT count(*) FROM f WHERE f.node = r.node AND severity = 'INFO') ELSE -1 END AS info, CASE WHEN kind = 'microservice' THEN (SELECT count(*) FROM f WHERE f.node = r.node AND severity = 'WARNING') ELSE -1 END AS warning, CASE WHEN kind = 'microservice' THEN (SELECT count(*) FROM f WHERE f.node = r.node AND severity = 'ERROR') ELSE -1 END AS error FROM r)", "finding"))
def complexity(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = catalog.typed_graph(_endpoints(spark, d))
    found = T.findings(spark, d).select(F.concat(F.lit("NATION_"), (F.col("id") % 25).cast("string")).alias("service"), "severity")
    return catalog.complexity(nodes, edges, found).fillna(-1, ["info", "warning", "error"])


# Resolution


@query("SELECT DISTINCT c.page_id AS call_id, s.page_id AS serve_id, 'http://' || split_part(s.url, '/', 3) AS topic FROM pages c JOIN pages s ON c.page_id % 2 = 0 AND s.page_id % 2 = 1 AND c.page_id % 50 = s.page_id % 50 - 1 AND (c.page_id % 3 = 0 OR s.page_id % 3 = c.page_id % 3)")
def configured_resource_edges(spark: SparkSession, d: str) -> DataFrame:
    p = _T(spark, d, "pages").select("page_id", "url")
    k = F.col("page_id")
    method = _pick(k, "ANY", "GET", "POST")
    host = F.concat(F.lit("http://"), F.split_part("url", F.lit("/"), F.lit(3)))
    serve = k % 2 == 1
    name = F.concat(F.lit("svc-"), F.when(serve, k % 50 - 1).otherwise(k % 50).cast("string"))
    served = F.when(k % 3 == 0, "PATCH").otherwise(method)
    e = p.select(k.alias("id"), F.when(serve, "serve").otherwise("call").alias("role"), F.when(serve, name).otherwise("caller").alias("system"), F.concat(F.when(serve, served).otherwise(method), F.lit(" "), F.when(serve, host).otherwise("<dynamic>")).alias("topic"), F.concat(F.lit("x\nsystem-api-domain:"), name).alias("snippet"))
    names = e.where("role = 'serve'").select(F.col("system").alias("service"), F.col("system").alias("alias")).distinct()
    found = resolve.configured_resource_edges(e.withColumn("snippet", F.replace("snippet", F.lit("system-api"), F.lit("api"))), names)
    return found.select("call_id", "serve_id", F.split_part("topic", F.lit(" "), F.lit(2)).alias("topic"))


@query("SELECT 'NATION_' || (c_custkey % 25) AS source, lower(c_mktsegment) AS target, min(c_custkey) AS call_id FROM customer WHERE c_custkey % 2 = 0 GROUP BY ALL")
def external_edges(spark: SparkSession, d: str) -> DataFrame:
    c = _T(spark, d, "customer")
    mark = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("x\nexternal-microservice:"), "c_mktsegment")).otherwise("none")
    return resolve.external_edges(c.select(F.col("c_custkey").alias("id"), F.lit("call").alias("role"), F.concat(F.lit("NATION_"), (F.col("c_custkey") % 25).cast("string")).alias("system"), mark.alias("snippet")))


@query("SELECT 'NATION_' || (c_custkey % 25) AS source, c_mktsegment AS target, min(c_custkey) AS call_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL")
def configured_edges(spark: SparkSession, d: str) -> DataFrame:
    calls = _T(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("NATION_"), (F.col("c_custkey") % 25).cast("string")).alias("system"), F.col("c_mktsegment").alias("domain"))
    return resolve.configured_edges(calls, _T(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("call_id")))


@query("SELECT source, target, call_id, serve_id, topic FROM (SELECT *, row_number() OVER (PARTITION BY call_id, target ORDER BY topic, serve_id) AS n FROM (SELECT 's' || (l_suppkey % 5) AS source, l_returnflag AS target, l_suppkey AS call_id, l_orderkey * 10 + l_linenumber AS serve_id, l_linestatus AS topic FROM lineitem)) WHERE n = 1 OR call_id % 2 = 1")
def gateway_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = _T(spark, d, "lineitem").select(F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("source"), F.col("l_returnflag").alias("target"), F.col("l_suppkey").alias("call_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("serve_id"), F.col("l_linestatus").alias("topic"))
    return resolve.gateway_edges(edges, _T(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id")))


@query("WITH p AS (SELECT DISTINCT n_regionkey AS r, n_nationkey AS k FROM nation), u AS (SELECT s_suppkey, s_nationkey AS k, s_nationkey % 5 AS r FROM supplier) SELECT 'r' || r || '/n' || k || '/f' || s_suppkey AS path, 'key' || (s_suppkey % 3) AS key, CASE WHEN k % 3 = s_suppkey % 3 THEN 'near' || k WHEN r % 3 = s_suppkey % 3 THEN 'far' || r WHEN s_suppkey % 2 = 0 THEN 'dflt' END AS value FROM u")
def nearest_property(spark: SparkSession, d: str) -> DataFrame:
    s = _T(spark, d, "supplier")
    r, k = (F.col("s_nationkey") % 5).cast("string"), F.col("s_nationkey").cast("string")
    uses = s.select(F.concat(F.lit("r"), r, F.lit("/n"), k, F.lit("/f"), F.col("s_suppkey").cast("string")).alias("path"), F.concat(F.lit("key"), (F.col("s_suppkey") % 3).cast("string")).alias("key"), F.when(F.col("s_suppkey") % 2 == 0, "dflt").otherwise("").alias("default_value"))
    n = _T(spark, d, "nation").select((F.col("n_nationkey") % 5).cast("string").alias("r"), F.col("n_nationkey").cast("string").alias("k"), F.col("n_nationkey").alias("i"))
    key = lambda c: F.concat(F.lit("key"), (c % 3).cast("string"))
    near = n.select(F.concat(F.lit("r"), "r", F.lit("/n"), "k").alias("folder"), key(F.col("i")).alias("key"), F.concat(F.lit("near"), "k").alias("value"))
    far = n.select(F.concat(F.lit("r"), "r").alias("folder"), key(F.col("r").cast("int")).alias("key"), F.concat(F.lit("far"), "r").alias("value")).distinct()
    first, second = (df.withColumn("rank", F.lit(k)) for k, df in ((0, near.union(far)), (1, near.union(far).withColumn("value", F.lit("later")))))
    return resolve.nearest_property(uses, first.unionByName(second))


@query("SELECT page_id AS id, 'code' AS origin FROM pages WHERE page_id % 5 > 0 UNION ALL SELECT page_id, 'strategy' FROM pages WHERE page_id % 5 = 0")
def override_rows(spark: SparkSession, d: str) -> DataFrame:
    p = _T(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("path"), F.lit("consume").alias("role"), F.col("page_id").alias("line"))
    return resolve.override_rows(p.withColumn("origin", F.lit("code")), p.where("id % 5 = 0").withColumn("origin", F.lit("strategy")), ["role", "path", "line"]).select("id", "origin")


@query("WITH m AS (SELECT 'p/' || p_partkey AS path, p_name AS name FROM part), one AS (SELECT name, min(path) AS path FROM m GROUP BY name HAVING count(*) = 1), u AS (SELECT 'p/' || (s_suppkey * 3) AS source, CASE WHEN s_suppkey % 2 = 0 THEN 'p/' || (s_suppkey * 7) ELSE (SELECT p_name FROM part WHERE p_partkey = s_suppkey) END AS ref FROM supplier) SELECT DISTINCT source, target FROM (SELECT source, path AS target FROM u JOIN m ON ref = path UNION ALL SELECT source, one.path FROM u JOIN one ON ref = one.name) WHERE source <> target")
def artifact_dependencies(spark: SparkSession, d: str) -> DataFrame:
    part, s = _T(spark, d, "part"), _T(spark, d, "supplier")
    modules = part.select(F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_name").alias("name"))
    named = s.join(part, F.col("s_suppkey") == F.col("p_partkey"), "left")
    declared = named.select(F.concat(F.lit("p/"), (F.col("s_suppkey") * 3).cast("string")).alias("source"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("p/"), (F.col("s_suppkey") * 7).cast("string"))).otherwise(F.col("p_name")).alias("ref"))
    return resolve.unique_artifact_dependencies(declared, modules)


@query("WITH r AS (SELECT l_suppkey AS node, CASE l_returnflag WHEN 'A' THEN 'matched' WHEN 'R' THEN 'heuristic' ELSE 'unmapped' END AS status, l_orderkey * 10 + l_linenumber AS o FROM lineitem WHERE l_suppkey % 3 > 0 OR l_returnflag <> 'A') SELECT node, status, o FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY status = 'heuristic', CASE WHEN status = 'matched' THEN -o ELSE o END) AS n FROM r WHERE status <> 'unmapped') WHERE n = 1")
def overlay_claims(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "matched").when(F.col("l_returnflag") == "R", "heuristic").otherwise("unmapped")
    rows = _T(spark, d, "lineitem").where("l_suppkey % 3 > 0 OR l_returnflag <> 'A'").select(F.col("l_suppkey").alias("node"), status.alias("status"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return resolve.overlay_claims(rows, ["node"], F.col("o")).select("node", "status", "o")


def _observed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Runtime relations between nations under other spellings, and what the names are."""
    k = F.col("n_nationkey")
    names = _T(spark, d, "nation").select(F.concat(F.lower("n_name"), F.when(k % 3 == 1, "-svc").when(k % 3 == 2, "?").otherwise("")).alias("name"), F.when(k % 3 == 0, "matched").when(k % 3 == 1, "heuristic").otherwise("unmapped").alias("status"), F.when(k % 3 < 2, F.col("n_name")).alias("matched"), F.col("n_name").alias("own"))
    pairs = T.trade(spark, d).groupBy("source", "target").agg(F.count("*").alias("calls"))
    seen = F.broadcast(names.select("own", "name"))  # 25 rows
    rows = pairs.join(seen.withColumnsRenamed({"own": "source", "name": "s"}), "source").join(seen.withColumnsRenamed({"own": "target", "name": "t"}), "target")
    return rows.select(F.col("s").alias("source"), F.col("t").alias("target"), "calls", F.lit(0.5).alias("error_rate")), names.drop("own")


_NAMED = "SELECT n_name AS own, lower(n_name) || CASE n_nationkey % 3 WHEN 1 THEN '-svc' WHEN 2 THEN '?' ELSE '' END AS seen, CASE n_nationkey % 3 WHEN 0 THEN 'matched' WHEN 1 THEN 'heuristic' ELSE 'unmapped' END AS status FROM nation"


@query(with_views("SELECT source AS source_node, target AS target_node, calls, 0.5::DOUBLE AS error_rate, CASE WHEN a.status = 'matched' AND b.status = 'matched' THEN 'matched' ELSE 'heuristic' END AS status FROM p JOIN named a ON a.own = source JOIN named b ON b.own = target WHERE a.status <> 'unmapped' AND b.status <> 'unmapped'", "trade", p="SELECT source, target, count(*) AS calls FROM trade GROUP BY ALL", named=_NAMED))
def edge_claims(spark: SparkSession, d: str) -> DataFrame:
    return resolve.edge_claims(*_observed(spark, d))[0]


@query(with_views("SELECT name, role, CAST(sum(calls) AS BIGINT) AS calls, 'x' AS candidates FROM (SELECT a.seen AS name, 'source' AS role, calls FROM p JOIN named a ON a.own = source WHERE a.status = 'unmapped' UNION ALL SELECT b.seen, 'destination', calls FROM p JOIN named b ON b.own = target WHERE b.status = 'unmapped') GROUP BY name, role", "trade", p="SELECT source, target, count(*) AS calls FROM trade GROUP BY ALL", named=_NAMED))
def unresolved_merge(spark: SparkSession, d: str) -> DataFrame:
    lost = resolve.edge_claims(*_observed(spark, d))[1].withColumn("candidates", F.array(F.lit("x")))
    return resolve.unresolved_merge(lost).withColumn("candidates", F.array_join("candidates", ","))


@query("SELECT DISTINCT p_brand AS request, 'retour_' || p_brand AS reply FROM part WHERE length(p_brand) = 7")
def request_reply(spark: SparkSession, d: str) -> DataFrame:
    brand = _T(spark, d, "part").select(F.col("p_brand").alias("topic"))
    return resolve.request_reply(brand.union(brand.where("length(topic) = 7").select(F.concat(F.lit("retour_"), "topic"))).union(spark.createDataFrame([("retour_none",)], "topic string")))


@query("SELECT page_id AS id, 'url.' || (page_id % 9) AS key FROM pages WHERE page_id % 9 < 5")
def property_usage(spark: SparkSession, d: str) -> DataFrame:
    e = _T(spark, d, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("${url."), (F.col("page_id") % 9).cast("string"), F.lit(":x} and ${other}")).alias("snippet"))
    known = _T(spark, d, "region").select(F.concat(F.lit("url."), F.col("r_regionkey").cast("string")).alias("key"))
    return resolve.property_usage(e, known)


@query("WITH t AS (SELECT DISTINCT p_brand || '.' || p_type AS qualified, p_brand AS package, p_type AS simple FROM part UNION SELECT DISTINCT 'one.' || p_brand, 'one', p_brand FROM part), u AS (SELECT p_partkey, p_brand, p_type, p_partkey % 5 AS k FROM part) SELECT p_partkey AS use_id, CASE WHEN k = 4 THEN 'one.' || p_brand ELSE p_brand || '.' || p_type END AS type_name FROM u")
def type_references(spark: SparkSession, d: str) -> DataFrame:
    """By qualified name, import, wildcard import, package, and the only one of a name."""
    part = _T(spark, d, "part")
    own, one = F.concat_ws(".", "p_brand", "p_type"), F.concat(F.lit("one."), "p_brand")
    types = part.select(own.alias("qualified"), F.col("p_brand").alias("package"), F.col("p_type").alias("simple")).union(part.select(one, F.lit("one"), "p_brand")).distinct()
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, own).when(k == 4, F.col("p_brand")).otherwise(F.col("p_type"))
    imports = F.when(k == 1, F.array(own)).when(k == 2, F.array(F.concat("p_brand", F.lit(".*")))).otherwise(F.array().cast("array<string>"))
    uses = part.select(F.col("p_partkey").alias("use_id"), name.alias("name"), F.when(k == 3, F.col("p_brand")).otherwise("none").alias("package"), imports.alias("imports"))
    return resolve.type_references(uses, types)


@query("WITH c AS (SELECT DISTINCT p_type AS collection, 'NATION_' || (p_partkey % 25) AS module, p_name AS name FROM part WHERE p_size < 10), u AS (SELECT DISTINCT 'NATION_' || s_nationkey AS service, t.p_type AS collection FROM supplier CROSS JOIN (SELECT DISTINCT p_type FROM part) t), scoped AS (SELECT u.service, u.collection, c.module, c.name FROM u JOIN c USING (collection) WHERE c.module = u.service OR EXISTS (SELECT 1 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey WHERE a.n_name = u.service AND b.n_name = c.module)) SELECT * FROM scoped UNION ALL SELECT u.service, u.collection, c.module, c.name FROM u JOIN c USING (collection) WHERE (SELECT count(*) FROM c x WHERE x.collection = u.collection) = 1 AND NOT EXISTS (SELECT 1 FROM scoped s WHERE s.service = u.service AND s.collection = u.collection)")
def persistence_owners(spark: SparkSession, d: str) -> DataFrame:
    part, n = _T(spark, d, "part"), _T(spark, d, "nation")
    classes = part.where("p_size < 10").select(F.col("p_type").alias("collection"), F.concat(F.lit("NATION_"), (F.col("p_partkey") % 25).cast("string")).alias("module"), F.col("p_name").alias("name")).distinct()
    uses = _T(spark, d, "supplier").select(F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("service")).distinct().crossJoin(F.broadcast(part.select(F.col("p_type").alias("collection")).distinct()))  # a few types
    below = n.select(F.col("n_name").alias("target"), "n_regionkey", F.col("n_nationkey").alias("k"))
    reach = n.join(F.broadcast(below), "n_regionkey").where("n_nationkey < k").select(F.col("n_name").alias("source"), "target")  # 25 rows
    return resolve.persistence_owners(uses, classes, reach)


@query("SELECT n_name AS name, coalesce(w, '') AS workloads FROM nation LEFT JOIN (SELECT 'NATION_' || s_nationkey AS name, array_to_string(list_sort(list('ns' || (s_suppkey % 3) || '/' || CASE WHEN s_suppkey % 2 = 0 THEN 'Deployment' ELSE 'Job' END)), ',') AS w FROM supplier GROUP BY s_nationkey) x ON n_name = x.name")
def with_workloads(spark: SparkSession, d: str) -> DataFrame:
    s = _T(spark, d, "supplier").select(F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("name"), F.concat(F.lit("ns"), (F.col("s_suppkey") % 3).cast("string")).alias("namespace"), F.when(F.col("s_suppkey") % 2 == 0, "Deployment").otherwise("Job").alias("kind"))
    out = resolve.with_workloads(_T(spark, d, "nation").select(F.col("n_name").alias("name")), s)
    return out.select("name", F.array_join(F.transform("workloads", lambda w: F.concat_ws("/", w["namespace"], w["kind"])), ",").alias("workloads"))


# Telemetry and traces


@query(with_views("SELECT service, transaction, ts FROM lat WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00'", "lat"))
def window_filter(spark: SparkSession, d: str) -> DataFrame:
    start, end = (F.lit(x).cast("timestamp") for x in ("2024-01-10 00:00:00", "2024-01-20 12:00:00"))
    return telemetry.in_window(T.latency_rows(spark, d), start, end).select("service", "transaction", "ts")


@query(with_views("SELECT service, transaction, p95_ms, error_rate, calls FROM merged ORDER BY coalesce(p95_ms, 0) DESC, coalesce(error_rate, 0) DESC, calls DESC, service, transaction LIMIT 30", "lat", hours=_hours("service, transaction"), merged=_merged("service, transaction")))
def latency_report_order(spark: SparkSession, d: str) -> DataFrame:
    rows = _latency(spark, d, ["service", "transaction"])
    return telemetry.top(rows, telemetry.latency_order(["service", "transaction"]), telemetry.VIEW_LIMITS["services"]).select("service", "transaction", "p95_ms", "error_rate", "calls")


@query(with_views("SELECT service, list_sort(list(duration_us))[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1] AS p95, list_sort(list(duration_us))[CAST(floor((count(*) - 1) * 0.5) AS BIGINT) + 1] AS p50 FROM spans GROUP BY service", "spans"))
def floor_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return T.spans(spark, d).groupBy("service").agg(telemetry.floor_percentile(F.col("duration_us"), 0.95).alias("p95"), telemetry.floor_percentile(F.col("duration_us"), 0.5).alias("p50"))


@query(with_views("SELECT * FROM depm WHERE source IS NOT NULL", "depm"))
def metric_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The first field has nothing, so the second one's rows count."""
    rows = dep_relations(spark, d)
    return telemetry.whole_query_fallback(rows.where("source = ''"), rows)


@query(with_views("SELECT trace_id, CASE WHEN bool_or(kind = 'messaging' AND ends_with(coalesce(p, ''), ' publish')) THEN 'topic' WHEN bool_or(trace_id % 3 = 0) THEN 'http_service' ELSE 'service' END AS source_kind FROM (SELECT s.trace_id, s.kind, q.name AS p FROM (SELECT *, CASE WHEN span_id % 2 = 1 AND trace_id % 4 = 0 THEN 'messaging' ELSE 'db' END AS kind FROM spans) s LEFT JOIN (SELECT trace_id, span_id, name || ' publish' AS name FROM spans) q ON q.trace_id = s.trace_id AND q.span_id = s.parent_id) GROUP BY trace_id", "spans"))
def source_kinds(spark: SparkSession, d: str) -> DataFrame:
    s = T.spans(spark, d)
    rows = s.withColumn("kind", F.when((F.col("span_id") % 2 == 1) & (F.col("trace_id") % 4 == 0), "messaging").otherwise("db")).withColumn("name", F.concat("name", F.lit(" publish"))).withColumn("method", F.when(F.col("trace_id") % 3 == 0, "GET"))
    return traces.source_kind(rows)


@query(with_views("SELECT trace_id, array_to_string(list(service ORDER BY ts, span_id), '>') AS route, CAST(sum(offset_us) AS BIGINT) AS offsets FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, service ORDER BY ts, span_id) AS n FROM spans) s JOIN (SELECT trace_id AS t, CAST(sum(ts - first) AS BIGINT) AS offset_us FROM (SELECT *, min(ts) OVER (PARTITION BY trace_id) AS first FROM spans) GROUP BY trace_id) o ON o.t = s.trace_id AND s.n = 1 GROUP BY trace_id, offset_us", "spans").replace("CAST(sum(offset_us) AS BIGINT) AS offsets", "offset_us AS offsets"))
def trace_routes(spark: SparkSession, d: str) -> DataFrame:
    s = T.spans(spark, d)
    first = s.groupBy("trace_id").agg(F.min("ts").alias("first"))
    offsets = s.join(first, "trace_id").groupBy("trace_id").agg(F.sum(F.greatest(F.lit(0), F.col("ts") - F.col("first"))).alias("offsets"))
    return traces.waterfall(s).select("trace_id", "route").join(offsets, "trace_id")


@query(with_views("SELECT 'waterfall-' || dense_rank() OVER (ORDER BY trace_id) AS ref, service, ts, duration_us FROM spans WHERE trace_id IN (SELECT DISTINCT trace_id FROM spans ORDER BY trace_id LIMIT 20)", "spans"))
def opaque_traces(spark: SparkSession, d: str) -> DataFrame:
    s = T.spans(spark, d)
    chosen = s.select("trace_id").distinct().orderBy("trace_id").limit(telemetry.VIEW_LIMITS["traces"])
    return traces.without_ids(traces.spans_of(s, chosen), traces.numbered(chosen, [F.col("trace_id")])).select("ref", "service", "ts", "duration_us")


@query("SELECT event_id FROM events WHERE event_id % 3 = 0 OR event_id % 5 = 0 OR event_id % 7 = 0")
def span_events(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    rows = _T(spark, d, "events").select("event_id", F.when(k % 3 == 0, "span").otherwise("transaction").alias("event"), F.when(k % 5 == 0, "a").alias("span_name"), F.when(k % 7 == 0, "b").alias("name"))
    return traces.span_events(rows).select("event_id")


@query("SELECT event_id AS trace_id, CASE WHEN event_id % 2 = 0 THEN 'e' || event_id ELSE 'n' || event_id END AS span_id, CASE WHEN event_id % 3 = 0 THEN 'p' WHEN event_id % 3 = 1 THEN 'q' END AS parent_id, CASE WHEN event_id % 4 = 0 THEN 'txn' WHEN event_id % 4 = 1 THEN 'span' ELSE 'root' END AS name, CASE WHEN event_id % 5 = 0 THEN value WHEN event_id % 5 = 1 THEN value * 2 ELSE value * 3 / 1000 END AS duration_us FROM events WHERE event_id % 11 > 0 AND event_id % 4 < 3")
def coalesced_spans(spark: SparkSession, d: str) -> DataFrame:
    k, v = F.col("event_id"), F.col("value")
    rows = _T(spark, d, "events").select(
        k.alias("trace_id"), F.when(k % 2 == 0, F.concat(F.lit("e"), k.cast("string"))).otherwise("").alias("span_id"), F.concat(F.lit("n"), k.cast("string")).alias("native_span_id"), F.when(k % 3 == 0, "p").alias("parent_id"), F.when(k % 3 == 1, "q").alias("native_parent_id"),
        F.when(k % 11 > 0, "svc").alias("service"), "ts", F.when(k % 4 == 0, "txn").alias("transaction_name"), F.when(k % 4 == 1, "span").alias("span_name"), F.when(k % 4 == 2, "root").alias("name"),
        F.when(k % 5 == 0, v).alias("transaction_duration_us"), F.when(k % 5 == 1, v * 2).alias("span_duration_us"), (v * 3).alias("duration"), F.lit("success").alias("outcome"),
    )
    return traces.coalesced(rows).select("trace_id", "span_id", "parent_id", "name", "duration_us")


@query(with_views("SELECT row_number() OVER (ORDER BY CASE trace_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, lower('S' || (trace_id % 7)), trace_id) AS place, trace_id FROM (SELECT DISTINCT trace_id FROM spans)", "spans"))
def trace_places(spark: SparkSession, d: str) -> DataFrame:
    t = T.spans(spark, d).select("trace_id").distinct().select("trace_id", F.when(F.col("trace_id") % 3 == 0, "http_service").when(F.col("trace_id") % 3 == 1, "topic").otherwise("service").alias("source_kind"), F.concat(F.lit("S"), (F.col("trace_id") % 7).cast("string")).alias("source"), F.col("trace_id").alias("ts"))
    rank, source, ts = traces.trace_order(t)
    return telemetry.running(t.select("trace_id", rank.alias("r"), source.alias("s"), ts.alias("t")), [], ["r", "s", "t"], F.lit(1), "place").select("place", "trace_id")


@query(with_views("SELECT trace_id, span_id, ts FROM spans WHERE trace_id IN (SELECT trace_id FROM spans GROUP BY trace_id HAVING count(DISTINCT service) > 1) ORDER BY ts, trace_id, span_id LIMIT 500", "spans"))
def timeline(spark: SparkSession, d: str) -> DataFrame:
    s = T.spans(spark, d)
    several = traces.multi_service_traces(s.withColumn("w", F.lit(0)), F.lit(0))
    return traces.timeline(s, several, telemetry.VIEW_LIMITS["timeline"]).select("trace_id", "span_id", "ts")


@query(f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'GET /a/' || event_type WHEN 1 THEN 'top.x' END AS label, {_pick_sql('event_id', 'db', 'other', 'request')} AS span_type, CASE event_id % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'failure' END AS error, replace('<b></b>' || event_type, '</', '<\\/') AS shown FROM events")
def shown_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    label = F.when(k % 4 == 0, F.concat(F.lit("GET /a/"), "event_type")).when(k % 4 == 1, "top.x").when(k % 4 == 2, "secret value of a user").otherwise("FETCH /x")
    rows = _T(spark, d, "events").select("event_id", label.alias("label"), _pick(k, "DB", "custom", "HTTP").alias("span_type"), _pick(k, "timeout", "failure", "java.lang.Error: x").alias("error"), F.concat(F.lit("<b></b>"), "event_type").alias("shown"))
    return traces.shown(rows).withColumn("shown", traces.embedded(F.col("shown")))


# Graphs over parts and suppliers


def _supply(spark: SparkSession, d: str) -> DataFrame:
    """Edges from lower to higher numbers and some back, within tens: a graph of the size of the tables."""
    s = _T(spark, d, "part").select(F.col("p_partkey").alias("k"))
    ahead = s.where("k % 10 + 1 + k % 3 < 10").select(F.concat(F.lit("n"), F.lpad(F.col("k").cast("string"), 9, "0")).alias("source"), F.concat(F.lit("n"), F.lpad((F.col("k") + 1 + F.col("k") % 3).cast("string"), 9, "0")).alias("target"))
    back = s.where("k % 10 = 9").select(F.concat(F.lit("n"), F.lpad(F.col("k").cast("string"), 9, "0")).alias("source"), F.concat(F.lit("n"), F.lpad((F.col("k") - 5).cast("string"), 9, "0")).alias("target"))
    return ahead.union(back).select("source", "target", F.lit("rest").alias("kind"), F.lit("").alias("label"))


def _number(value: str) -> str:
    return f"'n' || lpad(CAST({value} AS VARCHAR), 9, '0')"


_SUPPLY = f"SELECT {_number('p_partkey')} AS source, {_number('p_partkey + 1 + p_partkey % 3')} AS target FROM part WHERE p_partkey % 10 + 1 + p_partkey % 3 < 10 UNION SELECT {_number('p_partkey')}, {_number('p_partkey - 5')} FROM part WHERE p_partkey % 10 = 9"
_NEAR = "SELECT source, target FROM e UNION SELECT r.source, e.target FROM reach r JOIN e ON r.target = e.source"


@query(with_views("SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM (SELECT a.source AS node, least(a.source, min(a.target)) AS component FROM reach a JOIN reach b ON a.source = b.target AND a.target = b.source GROUP BY a.source)", recursive=True, e=_SUPPLY, reach=_NEAR))
def components_of_parts(spark: SparkSession, d: str) -> DataFrame:
    return graph.strong_components(_supply(spark, d))


@query(with_views("SELECT component, array_to_string(list_sort(list(node)), ',') AS nodes FROM (SELECT a.source AS node, least(a.source, min(a.target)) AS component FROM reach a JOIN reach b ON a.source = b.target AND a.target = b.source GROUP BY a.source) GROUP BY component HAVING count(*) >= 3 AND count(*) FILTER (right(node, 1) IN ('0', '2', '4', '6', '8')) >= 2 AND count(*) FILTER (right(node, 1) IN ('1', '3', '5', '7', '9')) >= 1", recursive=True, e=_SUPPLY, reach=_NEAR))
def event_cycles(spark: SparkSession, d: str) -> DataFrame:
    edges = _supply(spark, d)
    kinds = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct().withColumn("kind", F.when(F.right("node", F.lit(1)).cast("int") % 2 == 0, "service").otherwise("topic"))
    return graph.event_cycles(graph.strong_components(edges), kinds).select("component", F.array_join("nodes", ",").alias("nodes"))


@query(with_views("SELECT node, max(depth) AS layer FROM walk GROUP BY node", recursive=True, e=f"SELECT {_number('n_nationkey')} AS source, {_number('n_nationkey + 1 + n_nationkey % 4')} AS target FROM nation", walk="SELECT source AS node, 0 AS depth FROM e WHERE source NOT IN (SELECT target FROM e) UNION SELECT e.target, w.depth + 1 FROM walk w JOIN e ON e.source = w.node"))
def layers(spark: SparkSession, d: str) -> DataFrame:
    number = lambda c: F.concat(F.lit("n"), F.lpad(c.cast("string"), 9, "0"))
    k = F.col("n_nationkey")
    edges = _T(spark, d, "nation").select(number(k).alias("source"), number(k + 1 + k % 4).alias("target"))
    return graph.layers(edges, edges.select(F.col("source").alias("node")).union(edges.select("target")))


@query(with_views("SELECT 0 AS leg, 'n000000000' AS start, 'n000000007' AS \"end\", length, path FROM (SELECT *, min(length) OVER () AS best FROM walk WHERE node = 'n000000007') WHERE length = best UNION ALL SELECT 1, 'n000000007', 'n000000009', length, path FROM (SELECT *, min(length) OVER () AS best FROM walk2 WHERE node = 'n000000009') WHERE length = best", recursive=True, e=_SUPPLY, walk="SELECT 'n000000000' AS node, 'n000000000' AS path, 0 AS length UNION ALL SELECT e.target, w.path || ' -[]-> ' || e.target, w.length + 1 FROM walk w JOIN e ON w.node = e.source WHERE w.length < 6 AND NOT contains(w.path, e.target)", walk2="SELECT 'n000000007' AS node, 'n000000007' AS path, 0 AS length UNION ALL SELECT e.target, w.path || ' -[]-> ' || e.target, w.length + 1 FROM walk2 w JOIN e ON w.node = e.source WHERE w.length < 6 AND NOT contains(w.path, e.target)"))
def itinerary(spark: SparkSession, d: str) -> DataFrame:
    return graph.itinerary(_supply(spark, d), ["n000000000", "n000000007", "n000000009"])


@query(with_views("SELECT root, type FROM found", recursive=True, r="SELECT DISTINCT p_brand AS source, p_type AS target FROM part UNION SELECT DISTINCT p_type, p_name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2), p_brand FROM part", found="SELECT DISTINCT p_brand AS root, p_brand AS type FROM part WHERE length(p_brand) = 7 UNION SELECT f.root, r.target FROM found f JOIN r ON r.source = f.type"))
def type_closure(spark: SparkSession, d: str) -> DataFrame:
    part = _T(spark, d, "part")
    refs = part.select(F.col("p_brand").alias("source"), F.col("p_type").alias("target")).union(part.select("p_type", "p_name")).union(part.select(F.split_part("p_name", F.lit(" "), F.lit(2)), "p_brand")).distinct()
    return graph.type_closure(part.where("length(p_brand) = 7").select(F.col("p_brand").alias("root")), refs)


# State


@query("SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS n FROM documents) WHERE n = 1")
def last_wins(spark: SparkSession, d: str) -> DataFrame:
    return incremental.last_wins(_T(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), ["source"], [F.col("n_chars"), F.col("doc_id")]).select("doc_id", "source", "lang")


@query(with_views("SELECT path, h AS sha256 FROM prev WHERE path IN (SELECT path FROM cur)", "prev", "cur"))
def purged(spark: SparkSession, d: str) -> DataFrame:
    before, now = T.file_states(spark, d)
    return incremental.purged(before, incremental.hash_delta(before, now))


@query(with_views("SELECT count(*) FILTER (p.path IS NULL) AS added, count(*) FILTER (p.h <> c.h) AS modified, count(*) FILTER (c.path IS NULL) AS deleted, true AS stale FROM prev p FULL JOIN cur c ON p.path = c.path", "prev", "cur"))
def freshness(spark: SparkSession, d: str) -> DataFrame:
    return incremental.freshness(*T.file_states(spark, d))


@query(with_views("SELECT count(*) FILTER (p.path IS NULL) AS added, count(*) FILTER (p.h <> c.h) AS modified, count(*) FILTER (c.path IS NULL) AS deleted, count(*) FILTER (p.h = c.h) AS unchanged, (SELECT count(*) FROM cur) AS facts FROM prev p FULL JOIN cur c ON p.path = c.path", "prev", "cur"))
def index_report(spark: SparkSession, d: str) -> DataFrame:
    before, now = T.file_states(spark, d)
    return catalog.index_report(incremental.hash_delta(before, now), now)


@query("SELECT source AS \"case\", bool_or(doc_id % 10 < 3 AND (doc_id % 4 = 0 OR doc_id % 4 = 1)) AS \"full\", bool_or(doc_id % 10 < 3 AND (doc_id % 4 = 2 OR doc_id % 50 = 0)) AS contracts FROM documents GROUP BY source")
def promotions(spark: SparkSession, d: str) -> DataFrame:
    """By source: whether a changed build or configuration file, or a changed contract, asks for a full refresh."""
    docs = _T(spark, d, "documents").select("doc_id", "source")
    name = _pick(F.col("doc_id"), "pom.xml.bak", "x.Properties", "api.rest", "A.java")
    folder = F.when(F.col("doc_id") % 50 == 0, "model-x").otherwise("svc")
    path = F.when(F.col("doc_id") % 4 == 0, F.concat(folder, F.lit("/x.yml"))).otherwise(F.concat(folder, F.lit("/"), name))
    delta = docs.select("source", F.concat("source", F.lit("/"), path).alias("path"), F.when(F.col("doc_id") % 10 < 3, "modified").otherwise("unchanged").alias("status"))
    roots = docs.select(F.concat("source", F.lit("/model-x")).alias("folder")).distinct()
    changed = F.col("status").isin("modified", "deleted", "added") & F.col("path").rlike(incremental.BUILD_FILES)
    full = delta.groupBy("source").agg(F.bool_or(changed).alias("full"))
    inside = delta.where("status <> 'unchanged'").withColumn("folder", F.explode(resolve.ancestors(F.col("path")))).join(roots, "folder", "left_semi").select("source").distinct()
    own = delta.where("status <> 'unchanged'").where(F.col("path").rlike(r"(?i)\.rest$|pom\.xml$")).select("source").distinct()
    hit = inside.union(own).distinct().withColumn("contracts", F.lit(True))
    return full.join(hit, "source", "left").select(F.col("source").alias("case"), "full", F.coalesce("contracts", F.lit(False)).alias("contracts"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation")
def published_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Two versions are published; a reader sees the second one."""
    root, n = folder(spark), _T(spark, d, "nation")
    snapshot.publish(spark, root, {"nation": n})
    snapshot.publish(spark, root, {"nation": n.union(n.withColumn("n_nationkey", F.col("n_nationkey") + 100))}, {"signature": "2"})
    return snapshot.read(spark, root, "nation")


@query("SELECT 'a:' || s_suppkey AS id, 'a' AS system, CASE WHEN s_nationkey % 2 = 0 THEN 'a' ELSE s_name END AS source, s_name AS target FROM supplier UNION ALL SELECT 'b:' || s_suppkey, 'b', CASE WHEN s_nationkey % 2 = 0 THEN 'b' ELSE s_name END, s_name FROM supplier WHERE s_suppkey % 2 = 0")
def federated(spark: SparkSession, d: str) -> DataFrame:
    s = _T(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.when(F.col("s_nationkey") % 2 == 0, ".").otherwise(F.col("s_name")).alias("source"), F.col("s_name").alias("target"))
    return catalog.federated({"b": s.where("cast(id AS bigint) % 2 = 0"), "a": s}, local=".").select("id", "system", "source", "target")


@query("SELECT 'l_tax' AS missing UNION ALL SELECT 'nothing'")
def report_schema(spark: SparkSession, d: str) -> DataFrame:
    found = rules.missing_columns(_T(spark, d, "lineitem"), {"l_orderkey": "bigint", "l_tax": "array", "nothing": "string", "l_shipdate": "timestamp"})
    return spark.createDataFrame([(x,) for x in found], "missing string")


# Search


@query(with_views("SELECT id, path, severity FROM finding ORDER BY CASE severity WHEN 'ERROR' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END DESC, path NULLS FIRST, id LIMIT 50 OFFSET 20", "finding"))
def inventory_page(spark: SparkSession, d: str) -> DataFrame:
    return search.search(T.findings(spark, d), " ", offset=20, limit=50).select("id", "path", "severity")


@query("SELECT coalesce(lang, 'none') AS folder, count(*) AS n FROM documents GROUP BY ALL")
def findings_by_folder(spark: SparkSession, d: str) -> DataFrame:
    return search.summary(T.findings(spark, d).withColumn("path", F.coalesce("path", F.lit("none"))))[2]


@query("SELECT 'd' || doc_id AS path, 3 AS line, 1 AS first_line, array_to_string(list_slice(string_split(text, chr(10)), 1, 5), chr(10)) AS context FROM documents WHERE text IS NOT NULL")
def source_context(spark: SparkSession, d: str) -> DataFrame:
    docs = _T(spark, d, "documents").where("text IS NOT NULL").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "text")
    return search.context(docs, docs.select("path", F.lit(3).alias("line")), around=2)


# Sources: texts of files made from the tables


def _files(spark: SparkSession, d: str, path: Column, text: Column, table: str = "nation") -> DataFrame:
    return _T(spark, d, table).select(path.alias("path"), text.alias("text"))


@query("SELECT 'n' || n_nationkey || '/application.properties' AS path, key, value FROM nation CROSS JOIN (SELECT 'name' AS key UNION ALL SELECT 'url.base') k CROSS JOIN LATERAL (SELECT CASE WHEN key = 'name' THEN n_name || '=x' ELSE 'http://' || n_regionkey END AS value)")
def properties_files(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("# a comment\n\nname : old\n name="), "n_name", F.lit("=x\r\nurl.base:http://"), F.col("n_regionkey").cast("string"), F.lit("\n!no=1\nnothing"))
    return files.properties(_files(spark, d, F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit("/application.properties")), text))


@query("SELECT 'n' || n_nationkey || '.yml' AS path, key, value FROM nation CROSS JOIN (SELECT 'spring.application.name' AS key UNION ALL SELECT 'list[0]' UNION ALL SELECT 'list[1].flag') k CROSS JOIN LATERAL (SELECT CASE key WHEN 'spring.application.name' THEN n_name WHEN 'list[0]' THEN CAST(n_regionkey AS VARCHAR) ELSE 'true' END AS value) WHERE n_nationkey % 2 = 0")
def yaml_files(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("spring:\n  application:\n    name: "), "n_name", F.lit("\nlist:\n  - "), F.col("n_regionkey").cast("string"), F.lit("\n  - flag: true\n"), F.when(F.col("n_nationkey") % 2 == 1, "  bad: [\n").otherwise(""))
    return files.yaml_properties(_files(spark, d, F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".yml")), text))


@query("SELECT p_partkey AS id, 'k' || p_partkey || '.' || CASE p_partkey % 4 WHEN 0 THEN 'password' WHEN 1 THEN 'enabled' WHEN 2 THEN 'timeout' ELSE 'label' END AS key, CASE p_partkey % 4 WHEN 0 THEN '<secret>' WHEN 1 THEN 'false' WHEN 2 THEN '0' ELSE '<string>' END AS example FROM part")
def property_templates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    key = F.concat(F.lit("k"), k.cast("string"), F.lit("."), _pick(k, "password", "enabled", "timeout", "label"))
    text = F.when(k % 3 == 0, F.concat(F.lit('@Value("${'), key, F.lit(':x}") int a;'))).when(k % 3 == 1, F.concat(F.lit('env.getProperty( "'), key, F.lit('")'))).otherwise(F.concat(F.lit('@ConfigurationProperties(prefix = "'), key, F.lit('")')))
    found = files.property_templates(_files(spark, d, k.cast("string"), text, "part"))
    return found.select(F.col("path").cast("long").alias("id"), "key", "example")


@query("SELECT 'flows/' || r_regionkey || '.md' AS path, n_name AS module, CASE WHEN n_nationkey % 2 = 0 THEN 'produce' ELSE 'consume' END AS role, CASE WHEN n_nationkey % 3 = 0 THEN 'phys.' ELSE 'log.' END || n_nationkey AS topic FROM nation JOIN region ON n_regionkey = r_regionkey")
def markdown_manifests(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey").cast("string")
    block = F.concat(F.lit("### "), "n_name", F.when(F.col("n_nationkey") % 2 == 0, "\n**Producer**\n").otherwise("\n**Consumer**\n"), F.lit("| Topic | Nom physique |\n|---|---|\n| `log."), k, F.lit("` | "), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("`phys."), k, F.lit("`"))).otherwise(""), F.lit(" |\n"))
    texts = _T(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(block)), "\n").alias("text"))
    return manifests.markdown_topics(texts.select(F.concat(F.lit("flows/"), F.col("n_regionkey").cast("string"), F.lit(".md")).alias("path"), "text"))


@query("SELECT 'f' || s_suppkey || '.json' AS path, 'NATION_' || s_nationkey AS service, role, CASE WHEN role = 'produce' THEN 'phys' || s_suppkey ELSE 'plain' END AS topic FROM supplier CROSS JOIN (SELECT 'produce' AS role UNION ALL SELECT 'consume') r")
def flow_manifests(spark: SparkSession, d: str) -> DataFrame:
    name, own = F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")), F.concat(F.lit("phys"), F.col("s_suppkey").cast("string"))
    text = F.to_json(F.struct(F.create_map(F.lit("log"), own).alias("topics"), F.create_map(name, F.array(F.lit("log"))).alias("producers"), F.create_map(name, F.array(F.lit("plain"))).alias("consumers")))
    return manifests.flow_manifest(_files(spark, d, F.concat(F.lit("f"), F.col("s_suppkey").cast("string"), F.lit(".json")), text, "supplier"))


@query("SELECT 'api' || s_suppkey || '.json' AS path, m || ' /v1/s/' || s_suppkey AS topic FROM supplier CROSS JOIN (SELECT 'GET' AS m UNION ALL SELECT 'POST') x WHERE m = 'GET' OR s_suppkey % 2 = 0")
def openapi_contracts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit('{"paths":{"/v1//s/'), k, F.lit('":{"get":{"x":1},"parameters":[]'), F.when(F.col("s_suppkey") % 2 == 0, ',"post":{}').otherwise(""), F.lit("}}}"))
    return manifests.openapi_routes(_files(spark, d, F.concat(F.lit("api"), k, F.lit(".json")), text, "supplier"))


@query("SELECT 'Deployment' AS kind, 'ns' || n_regionkey AS namespace, n_name AS name, CAST(n_nationkey AS INTEGER) AS replicas, CASE WHEN n_nationkey % 2 = 0 THEN 250 + n_nationkey * 1000 ELSE 250 END AS cpu_request_millicores, -1 AS cpu_limit_millicores, CASE WHEN n_nationkey % 2 = 0 THEN 64 * 1048576 ELSE -1 END AS memory_request_bytes, CASE WHEN n_nationkey % 3 = 0 THEN 1000000000 ELSE -1 END AS memory_limit_bytes FROM nation")
def workload_lists(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey").cast("string")
    second = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(',{"resources":{"requests":{"cpu":"'), k, F.lit('","memory":"64Mi"}}}'))).otherwise("")
    limits = F.when(F.col("n_nationkey") % 3 == 0, ',"limits":{"memory":"1G"}').otherwise(',"limits":{"memory":"lots"}')
    item = F.concat(F.lit('{"kind":"Deployment","metadata":{"name":"'), "n_name", F.lit('","namespace":"ns'), F.col("n_regionkey").cast("string"), F.lit('"},"spec":{"replicas":'), k, F.lit(',"template":{"spec":{"containers":[{"resources":{"requests":{"cpu":"250m"}'), limits, F.lit("}}"), second, F.lit("]}}}}"))
    texts = _T(spark, d, "nation").agg(F.concat(F.lit('{"items":['), F.array_join(F.collect_list(item), ","), F.lit("]}")).alias("text"))
    return manifests.workloads(texts).fillna(-1)


_POM = "SELECT 'm/' || n_name AS folder, 'art-' || n_nationkey AS name, CASE WHEN n_nationkey % 2 = 0 THEN '1.' || n_nationkey ELSE 'p' || n_regionkey END AS version, 'dep' || n_regionkey AS dependencies, 'maven' AS build FROM nation"


def _poms(spark: SparkSession, d: str) -> DataFrame:
    k, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    version = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("<version>1."), k, F.lit("</version>"))).otherwise("")
    text = F.concat(F.lit('<project xmlns="http://maven.apache.org/POM/4.0.0"><parent><version>p'), r, F.lit("</version></parent><artifactId>art-"), k, F.lit("</artifactId>"), version, F.lit("<dependencies><dependency><artifactId>dep"), r, F.lit("</artifactId></dependency></dependencies></project>"))
    return _files(spark, d, F.concat(F.lit("m/"), "n_name", F.lit("/pom.xml")), text)


def _gradles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("archivesBaseName = 'g-"), k.cast("string"), F.lit("'\n"))).otherwise("")
    text = F.concat(name, F.lit('version = "2.0"\ndependencies { implementation project(":lib'), k.cast("string"), F.lit('") }'))
    return _files(spark, d, F.concat(F.when(k % 2 == 0, "m/").otherwise("g/"), "n_name", F.lit("/build.gradle")), text)


@query(f"SELECT * FROM ({_POM}) UNION ALL SELECT 'g/' || n_name, CASE WHEN n_nationkey % 3 = 0 THEN 'g-' || n_nationkey ELSE n_name END, '2.0', 'lib' || n_nationkey, 'gradle' FROM nation WHERE n_nationkey % 2 = 1")
def build_modules(spark: SparkSession, d: str) -> DataFrame:
    """Modules of POM and Gradle files; where a folder has both, the POM counts."""
    found = manifests.modules(manifests.maven_modules(_poms(spark, d)), manifests.gradle_modules(_gradles(spark, d)))
    return found.withColumn("dependencies", F.array_join("dependencies", ","))


@query("SELECT 'r' || n_regionkey AS root FROM nation WHERE n_nationkey < 5 UNION SELECT 'w/x' AS root")
def build_roots(spark: SparkSession, d: str) -> DataFrame:
    """The outermost build folders below a folder without a build file of its own."""
    k, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    paths = _T(spark, d, "nation").select(F.concat(F.lit("r"), r, F.when(F.col("n_nationkey") < 5, "/pom.xml").otherwise(F.concat(F.lit("/sub"), k, F.lit("/build.gradle")))).alias("path"))
    return files.build_roots(paths.union(spark.createDataFrame([("w/x/settings.gradle",), ("a/b/c/d/e/f/g/pom.xml",), ("w/.git/pom.xml",), ("w/readme",)], "path string")))


_YAML = "SELECT 'gw' || s_suppkey || '.yml' AS path, 'svc-' || s_nationkey AS target, s_suppkey % 3 AS strip FROM supplier WHERE s_suppkey % 4 > 0"


@query(f"WITH g AS ({_YAML}) SELECT path, 'serve' AS role, 'ANY /' || p || '/' || path || '/**' AS topic, target, CAST(strip AS INTEGER) AS strip FROM g CROSS JOIN (SELECT 'a' AS p UNION ALL SELECT 'b') x UNION SELECT path, 'call', 'ANY /' || array_to_string(list_slice([p, path, '**'], strip + 1, 3), '/'), target, CAST(strip AS INTEGER) FROM g CROSS JOIN (SELECT 'a' AS p UNION ALL SELECT 'b') x")
def gateway_yaml(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("s_suppkey"), F.concat(F.lit("gw"), F.col("s_suppkey").cast("string"), F.lit(".yml"))
    uri = F.when(k % 4 == 0, "http://x").otherwise(F.concat(F.lit("lb://svc-"), F.col("s_nationkey").cast("string")))
    text = F.concat(F.lit("spring:\n  cloud:\n    gateway:\n      routes:\n        - id: one\n          uri: "), uri, F.lit("\n          predicates:\n            - Method=GET\n            - Path=/a/"), name, F.lit("/**, /b//"), name, F.lit("/**\n          filters:\n            - StripPrefix="), (k % 3).cast("string"), F.lit("\n"))
    return manifests.gateway_routes(files.yaml_properties(_files(spark, d, name, text, "supplier")))


@query("SELECT 'n' || n_nationkey || '.yml' AS path, 'GET /actuator/**' AS topic FROM nation WHERE n_nationkey % 3 = 0")
def actuators(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("n_nationkey") % 3 == 0, "'*'").otherwise("health,info")
    text = F.concat(F.lit("management:\n  endpoints:\n    web:\n      exposure:\n        include: "), value, F.lit("\n"))
    return manifests.actuators(files.yaml_properties(_files(spark, d, F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".yml")), text)))


@query("SELECT 'svc/My_Api' || s_suppkey || '.rest' AS path, 'GET /v/' || s_suppkey AS topic, CASE WHEN s_suppkey % 2 = 0 THEN 'x/my-api' || s_suppkey || '.json' ELSE 'model-my-api' || s_suppkey || '/src/main/resources/openapi/other.json' END AS contract FROM supplier")
def declared_contracts(spark: SparkSession, d: str) -> DataFrame:
    s = _T(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_suppkey").cast("string").alias("k"))
    path = F.when(F.col("i") % 2 == 0, F.concat(F.lit("x/my-api"), "k", F.lit(".json"))).otherwise(F.concat(F.lit("model-my-api"), "k", F.lit("/src/main/resources/openapi/other.json")))
    contracts = s.select(path.alias("path"), F.concat(F.lit('{"paths":{"/v/'), "k", F.lit('":{"get":{}}}}')).alias("text"))
    declarations = s.select(F.concat(F.lit("svc/My_Api"), "k", F.lit(".rest")).alias("path"))
    return manifests.declared_contracts(declarations, contracts, manifests.openapi_routes(contracts))


# Java sources made of pages: controllers, clients, listeners, senders, repositories, configurations


def _java(spark: SparkSession, d: str) -> DataFrame:
    """A file for each page; a comment of several thousand characters stands between its declarations."""
    k = F.col("page_id").cast("string")
    long = F.concat(F.lit("  /* "), F.repeat(F.lit("words and (signs { "), 200), F.lit(" */\n"))
    serve = F.concat(
        F.lit('package a;\n@RestController @RequestMapping("/r'), (F.col("page_id") % 7).cast("string"), F.lit('")\nclass C {\n'), long, F.lit('  @GetMapping(value = "/p/'), k, F.lit('/{x}", produces = "a/b")\n  A get(@PathVariable String x, @Valid @RequestParam(name = "q") String query,\n'),
        long, F.lit("    @RequestParam int page) { return null; }\n  @KafkaListener(topics = {\"in."), k, F.lit('", "${in.key:dflt}"})\n  void on(@Payload Order o) { lock.lock(); }\n}\n@Document class Item { private String name; private final List<Item> parts = null; }\nenum Kind { ONE, TWO }\n'),
    )
    call = F.concat(
        F.lit('class D {\n  @Value("${base}") private String base;\n  void a(String id) {\n    restTemplate.getForObject("http://h" + "/a/'), k, F.lit('/" + id, String.class);\n    client.post()\n'), long, F.lit('      .uri("/w/'), k, F.lit('?x=1").retrieve();\n    kafkaTemplate.send("out.'), k,
        F.lit('", new Order(1));\n    envoyerMessageKafka(p.getTopics().getOrderPaid(), order);\n    restTemplate.put(base + "/z", order);\n    Thread.sleep(1);\n  }\n  public static void main(String[] a) { SpringApplication.run(D.class, a); }\n}\ninterface R extends JpaRepository<Category, Long> { @RestResource(path = "by") List<Category> findByX(String x); Category one(); }\n@EnableSwagger2 class RestClientConfig { Object o() { m.get(MY_DOMAIN); return getRest().get("partner"); } }\n'),
    )
    broken = F.when(F.col("page_id") % 10 == 9, "class E { void x() { }").otherwise(F.when(F.col("page_id") % 2 == 1, serve).otherwise(call))
    return _T(spark, d, "pages").select(F.concat(F.lit("m"), (F.col("page_id") % 4).cast("string"), F.lit("/P"), k, F.lit(".java")).alias("path"), broken.alias("text"))


_J = "SELECT page_id AS k, 'm' || (page_id % 4) || '/P' || page_id || '.java' AS path, CASE WHEN page_id % 10 = 9 THEN 'broken' WHEN page_id % 2 = 1 THEN 'serve' ELSE 'call' END AS kind FROM pages"
_SERVES = ["'rest', 'serve', 'GET /r' || (k % 7) || '/p/' || k || '/{x}?q&page', 'spring-mvc'", "'kafka', 'consume', 'in.' || k, 'spring-kafka'", "'kafka', 'consume', '${in.key:dflt}', 'spring-kafka'", "'blocking', NULL, NULL, 'lock'", "'collection', NULL, 'item', 'mongodb'", "'field', 'String', 'name', 'Item'", "'field', 'List<Item>', 'parts', 'Item'", "'field', 'enum', 'ONE', 'Kind'", "'field', 'enum', 'TWO', 'Kind'"]
_CALLS = ["'rest', 'call', 'GET /a/' || k || '/{id}', 'resttemplate'", "'rest', 'call', 'POST /w/' || k, 'webclient'", "'kafka', 'produce', 'out.' || k, 'kafka'", "'kafka', 'produce', 'ORDER_PAID', 'kafka-convention'", "'rest', 'call', 'PUT /${base}/z', 'resttemplate'", "'blocking', NULL, NULL, 'sleep'", "'entry', NULL, NULL, 'spring-boot'", "'rest', 'serve', 'GET /swagger-ui.html', 'swagger-ui'", "'rest', 'call', 'ANY <dynamic>', 'configured-client'", "'rest', 'call', 'ANY <dynamic>', 'configured-external'", "'field', 'String', 'base', 'D'"]
_DATA = ["GET /categories", "POST /categories", "GET /categories/{id}", "PUT /categories/{id}", "PATCH /categories/{id}", "DELETE /categories/{id}", "GET /categories/search/by", "GET /categories/search/one"]
_CALLS += [f"'rest', 'serve', '{t}', 'spring-data-rest-default'" for t in _DATA]
_FACTS = " UNION ALL ".join([*(f"SELECT path, {x} FROM j WHERE kind = 'serve'" for x in _SERVES), *(f"SELECT path, {x} FROM j WHERE kind = 'call'" for x in _CALLS), "SELECT path, 'diagnostic', NULL, NULL, 'unparseable' FROM j WHERE kind = 'broken'"])


@query(f"WITH j AS ({_J}), f(path, fact, role, topic, framework) AS ({_FACTS}) SELECT * FROM f")
def java_facts(spark: SparkSession, d: str) -> DataFrame:
    return java.facts(_java(spark, d)).select("path", "fact", "role", "topic", "framework")


@query(f"WITH j AS ({_J}), f(path, fact, role, topic, framework) AS ({_FACTS}) SELECT path, topic, framework FROM f WHERE framework LIKE 'spring-data%' AND path LIKE 'm2/%'")
def repository_routes(spark: SparkSession, d: str) -> DataFrame:
    """Default repository routes, in the one module that has the starter."""
    modules = spark.createDataFrame([("m0", ["web"]), ("m2", ["web", "spring-boot-starter-data-rest"])], "folder string, dependencies array<string>")
    found = java.with_starter(java.facts(_java(spark, d)), modules)
    return found.where(F.col("framework").startswith("spring-data")).select("path", "topic", "framework")


@query(f"WITH j AS ({_J}) SELECT path, CASE WHEN kind = 'serve' THEN CASE path[1:2] WHEN 'm1' THEN 'near' ELSE 'dflt' END ELSE CASE WHEN path LIKE 'm0/%' THEN 'PUT /root/z' ELSE 'PUT /${{base}}/z' END END AS topic, kind = 'call' AND path NOT LIKE 'm0/%' AS topic_dynamic FROM j WHERE kind <> 'broken'")
def resolved_topics(spark: SparkSession, d: str) -> DataFrame:
    """Placeholders by the nearest property, else the default, else left dynamic."""
    properties = spark.createDataFrame([("m1", 0, "in.key", "near"), ("m1", 1, "in.key", "later"), ("m0", 0, "base", "/root")], "folder string, rank int, key string, value string")
    found = java.facts(_java(spark, d))
    return java.resolved(found.where(F.col("topic").contains("${")), properties).select("path", "topic", "topic_dynamic")


@query(f"WITH j AS ({_J}) SELECT path, 'orders-' || (k % 4) AS system, substr(sha256('produce|out.' || k || '|' || path || '|8:8'), 1, 16) AS id FROM j WHERE kind = 'call' AND k % 4 = 0")
def java_endpoint_ids(spark: SparkSession, d: str) -> DataFrame:
    e = java.endpoints(java.facts(_java(spark, d).where("path LIKE 'm0/%'")), "orders-0")
    return e.where("topic LIKE 'out.%'").select("path", "system", "id")
