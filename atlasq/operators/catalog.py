"""Relations, summaries and the catalog over a snapshot's fact tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from . import graph, resolve

#: Names of the catalog's kinds.
KINDS = {"microservice": "microservices", "service": "microservices", "services": "microservices", "microservices": "microservices", "module": "modules", "modules": "modules", "topic": "topics", "topics": "topics", "api": "apis", "apis": "apis", "endpoint": "apis", "collection": "collections", "collections": "collections", "mongodb": "collections"}
#: Fixed value: operations that write to a collection.
WRITES = ("bulkOps", "findAndModify", "findAndReplace", "insert", "remove", "save", "updateFirst", "updateMulti", "upsert")
#: What a role says of a service and a topic or API.
ROLE_RELATIONS = {"produce": ("publishes", "topic"), "consume": ("consumes", "topic"), "serve": ("provides", "api"), "call": ("calls", "api")}


def relations(endpoints: DataFrame, rest: DataFrame, topic: DataFrame) -> DataFrame:
    """Typed relations with stable ids: what services do with topics and APIs, and the edges between services."""
    def row(source_kind: Column, source: Column, relation: Column, target_kind: Column, target: Column, path: Column, line: Column) -> list[Column]:
        return [E.relation_id(source_kind, source, relation, target_kind, target, path, line).alias("id"), source_kind.alias("source_kind"), source.alias("source"), relation.alias("relation"), target_kind.alias("target_kind"), target.alias("target")]

    names = F.create_map(*(F.lit(x) for role, (rel, _) in ROLE_RELATIONS.items() for x in (role, rel)))
    kinds = F.create_map(*(F.lit(x) for role, (_, kind) in ROLE_RELATIONS.items() for x in (role, kind)))
    service, null = F.lit("microservice"), F.lit(None).cast("string")
    facts = endpoints.select(*row(service, F.col("system"), F.element_at(names, F.col("role")), F.element_at(kinds, F.col("role")), F.col("topic"), F.col("path"), F.col("start_line")))
    calls = rest.select(*row(service, F.col("source"), F.lit("calls_service"), service, F.col("target"), null, null))
    flows = topic.select(*row(service, F.col("source"), F.lit("publishes_to"), service, F.col("target"), null, null))
    return facts.unionByName(calls).unionByName(flows).dropDuplicates(["id"])


def more_relations(endpoints: DataFrame, dependencies: DataFrame, methods: DataFrame, modules: DataFrame, prefix: str = "retour_") -> DataFrame:
    """The other kinds, with their confidence: depends_on, implements, uses_configuration, publishes_type, consumes_type,
    request_reply, reads and writes. endpoints also have ``qualified_name``; dependencies: (source, target); methods: (module,
    owner_method, operation, collection, path, line); modules: (name, starts_application)."""
    kinds = modules.select(F.col("name").alias("m"), F.when(F.col("starts_application"), "microservice").otherwise("module").alias("k"))

    def kind_of(df: DataFrame, column: str, alias: str) -> DataFrame:
        return df.join(kinds.select(F.col("m").alias(column), F.col("k").alias(alias)), column, "left").withColumn(alias, F.coalesce(alias, F.lit("module")))

    def row(df: DataFrame, source_kind: Column, source: Column, relation: Column, target_kind: Column, target: Column, confidence: Column, path: Column, line: Column) -> DataFrame:
        return df.select(E.relation_id(source_kind, source, relation, target_kind, target, path, line).alias("id"), source_kind.alias("source_kind"), source.alias("source"), relation.alias("relation"), target_kind.alias("target_kind"), target.alias("target"), confidence.alias("confidence"))

    high, null = F.lit("high"), F.lit(None).cast("string")
    sure = F.when(F.col("topic_dynamic"), "medium").otherwise("high")
    place, line = F.col("path"), F.col("start_line")
    kafka = F.col("role").isin("produce", "consume")
    target_kind = F.when(kafka, "topic").otherwise("api")
    depends = kind_of(kind_of(dependencies, "source", "source_kind"), "target", "target_kind")
    out = row(depends, F.col("source_kind"), F.col("source"), F.lit("depends_on"), F.col("target_kind"), F.col("target"), high, null, null)
    of = kind_of(endpoints.where("module IS NOT NULL"), "module", "own_kind")
    out = out.union(row(of.where("qualified_name IS NOT NULL"), F.lit("class"), F.col("qualified_name"), F.lit("implements"), target_kind, F.col("topic"), sure, place, line))
    keyed = of.withColumn("key", F.explode(F.array_distinct(F.regexp_extract_all("snippet", F.lit(r"\$\{([^}:]+)"), F.lit(1)))))
    out = out.union(row(keyed, F.when(F.col("qualified_name").isNotNull(), "class").otherwise(F.col("own_kind")), F.coalesce("qualified_name", "module"), F.lit("uses_configuration"), F.lit("property"), F.col("key"), sure, place, line))
    typed = of.where(kafka & F.col("message_type").isNotNull())
    out = out.union(row(typed, F.lit("topic"), F.col("topic"), F.when(F.col("role") == "produce", "publishes_type").otherwise("consumes_type"), F.lit("dto"), F.col("message_type"), sure, place, line))
    replies = resolve.request_reply(of.where(kafka & ~F.col("topic_dynamic")), prefix)
    out = out.union(row(replies, F.lit("topic"), F.col("request"), F.lit("request_reply"), F.lit("topic"), F.col("reply"), high, null, null))
    used = kind_of(methods.where("collection IS NOT NULL"), "module", "own_kind")
    how = F.when(F.col("operation").isin(*WRITES), "writes").otherwise("reads")
    out = out.union(row(used, F.col("own_kind"), F.col("module"), how, F.lit("collection"), F.col("collection"), high, place, F.col("line")))
    owned = used.where("owner_method IS NOT NULL")
    out = out.union(row(owned, F.lit("method"), F.concat_ws(":", "module", "owner_method"), how, F.lit("collection"), F.col("collection"), high, place, F.col("line")))
    return out.dropDuplicates(["id"])


def unresolved(endpoints: DataFrame, rest: DataFrame, limit: int = 20) -> DataFrame:
    """(list, module, topic, role, path, line, truncated): dynamic topics, untyped messages and unmatched calls, the first
    ``limit`` of each by module, topic, path and line; ties go by message type (null last), role and id."""
    kafka = endpoints.where(F.col("role").isin("produce", "consume"))
    calls = endpoints.where("role = 'call'").join(rest.select(F.col("call_id").alias("id")).distinct(), "id", "left_anti")
    columns = ["module", "topic", "role", "path", F.col("start_line").alias("line")]
    out = None
    for name, rows in (("dynamic_kafka_topics", kafka.where("topic_dynamic")), ("unknown_kafka_message_types", kafka.where("message_type IS NULL")), ("unmatched_http_calls", calls)):
        n = F.broadcast(rows.agg((F.count("*") > limit).alias("truncated")))  # one row
        first = rows.orderBy("module", "topic", "path", "start_line", F.asc_nulls_last("message_type"), "role", "id").limit(limit)
        one = first.select(F.lit(name).alias("list"), *columns).crossJoin(n)
        out = one if out is None else out.union(one)
    return out


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes by kind, edges, and how many of them are configured clients."""
    by = [F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(name) for k, name in (("microservice", "microservices"), ("topic", "topics"), ("collection", "collections"), ("api", "apis"))]
    configured = F.sum(F.when((F.col("kind") == "http") & F.col("label").endswith(": API"), 1).otherwise(0))
    return nodes.agg(*(F.coalesce(c, F.lit(0)) for c in by)).toDF("microservices", "topics", "collections", "apis").crossJoin(F.broadcast(edges.agg(F.count("*").alias("relations"), F.coalesce(configured, F.lit(0)).alias("configured"))))  # one row each


def visual_edges(edges: DataFrame) -> DataFrame:
    """(source_kind, source, target_kind, target, label, kind), once each: calls as they are, and topics as nodes between
    their services; of equal ones with several kinds the lowest counts. edges: (source, target, kind, label)."""
    def part(df: DataFrame, source_kind: str, source: str, target_kind: str, target: str) -> DataFrame:
        return df.select(F.lit(source_kind).alias("source_kind"), F.col(source).alias("source"), F.lit(target_kind).alias("target_kind"), F.col(target).alias("target"), "label", "kind")

    topics = edges.where("kind = 'kafka'").withColumn("topic", F.col("label"))
    both = part(edges.where("kind <> 'kafka'"), "microservice", "source", "microservice", "target").union(part(topics, "microservice", "source", "kafka_topic", "topic")).union(part(topics, "kafka_topic", "topic", "microservice", "target"))
    return both.groupBy("source_kind", "source", "target_kind", "target", "label").agg(F.min("kind").alias("kind"))


def known_services(endpoints: DataFrame, modules: DataFrame) -> DataFrame:
    return endpoints.select(F.col("module").alias("service")).union(modules.select("name")).where("service IS NOT NULL").distinct()


def missing_services(runtime: DataFrame, known: DataFrame) -> DataFrame:
    """Services seen at run time that no index has."""
    return runtime.select("service").distinct().join(known.select("service").distinct(), "service", "left_anti")


def exportable(services: DataFrame) -> DataFrame:
    """Without test services and names that are unresolved placeholders."""
    return services.where(~F.lower("service").contains("test") & ~F.col("service").rlike(r"^\$\{.*\}$"))


def runtime_modules(modules: DataFrame) -> DataFrame:
    return modules.where("starts_application")


def endpoint_sites(endpoints: DataFrame) -> DataFrame:
    """One line for each endpoint: where it stands and what it does."""
    return endpoints.select("id", "module", "role", "topic", F.concat_ws(":", "path", F.col("start_line").cast("string")).alias("site"))


def by_module(endpoints: DataFrame, keep_null: bool) -> DataFrame:
    """(module, n): endpoints by module; those without one are left out, or a group of their own."""
    return (endpoints if keep_null else endpoints.where("module IS NOT NULL")).groupBy("module").agg(F.count("*").alias("n"))


def complexity(nodes: DataFrame, edges: DataFrame, findings: DataFrame) -> DataFrame:
    """(node, kind, relations, level, findings by severity): how many relations end at each node; only services get a level,
    by terciles. findings: (service, severity)."""
    from .telemetry import soft_terciles

    ends = edges.select(F.col("source").alias("node")).union(edges.select("target")).groupBy("node").agg(F.count("*").alias("relations"))
    rows = nodes.select(F.col("id").alias("node"), "kind").join(ends, "node", "left").withColumn("relations", F.coalesce("relations", F.lit(0)))
    tiers = soft_terciles(rows.where("kind = 'microservice'"), "relations", "node", "kind")
    level = tiers.select("node", F.when(F.col("tier") == 1, "low").when(F.col("tier") == 2, "medium").otherwise("high").alias("level"))
    counts = findings.groupBy(F.col("service").alias("node")).agg(*(F.sum(F.when(F.col("severity") == s, 1).otherwise(0)).alias(s.lower()) for s in E.SEVERITIES))
    out = rows.join(level, "node", "left").join(counts, "node", "left")
    return out.select("node", "kind", "relations", "level", *(F.when(F.col("kind") == "microservice", F.coalesce(s.lower(), F.lit(0))).alias(s.lower()) for s in E.SEVERITIES))


def index_report(delta: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: files by what happened to them, and the facts that stand."""
    by = [F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(s) for s in ("added", "modified", "deleted", "unchanged")]
    return delta.agg(*by).crossJoin(F.broadcast(facts.agg(F.count("*").alias("facts"))))  # one row


def evidence_join(relations: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Relations with the endpoint at their place, and the first serving or consuming endpoint of the same topic."""
    left = endpoints.select("module", "path", F.col("start_line").alias("line"), "role", F.col("id").alias("source_endpoint"), "topic")
    first = endpoints.where(F.col("role").isin("serve", "consume")).groupBy("topic").agg(F.min("id").alias("target_endpoint"))
    return relations.join(left, ["module", "path", "line", "role"]).join(first, "topic", "left")


def summary_of(endpoints: DataFrame, roles: tuple[str, str]) -> DataFrame:
    """(name, and the sorted services on either side) of topics or APIs."""
    sides = [F.sort_array(F.collect_set(F.when(F.col("role") == role, F.col("system")))).alias(role) for role in roles]
    return endpoints.where(F.col("role").isin(*roles)).groupBy(F.col("topic").alias("name")).agg(*sides)


def module_summary(endpoints: DataFrame) -> DataFrame:
    """What each module publishes, consumes, serves and calls, and which technologies that are; one pass."""
    sets = {role: F.sort_array(F.collect_set(F.when(F.col("role") == role, F.col("topic")))) for role in ROLE_RELATIONS}
    out = endpoints.groupBy("module").agg(*(v.alias(k) for k, v in sets.items()))
    tech = F.array_join(F.array_compact(F.array(F.when((F.size("produce") > 0) | (F.size("consume") > 0), F.lit("kafka")), F.when((F.size("serve") > 0) | (F.size("call") > 0), F.lit("rest")))), ",")
    return out.withColumn("technologies", tech)


def coverage(relations: DataFrame) -> DataFrame:
    return relations.groupBy("relation").agg(F.count("*").alias("n"))


def typed_graph(endpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind) and edges (source, target, kind): services, topics and APIs; a dynamic topic belongs to its service."""
    topic = F.when(F.col("topic_dynamic"), F.concat_ws(":", "system", "topic")).otherwise(F.col("topic"))
    rows = endpoints.select("system", "role", topic.alias("topic"), F.when(F.col("role").isin("produce", "consume"), "topic").otherwise("api").alias("kind"))
    nodes = rows.select(F.col("system").alias("id"), F.lit("microservice").alias("kind")).union(rows.select(F.col("topic").alias("id"), "kind")).distinct()
    out = F.col("role").isin("produce", "call")
    edges = rows.select(F.when(out, F.col("system")).otherwise(F.col("topic")).alias("source"), F.when(out, F.col("topic")).otherwise(F.col("system")).alias("target"), F.col("role").alias("kind")).distinct()
    return nodes, edges


def filtered_endpoints(endpoints: DataFrame, system: str | None = None, role: str | None = None, topic: str | None = None, path_glob: str | None = None, module: str | None = None) -> DataFrame:
    out = endpoints
    for column, value in (("system", system), ("role", role), ("topic", topic), ("module", module)):
        out = out if value is None else out.where(F.col(column) == value)
    return (out if path_glob is None else out.where(E.glob(F.col("path"), path_glob))).orderBy("path", "start_line", "id")


def external_calls(endpoints: DataFrame, rest: DataFrame) -> DataFrame:
    """(module, topic) of calls without an edge."""
    calls = endpoints.where("role = 'call'")
    return calls.join(rest.select(F.col("call_id").alias("id")).distinct(), "id", "left_anti").groupBy("module").agg(F.sort_array(F.collect_set("topic")).alias("topics"))


def federated(parts: dict[str, DataFrame], local: str | None = None) -> DataFrame:
    """Tables of several services as one: ids carry the service, so equal local ids stay apart. local: the name by which each
    snapshot means itself; ends of edges that have it become the service."""
    out = None
    for service, df in sorted(parts.items()):
        one = df.withColumn("id", F.concat(F.lit(f"{service}:"), "id")).withColumn("system", F.lit(service))
        for c in ("source", "target"):
            if local is not None and c in df.columns:
                one = one.withColumn(c, F.when(F.col(c) == local, F.lit(service)).otherwise(F.col(c)))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


@dataclass(frozen=True)
class Catalog:
    """The questions of one snapshot. Each method is a lazy DataFrame that Catalyst prunes."""

    endpoints: DataFrame
    names: DataFrame
    modules: DataFrame | None = None

    def rest_edges(self) -> DataFrame:
        return resolve.rest_edges(self.endpoints, self.names)

    def topic_edges(self) -> DataFrame:
        return resolve.topic_edges(self.endpoints)

    def service_edges(self) -> DataFrame:
        rest = self.rest_edges().select("source", "target", F.lit("rest").alias("kind"), F.col("topic").alias("label"))
        return rest.union(self.topic_edges().select("source", "target", F.lit("kafka").alias("kind"), F.col("topic").alias("label"))).distinct()

    def list(self, kind: str) -> DataFrame:
        kind = KINDS[kind.lower()]
        if kind == "microservices":
            return self.endpoints.select(F.col("system").alias("name")).distinct().orderBy("name")
        if kind == "modules":
            return module_summary(self.endpoints).orderBy("module")
        if kind == "topics":
            return summary_of(self.endpoints, ("produce", "consume")).orderBy("name")
        if kind == "apis":
            return summary_of(self.endpoints, ("serve", "call")).orderBy("name")
        return self.modules.select(F.explode("mongo_collections").alias("name"), F.col("name").alias("module")).groupBy("name").agg(F.sort_array(F.collect_set("module")).alias("modules")).orderBy("name")

    def show(self, kind: str, name: str) -> DataFrame:
        column = "module" if KINDS[kind.lower()] == "modules" else "name"
        return self.list(kind).where(F.col(column) == name)

    def neighbours(self, name: str) -> DataFrame:
        return graph.neighbours(typed_graph(self.endpoints)[1]).where(F.col("node") == name).orderBy("direction", "relation", "neighbour")

    def impact(self, name: str) -> DataFrame:
        """What hangs on the object of that name, of the first kind that has it: module, topic, API, collection."""
        near = graph.neighbours(typed_graph(self.endpoints)[1]).where(F.col("node") == name)
        modules = near.where(F.col("node").isin([name])).join(self.endpoints.where(F.col("module") == name).select(F.col("module").alias("node")).distinct(), "node", "left_semi")
        parts = [modules, *(near.where(F.col("relation").isin(*roles) & (F.col("direction") == way)) for roles, way in ((("produce",), "in"), (("consume",), "out"), (("call",), "in"), (("serve",), "out")))]
        rank = (0, 1, 1, 2, 2)
        out = None
        for k, part in zip(rank, parts):
            one = part.select(F.lit(k).alias("rank"), "relation", "neighbour")
            out = one if out is None else out.union(one)
        if self.modules is not None:
            held = self.modules.select(F.explode("mongo_collections").alias("c"), F.col("name").alias("neighbour")).where(F.col("c") == name)
            out = out.union(held.select(F.lit(3), F.lit("stores"), "neighbour"))
        first = F.broadcast(out.agg(F.min("rank").alias("first")))  # one row
        return out.join(first, out["rank"] == first["first"]).select("relation", "neighbour").distinct().orderBy("relation", "neighbour")

    def paths(self, start: str, end: str, max_depth: int = 12, limit: int = 20) -> DataFrame:
        spark = self.endpoints.sparkSession
        return graph.shortest_paths(self.service_edges(), spark.createDataFrame([(start,)], "node string"), spark.createDataFrame([(end,)], "node string"), max_depth, limit)

    def flows(self, topic: str, max_depth: int = 6, limit: int = 50) -> DataFrame:
        side = self.endpoints.where(~F.col("topic_dynamic"))
        use = side.where("role = 'consume'").select("topic", F.col("system").alias("service"))
        make = side.where("role = 'produce'").select("topic", F.col("system").alias("service"))
        return graph.flow_trace(use, make, self.endpoints.sparkSession.createDataFrame([(topic,)], "topic string"), max_depth, limit)
