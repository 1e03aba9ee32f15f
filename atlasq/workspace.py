"""A source tree as a workspace: configuration, indexing into published snapshots, and the questions of its snapshot.

``index`` reads files, extracts facts and publishes the tables ``files``, ``endpoints``, ``modules``, ``dependencies`` and
``facts`` as one version. ``Tools`` answers over the published version, one DataFrame a question.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import expr as E
from .operators import catalog, graph, incremental, resolve, rules, search
from .sources import files, java, manifests, snapshot

#: What is scanned where nothing else is configured.
INCLUDE, EXCLUDE = ("**/*",), ("*/target/*", "*/build/*", "*/node_modules/*")
#: A change of extraction rules changes this, and with it every index is built anew.
SIGNATURE = "2"


@dataclass(frozen=True)
class Config:
    """Settings of a workspace."""

    include: tuple[str, ...] = INCLUDE
    exclude: tuple[str, ...] = EXCLUDE
    min_severity: str = "INFO"

    def __post_init__(self) -> None:
        if self.min_severity not in E.SEVERITIES:
            raise ValueError(f"min_severity {self.min_severity!r} is none of {', '.join(E.SEVERITIES)}")

    @classmethod
    def parsed(cls, text: str) -> Config:
        """From YAML text; what it doesn't name keeps its default."""
        import yaml

        given = yaml.safe_load(text) or {}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in cls.__dataclass_fields__})

    def text(self) -> str:
        import yaml

        return yaml.safe_dump({"include": list(self.include), "exclude": list(self.exclude), "min_severity": self.min_severity}, sort_keys=False)


def _properties(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """(folder, rank, key, value) of configuration files; a file below src/main/resources speaks for its module's folder."""
    rows = files.properties(texts).unionByName(files.yaml_properties(texts))
    folder = F.regexp_replace(F.regexp_replace("path", "/?[^/]*$", ""), "/?src/main/resources$", "")
    return rows.select(folder.alias("folder"), files.property_rank(F.col("path")).alias("rank"), "key", "value")


def inventory(spark: SparkSession, root: str, system: str, config: Config = Config()) -> dict[str, DataFrame]:
    """The fact tables of a source tree."""
    scanned = files.scan(spark, root, config.include, config.exclude)
    own = files.texts(scanned)
    modules = manifests.modules(manifests.maven_modules(own), manifests.gradle_modules(own))
    kept = files.without_excluded(own.select("path"), modules)
    own = own.join(kept, "path", "left_semi")
    found = java.with_starter(java.resolved(java.facts(own), _properties(spark, own)), modules)
    ends = java.endpoints(found, system).drop("module")
    owned = resolve.nearest_owner(ends.select("path").distinct(), modules.select("folder", F.col("name").alias("owner")))
    ends = ends.join(owned, "path", "left").withColumn("module", F.coalesce("owner", F.lit(system))).withColumn("system", F.col("module")).drop("owner")
    starts = found.where("fact = 'entry'").select("path").distinct()
    entry = resolve.nearest_owner(starts, modules.select("folder", F.col("name").alias("owner"))).select(F.col("owner").alias("name")).distinct().withColumn("starts_application", F.lit(True))
    stored = found.where("fact = 'collection'").select("path", "topic").join(resolve.nearest_owner(found.select("path").distinct(), modules.select("folder", F.col("name").alias("owner"))), "path").groupBy(F.col("owner").alias("name")).agg(F.sort_array(F.collect_set("topic")).alias("mongo_collections"))
    shown = modules.join(entry, "name", "left").join(stored, "name", "left").withColumn("starts_application", F.coalesce("starts_application", F.lit(False))).withColumn("mongo_collections", F.coalesce("mongo_collections", F.array().cast("array<string>")))
    declared = modules.select(F.col("folder").alias("source"), F.explode("dependencies").alias("ref"))
    dependencies = resolve.unique_artifact_dependencies(declared, modules.select(F.col("folder").alias("path"), "name"))
    return {"files": scanned.select("path", "sha256"), "endpoints": ends, "modules": shown, "dependencies": dependencies, "facts": found}


def index(spark: SparkSession, root: str, store: str, system: str, config: Config = Config()) -> DataFrame:
    """Publishes the inventory of a source tree; one row says what became of its files. Nothing changed and the same rules:
    the published version stays."""
    meta = {"signature": SIGNATURE, "config": config.text()}
    before = snapshot.current(spark, store)
    tables = inventory(spark, root, system, config)
    old = snapshot.read(spark, store, "files") if before else spark.createDataFrame([], "path string, sha256 string")
    delta = incremental.hash_delta(old, tables["files"])
    if not before or incremental.meta_changed(before["meta"], meta, ("signature", "config")) or not delta.where("status <> 'unchanged'").isEmpty():
        delta = delta.cache()
        delta.count()
        snapshot.publish(spark, store, tables, meta)
    return catalog.index_report(delta, snapshot.read(spark, store, "facts"))


def doctor(spark: SparkSession, store: str, config_text: str | None = None) -> DataFrame:
    """(name, status, detail): whether the configuration parses, an index is published and all files could be read."""
    rows = []
    try:
        Config.parsed(config_text or "")
        rows.append(("configuration", "ok", "readable"))
    except Exception as e:  # whatever a parser or a check says is the finding
        rows.append(("configuration", "error", str(e)))
    found = snapshot.current(spark, store)
    if not found:
        rows.append(("index", "warning", "nothing is published"))
    else:
        stale = found["meta"].get("signature") != SIGNATURE
        rows.append(("index", "warning" if stale else "ok", "made by other rules" if stale else f"version {found['version']}"))
        n = snapshot.read(spark, store, "facts").where("fact = 'diagnostic'").count()
        rows.append(("extraction", "warning" if n else "ok", f"{n} files could not be read"))
    return spark.createDataFrame(rows, "name string, status string, detail string")


@dataclass(frozen=True)
class Tools:
    """The tools over published snapshots; each returns a DataFrame."""

    spark: SparkSession
    stores: dict[str, str]
    warnings: list[str] = field(default_factory=list)

    def _table(self, name: str) -> DataFrame:
        parts, lost = snapshot.federation(self.spark, self.stores, name)
        self.warnings.extend(w for w in lost if w not in self.warnings)
        out = None
        for service, df in sorted(parts.items()):
            one = df if len(self.stores) == 1 or "id" not in df.columns else df.withColumn("id", F.concat(F.lit(f"{service}:"), "id"))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        if out is None:
            raise FileNotFoundError("; ".join(lost))
        return out

    @property
    def catalog(self) -> catalog.Catalog:
        ends, modules = self._table("endpoints"), self._table("modules")
        names = ends.select(F.col("system").alias("service"), F.col("system").alias("alias")).union(modules.select("name", "name")).distinct()
        return catalog.Catalog(ends, names, modules)

    def architecture_catalog(self, kind: str, action: str = "list", name: str | None = None, target: str | None = None, max_depth: int = 12, limit: int = 50) -> DataFrame:
        """One question about one kind of object."""
        own, plain = self.catalog, catalog.KINDS[kind.lower()]
        if action != "list" and name is None:
            raise ValueError(f"{action} needs a name")
        match plain, action:
            case _, "list":
                return own.list(kind)
            case _, "show":
                return own.show(kind, name)
            case _, "neighbors":
                return own.neighbours(name)
            case "topics", "trace":
                return own.flows(name, min(max_depth, 6), limit)
            case "topics", "producers" | "consumers":
                return own.show(kind, name).select(F.explode("produce" if action == "producers" else "consume").alias("service"))
            case "apis", "providers" | "consumers":
                return own.show(kind, name).select(F.explode("serve" if action == "providers" else "call").alias("service"))
            case "collections", "services":
                return own.show(kind, name)
            case "microservices", "path":
                return own.paths(name, target, max_depth, limit)
            case "microservices", "calls" | "dependencies":
                return own.service_edges().where((F.col("source") == name) & ((F.col("kind") == "rest") | (action == "dependencies")))
            case "microservices", "impact":
                return own.impact(name)
            case "microservices", "external-apis":
                return catalog.external_calls(own.endpoints, own.rest_edges()).where(F.col("module") == name)
            case "microservices", "orphan-integrations":
                return rules.orphan_integrations(catalog.summary_of(own.endpoints, ("produce", "consume")), ("produce", "consume"))
        raise ValueError(f"{action} is no question about {plain}")

    def architecture_audit(self) -> DataFrame:
        own = self.catalog
        topics = own.topic_edges()
        rest = own.rest_edges()
        return rules.issues([
            rules.dynamic_topics(own.endpoints), rules.dynamic_targets(own.endpoints), rules.orphan_producers(own.endpoints, topics), rules.orphan_consumers(own.endpoints, topics),
            rules.contract_mismatch(own.endpoints), rules.contract_unknown(own.endpoints), rules.rest_cycles(rest), rules.unmatched_calls(own.endpoints.where("role = 'call'"), rest),
        ])

    def architecture_coverage(self) -> DataFrame:
        own = self.catalog
        return catalog.coverage(catalog.relations(own.endpoints, own.rest_edges(), own.topic_edges().select("source", "target").distinct()))

    def list_request_reply_patterns(self) -> DataFrame:
        return resolve.request_reply(self._table("endpoints").where(F.col("role").isin("produce", "consume") & ~F.col("topic_dynamic")))

    def list_endpoints(self, **filters: str | None) -> DataFrame:
        return catalog.filtered_endpoints(self._table("endpoints"), **filters)

    def graph(self) -> DataFrame:
        return self.catalog.service_edges()

    def dependency_graph(self) -> DataFrame:
        return catalog.typed_graph(self._table("endpoints"))[1]

    def audit_dependency_graph(self) -> DataFrame:
        nodes, edges = catalog.typed_graph(self._table("endpoints"))
        kinds = nodes.select(F.col("id").alias("node"), F.when(F.col("kind") == "microservice", "service").otherwise(F.col("kind")).alias("kind"))
        return graph.event_cycles(graph.strong_components(edges), kinds)

    def list_workspace_services(self) -> DataFrame:
        return catalog.exportable(catalog.known_services(self._table("endpoints"), self._table("modules")))

    def list_modules(self) -> DataFrame:
        return self._table("modules").orderBy("folder")

    def trace_message_flow(self, query: str) -> DataFrame:
        """All sites of the topic or route that the query means, services without a module included."""
        ends = self._table("endpoints")
        return search.trace_flow(ends, query)


def identifier(text: str) -> str:
    """A name as an identifier of a model text."""
    plain = re.sub(r"[^A-Za-z0-9_-]+", "_", text).strip("_") or "item"
    return f"n_{plain}" if plain[0].isdigit() else plain


def model_text(nodes: list[tuple[str, str]], edges: list[tuple[str, str, str]]) -> str:
    """A model of elements and relations as text, for viewers of architecture models: nodes (name, kind), edges (source,
    target, title). For the bounded graph of one workspace."""
    ids: dict[str, str] = {}
    for name, _ in sorted(nodes):
        own, n = identifier(name), 2
        while own in ids.values():
            own, n = f"{identifier(name)}_{n}", n + 1
        ids[name] = own
    quoted = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'").replace("\n", " ") + "'"
    kinds = "\n".join(f"  element {k}" for k in sorted({k for _, k in nodes}))
    body = [f"  {ids[name]} = {kind} {quoted(name)}" for name, kind in sorted(nodes)] + [f"  {ids[a]} -> {ids[b]} {quoted(t)}" for a, b, t in sorted(edges)]
    return f"specification {{\n{kinds}\n}}\nmodel {{\n" + "\n".join(body) + "\n}\nviews {\n  view index {\n    include *\n  }\n}\n"
