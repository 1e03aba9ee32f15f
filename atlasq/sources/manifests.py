"""Build files, manifests, contracts and workloads as rows, in SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr as E


def markdown_topics(texts: DataFrame) -> DataFrame:
    """(path, module, role, topic) of Markdown manifests: a ``###`` heading names the module, a bold Producer or Consumer line
    the role, and of each table row the physical name counts before the logical one. Header state is carried forward."""
    lines = texts.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))
    before = W.partitionBy("path").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(F.regexp_replace(c, "`", "")))
    is_row = F.trim("line").startswith("|")
    rows = lines.withColumn("cells", F.when(is_row, cells))
    is_header = F.array_contains("cells", "Topic")
    rows = (
        rows.withColumn("module", F.last(F.nullif(F.regexp_extract("line", r"^###\s+(.+?)\s*$", 1), F.lit("")), ignorenulls=True).over(before))
        .withColumn("role", F.last(F.when(F.col("line").rlike(r"(?i)\*\*producer"), "produce").when(F.col("line").rlike(r"(?i)\*\*consumer"), "consume"), ignorenulls=True).over(before))
        .withColumn("header", F.last(F.when(is_header, F.col("cells")), ignorenulls=True).over(before))
    )
    data = rows.where(is_row & ~is_header & ~F.col("line").rlike(r"^\s*\|[\s:|-]+\|?\s*$") & F.col("header").isNotNull() & F.col("module").isNotNull() & F.col("role").isNotNull())

    def cell(name: str):
        at = F.array_position("header", name).cast("int")
        return F.when(at > 0, F.nullif(F.get("cells", at - 1), F.lit("")))

    return data.select("path", "module", "role", F.coalesce(cell("Nom physique"), cell("Topic")).alias("topic")).where("topic IS NOT NULL").distinct()


def flow_manifest(texts: DataFrame) -> DataFrame:
    """(path, service, role, topic) of JSON manifests {topics: {logical: physical}, producers: {service: [logical]}, consumers}."""
    doc = texts.select("path", F.from_json("text", "topics map<string,string>, producers map<string,array<string>>, consumers map<string,array<string>>").alias("d"))

    def side(name: str, role: str) -> DataFrame:
        rows = doc.select("path", "d.topics", F.explode(f"d.{name}").alias("service", "names")).select("path", "topics", "service", F.explode("names").alias("name"))
        return rows.select("path", "service", F.lit(role).alias("role"), F.coalesce(F.element_at("topics", F.col("name")), F.col("name")).alias("topic"))

    return side("producers", "produce").unionByName(side("consumers", "consume"))


def openapi_routes(texts: DataFrame) -> DataFrame:
    """(path, topic) of JSON contracts: every path with every HTTP method it has."""
    doc = texts.select("path", F.from_json("text", "paths map<string,map<string,string>>").alias("d"))
    rows = doc.select("path", F.explode("d.paths").alias("route", "item")).select("path", "route", F.explode(F.map_keys("item")).alias("method"))
    return rows.where(F.upper("method").isin(*E.HTTP_METHODS)).select("path", F.concat(F.upper("method"), F.lit(" "), E.rest_path(F.col("route"))).alias("topic")).distinct()


def declared_contracts(declarations: DataFrame, contracts: DataFrame, routes: DataFrame) -> DataFrame:
    """(path, topic, contract): routes that a ``<name>.rest`` declaration publishes, from contracts of the same name (in any case,
    ``_`` as ``-``) anywhere, and from all below ``model-<name>/src/main/resources/openapi``; rows have the declaration's path.
    Both sides: (path); routes: (path, topic) of contracts. Equi joins on the name."""
    def plain(text):
        return F.replace(F.lower(text), F.lit("_"), F.lit("-"))

    stem = lambda c: F.regexp_replace(F.regexp_extract(c, r"([^/]*)$", 1), r"\.[^.]*$", "")
    asked = declarations.where(F.col("path").rlike(r"(?i)\.rest$")).select(F.col("path").alias("declaration"), plain(stem(F.col("path"))).alias("name"))
    named = contracts.select("path", plain(stem(F.col("path"))).alias("name"))
    model = contracts.select("path", plain(F.regexp_extract("path", r"(?i)(?:^|/)model[-_]([^/]+)/src/main/resources/openapi/", 1)).alias("name")).where("name <> ''")
    found = asked.join(named.union(model).distinct(), "name").join(routes, "path")
    return found.select(F.col("declaration").alias("path"), "topic", F.col("path").alias("contract")).distinct()


def actuators(properties: DataFrame) -> DataFrame:
    """(path, topic): files that expose all management endpoints. properties: flattened (path, key, value)."""
    exposed = properties.where((F.regexp_replace("key", r"\[[0-9]+\]$", "") == "management.endpoints.web.exposure.include") & F.col("value").contains("*"))
    return exposed.select("path", F.lit("GET /actuator/**").alias("topic")).distinct()


def gateway_routes(properties: DataFrame) -> DataFrame:
    """(path, role, topic, target, strip): of each load-balanced route of a gateway and each of its path predicates the served
    route, and the called one without the prefixes that a filter strips. properties: flattened (path, key, value), where a
    route's parts share the prefix up to its number."""
    prefix = r"^(spring\.cloud\.gateway(?:\.server\.webflux)?\.routes\[[0-9]+\])\."
    rows = properties.where(F.col("key").rlike(prefix)).select("path", F.regexp_extract("key", prefix, 1).alias("route"), F.regexp_replace("key", prefix, "").alias("part"), "value")
    uri = rows.where("part = 'uri' AND value LIKE 'lb://%'").select("path", "route", F.substring("value", 6, 1000).alias("target"))
    short = rows.where(F.col("part").rlike(r"^predicates\[[0-9]+\]$") & F.col("value").startswith("Path=")).select("path", "route", F.explode(F.split(F.substring("value", 6, 1_000_000), ",")).alias("public"))
    named = rows.where(F.col("part").rlike(r"^predicates\[[0-9]+\]\.name$") & (F.col("value") == "Path")).select("path", "route", F.regexp_extract("part", r"^(predicates\[[0-9]+\])", 1).alias("at"))
    given = rows.where(F.col("part").rlike(r"^predicates\[[0-9]+\]\.args\.(_genkey_0|patterns)$")).select("path", "route", F.regexp_extract("part", r"^(predicates\[[0-9]+\])", 1).alias("at"), F.col("value").alias("public"))
    public = short.union(given.join(named, ["path", "route", "at"]).select("path", "route", "public")).withColumn("public", F.trim("public")).where("public <> ''")
    number = F.regexp_extract("value", r"^StripPrefix=([0-9]{1,4})$", 1)
    strip = rows.where(F.col("part").rlike(r"^filters\[[0-9]+\]$") & (number != "")).groupBy("path", "route").agg(F.min_by(number.cast("int"), "part").alias("strip"))
    found = public.join(uri, ["path", "route"]).join(strip, ["path", "route"], "left").withColumn("strip", F.coalesce("strip", F.lit(0))).withColumn("public", E.rest_path(F.col("public")))
    called = F.when(F.col("strip") > 0, E.strip_prefix(F.col("public"), F.col("strip"))).otherwise(F.col("public"))
    sides = [found.select("path", F.lit(role).alias("role"), F.concat(F.lit("ANY "), route).alias("topic"), "target", "strip") for role, route in (("serve", F.col("public")), ("call", called))]
    return sides[0].union(sides[1]).distinct()


def workloads(texts: DataFrame) -> DataFrame:
    """(kind, namespace, name, replicas, and sums over the containers) of a ``kubectl get -o json`` list; null where no
    container says so."""
    limits = "struct<cpu:string,memory:string>"
    item = f"kind string, metadata struct<name:string,namespace:string>, spec struct<replicas:int,template:struct<spec:struct<containers:array<struct<resources:struct<requests:{limits},limits:{limits}>>>>>>"
    rows = texts.select(F.explode(F.from_json("text", f"items array<struct<{', '.join(f'{a}:{b}' for a, b in (x.split(' ', 1) for x in item.split(', ')))}>>")["items"]).alias("i"))
    rows = rows.select("i.kind", "i.metadata.namespace", "i.metadata.name", "i.spec.replicas", F.explode_outer("i.spec.template.spec.containers").alias("c"))
    sums = {f"cpu_{k}_millicores": F.sum(E.millicores(F.col(f"c.resources.{k}s.cpu"))) for k in ("request", "limit")} | {f"memory_{k}_bytes": F.sum(E.memory_bytes(F.col(f"c.resources.{k}s.memory"))) for k in ("request", "limit")}
    return rows.groupBy("kind", "namespace", "name", "replicas").agg(*(v.alias(k) for k, v in sums.items()))


def maven_modules(texts: DataFrame) -> DataFrame:
    """(path, folder, name, version, packaging, dependencies, plugins, property values) of POM files; the parent's version where
    there is none. The default namespace is
    taken off first, as XPath 1.0 has no default."""
    xml = F.regexp_replace("text", r"\sxmlns(:\w+)?=\"[^\"]*\"|\sxsi:\w+=\"[^\"]*\"", "")
    pom = texts.where(F.col("path").rlike(r"(^|/)pom\.xml$")).select("path", xml.alias("x"))

    def at(where: str):
        return F.nullif(F.trim(F.xpath_string("x", F.lit(where))), F.lit(""))

    folder = F.regexp_replace("path", r"/?pom\.xml$", "")
    plugin = F.xpath("x", F.lit("/project/build/plugins/plugin/artifactId/text()"))
    values = F.xpath("x", F.lit("/project/properties/*/text()"))
    return pom.select("path", folder.alias("folder"), at("/project/artifactId").alias("name"), F.coalesce(at("/project/version"), at("/project/parent/version")).alias("version"), F.coalesce(at("/project/packaging"), F.lit("jar")).alias("packaging"), F.xpath("x", F.lit("/project/dependencies/dependency/artifactId/text()")).alias("dependencies"), plugin.alias("plugins"), values.alias("property_values"))


def gradle_modules(texts: DataFrame) -> DataFrame:
    """(path, folder, name, version, dependencies) of Gradle build files; without a name of its own a module is called as the
    settings file of its folder says, else like the folder."""
    rows = texts.where(F.col("path").rlike(r"(^|/)build\.gradle(\.kts)?$"))
    folder = F.regexp_replace("path", r"/?build\.gradle(\.kts)?$", "")

    def first(pattern: str):
        return F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))

    own = F.coalesce(first(r"(?:archivesBaseName|archiveBaseName(?:\.set\()?|rootProject\.name)\s*=?\s*\(?[\"']([^\"']+)"), F.lit(None).cast("string"))
    settings = texts.where(F.col("path").rlike(r"(^|/)settings\.gradle(\.kts)?$")).select(F.regexp_replace("path", r"/?settings\.gradle(\.kts)?$", "").alias("settings_folder"), first(r"rootProject\.name\s*=?\s*\(?[\"']([^\"']+)").alias("root_name"))
    settings = settings.groupBy("settings_folder").agg(F.min("root_name").alias("root_name"))
    rows = rows.withColumn("own", own).join(settings, folder == F.col("settings_folder"), "left")
    name = F.coalesce("own", "root_name", F.nullif(F.substring_index(folder, "/", -1), F.lit("")))
    return rows.select("path", folder.alias("folder"), name.alias("name"), first(r"(?m)^\s*version\s*=?\s*[\"']([^\"']+)").alias("version"), F.regexp_extract_all("text", F.lit(r"project\(\s*(?:path\s*[:=]\s*)?[\"']:?([^\"')]+)"), F.lit(1)).alias("dependencies"))


def modules(maven: DataFrame, gradle: DataFrame) -> DataFrame:
    """Modules of both build systems; of one folder the Maven one counts."""
    columns = ["folder", "name", "version", "dependencies"]
    both = maven.select(*columns, F.lit(0).alias("o"), F.lit("maven").alias("build")).unionByName(gradle.select(*columns, F.lit(1).alias("o"), F.lit("gradle").alias("build")))
    return both.withColumn("n", F.row_number().over(W.partitionBy("folder").orderBy("o"))).where("n = 1").drop("o", "n")
