"""Conservative resolution: names, routes, owners and properties. None or several candidates stay unresolved.

Endpoints have ``id, role, system, topic, topic_dynamic, path, start_line, end_line, snippet, module``; REST topics read
``METHOD /path``. Joins are equi joins on a resolved name or key; route similarity only filters inside one service.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr as E

#: Calls, and served routes, that meet in one cell of a join.
CELL = 512


def unique_aliases(names: DataFrame) -> DataFrame:
    """(alias, service) for aliases that mean exactly one service. names: (service, alias)."""
    both = names.select("service", E.alias(F.col("alias")).alias("alias")).union(names.select("service", E.alias(F.col("service")).alias("alias")))
    found = both.where(F.col("alias") != "").groupBy("alias").agg(F.min("service").alias("service"), F.max("service").alias("other"))
    return found.where(F.col("service") == F.col("other")).select("alias", "service")


def ambiguous_aliases(names: DataFrame) -> DataFrame:
    both = names.select("service", E.alias(F.col("alias")).alias("alias")).union(names.select("service", E.alias(F.col("service")).alias("alias")))
    found = both.where(F.col("alias") != "").groupBy("alias").agg(F.countDistinct("service").alias("services"))
    return found.where("services > 1")


def rest_edges(endpoints: DataFrame, names: DataFrame) -> DataFrame:
    """(source, target, call_id, serve_id, topic): calls whose host is one known other service that serves a matching route, one
    row for each distinct call and served route. Distinct routes meet first; what matches is then dealt out in cells of at most
    about CELL calls and CELL served routes, so that no task gets all pairs of a frequent route."""
    calls, serves = _calls(endpoints, names), _serves(endpoints)
    n = 4 * int(endpoints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = calls.join(_matching(calls, serves), ["target", "method", "parts"]).drop("method", "parts")
    route, cell = ["target", "topic"], ["target", "topic", "call_cell", "serve_cell"]
    sizes = a.groupBy(route).agg(F.ceil(F.count("*") / CELL).alias("calls")).join(serves.groupBy(route).agg(F.ceil(F.count("*") / CELL).alias("serves")), route)

    def dealt(df: DataFrame, own: str, other: str, key: Column) -> DataFrame:
        out = df.join(sizes, route).withColumn(f"{own}_cell", F.pmod(key, F.col(f"{own}s")))
        return out.withColumn(f"{other}_cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}s") - 1))).drop("calls", "serves").repartition(n, *cell)

    a, b = dealt(a, "call", "serve", F.xxhash64("call_id", "source")), dealt(serves, "serve", "call", F.xxhash64("serve_id"))
    return a.join(b.hint("shuffle_hash"), cell).select("source", "target", "call_id", "serve_id", "topic")


def matched_calls(endpoints: DataFrame, names: DataFrame) -> DataFrame:
    """(call_id): the calls that have a REST edge, each once, without listing their edges."""
    calls = _calls(endpoints, names)
    return calls.join(_matching(calls, _serves(endpoints)), ["target", "method", "parts"], "left_semi").select("call_id").distinct()


def _calls(endpoints: DataFrame, names: DataFrame) -> DataFrame:
    """(source, target, call_id, method, parts): calls of a known route of one known other service; those that are alike once."""
    calls = endpoints.where((F.col("role") == "call") & (E.path_of(F.col("topic")) != E.DYNAMIC)).withColumn("alias", E.alias(E.target_hint(F.col("snippet"))))
    calls = calls.join(unique_aliases(names), "alias").where(F.col("service") != F.col("system"))
    return calls.select(F.col("system").alias("source"), F.col("service").alias("target"), F.col("id").alias("call_id"), *_route(F.col("topic"))).distinct()


def _serves(endpoints: DataFrame) -> DataFrame:
    """(target, serve_id, topic)"""
    return endpoints.where("role = 'serve'").select(F.col("system").alias("target"), F.col("id").alias("serve_id"), "topic").distinct()


def _route(topic: Column) -> tuple[Column, Column]:
    return E.method_of(topic).alias("method"), E.segments(E.path_of(topic)).alias("parts")


def _matching(calls: DataFrame, serves: DataFrame) -> DataFrame:
    """(target, method, parts, topic), once each: called routes with the served topics of their target that match. Routes of
    equal length meet by the segments that neither has as a hole; only those that end in ``**`` meet all of a service."""
    def parted(df: DataFrame, parts: str, prefix: str) -> DataFrame:
        own = F.col(parts)
        return df.withColumn("n_segments", F.size(own)).withColumn(f"{prefix}_wild", F.coalesce(F.get(own, F.size(own) - 1) == "**", F.lit(False))).withColumn(f"{prefix}_holes", E.holes(own))

    def keyed(df: DataFrame, parts: str, own: str, other: str, against: DataFrame) -> DataFrame:
        """df with the key that it has with each placing of holes that the other side has in routes of its target and length."""
        return df.join(against.select("target", "n_segments", f"{other}_holes").distinct(), ["target", "n_segments"]).withColumn("key", E.masked(F.col(parts), F.col(f"{own}_holes"), F.col(f"{other}_holes")))

    method, parts = _route(F.col("topic"))
    served = serves.where(E.path_of(F.col("topic")) != E.DYNAMIC).select("target", "topic", method.alias("serve_method"), parts.alias("serve_parts")).distinct()
    a, b = parted(calls.select("target", "method", "parts").distinct(), "parts", "call"), parted(served, "serve_parts", "serve")
    tame, tamed = a.where("NOT call_wild"), b.where("NOT serve_wild")
    same = keyed(tame, "parts", "call", "serve", tamed).join(keyed(tamed, "serve_parts", "serve", "call", tame), ["target", "n_segments", "call_holes", "serve_holes", "key"])
    found = ["target", "method", "parts", "topic", "serve_method", "serve_parts"]
    wild = a.drop("n_segments").join(b.where("serve_wild").drop("n_segments"), "target")
    other = a.where("call_wild").drop("n_segments").join(tamed.drop("n_segments"), "target")
    out = same.select(found).unionByName(wild.select(found)).unionByName(other.select(found))
    return out.where(E.routes_match(F.col("method"), F.col("parts"), F.col("serve_method"), F.col("serve_parts"))).select("target", "method", "parts", "topic")


def configured_resource_edges(endpoints: DataFrame, names: DataFrame) -> DataFrame:
    """(source, target, call_id, serve_id, topic): a configured client (its snippet has the api-domain mark, its topic is
    dynamic) stands for a call of every route of its host that its method fits."""
    calls = endpoints.where((F.col("role") == "call") & F.col("topic").endswith(E.DYNAMIC)).withColumn("alias", E.alias(E.api_domain(F.col("snippet"))))
    calls = calls.join(unique_aliases(names), "alias").where(F.col("service") != F.col("system")).select(F.col("system").alias("source"), F.col("service").alias("target"), F.col("id").alias("call_id"), E.method_of(F.col("topic")).alias("method"))
    serves = endpoints.where("role = 'serve'").select(F.col("system").alias("target"), F.col("id").alias("serve_id"), "topic")
    return calls.join(serves, "target").where(E.methods_match(F.col("method"), E.method_of(F.col("topic")))).select("source", "target", "call_id", "serve_id", "topic").dropDuplicates(["call_id", "serve_id"])


def external_edges(calls: DataFrame) -> DataFrame:
    """(source, target, call_id): services outside the workspace that a client's mark names, once for each caller."""
    named = calls.withColumn("target", E.external_service(F.col("snippet"))).where((F.col("role") == "call") & F.col("target").isNotNull() & (F.col("target") != F.col("system")))
    return named.groupBy(F.col("system").alias("source"), "target").agg(F.min("id").alias("call_id"))


def configured_edges(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """Configured clients without a resource edge, one for each caller and domain. calls: (id, system, domain)."""
    rest = calls.join(edges.select(F.col("call_id").alias("id")).distinct(), "id", "left_anti")
    return rest.groupBy(F.col("system").alias("source"), F.col("domain").alias("target")).agg(F.min("id").alias("call_id"))


def gateway_edges(edges: DataFrame, gateway_calls: DataFrame) -> DataFrame:
    """Of a gateway's ``ANY`` call only the first served route of each target, by route and id."""
    gate = edges.join(gateway_calls.select(F.col("id").alias("call_id")).distinct(), "call_id", "left_semi")
    first = gate.groupBy("call_id", "target").agg(F.min(F.struct("topic", "serve_id", "source")).alias("x")).select(F.col("x.source").alias("source"), "target", "call_id", F.col("x.serve_id").alias("serve_id"), F.col("x.topic").alias("topic"))
    return edges.join(gateway_calls.select(F.col("id").alias("call_id")).distinct(), "call_id", "left_anti").select("source", "target", "call_id", "serve_id", "topic").union(first)


def topic_edges(endpoints: DataFrame) -> DataFrame:
    """(source, target, topic): producer and consumer of one static topic in different services. Each side is distinct before
    the join, so a busy topic meets once for each pair of services."""
    static = endpoints.where(~F.col("topic_dynamic") & (F.col("topic") != E.DYNAMIC))
    made = static.where("role = 'produce'").select("topic", F.col("system").alias("source")).distinct()
    used = static.where("role = 'consume'").select("topic", F.col("system").alias("target")).distinct()
    return made.join(used, "topic").where(F.col("source") != F.col("target")).select("source", "target", "topic")


def manifest_first(code: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of code for services without a manifest, and all manifest rows."""
    return code.join(manifest.select("system").distinct(), "system", "left_anti").unionByName(manifest)


def override_rows(base: DataFrame, override: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of base at places that the override does not speak of, and the override."""
    return base.join(override.select(*keys).distinct(), keys, "left_anti").unionByName(override)


def ancestors(path: Column) -> Column:
    """All folders above a path, the root "" included."""
    return E.let(F.split(path, "/"), lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda k: F.array_join(F.slice(p, F.lit(1), k), "/")))


def nearest_owner(files: DataFrame, owners: DataFrame) -> DataFrame:
    """(path, owner): the deepest owner folder at or above each file, null without one. An equi join on the exploded
    ancestors, so no path is compared with all folders."""
    above = files.select("path", F.explode(ancestors(F.col("path"))).alias("folder"))
    found = above.join(owners.select("folder", "owner"), "folder").groupBy("path").agg(F.max(F.struct(F.length("folder").alias("n"), "owner"))["owner"].alias("owner"))
    return files.join(found, "path", "left")


def nearest_property(uses: DataFrame, properties: DataFrame) -> DataFrame:
    """(path, key, value): the property of the nearest folder; within it the lowest rank; else the use's default.
    uses: (path, key, default_value); properties: (folder, rank, key, value)."""
    above = uses.select("path", "key", F.explode(ancestors(F.col("path"))).alias("folder"))
    best = F.min(F.struct((-F.length("folder")).alias("n"), "rank", "value"))
    found = above.join(properties, ["folder", "key"]).groupBy("path", "key").agg(best.alias("b")).select("path", "key", F.col("b.value").alias("value"))
    return uses.join(found, ["path", "key"], "left").select("path", "key", F.coalesce("value", F.nullif("default_value", F.lit(""))).alias("value"))


def inside_ranges(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, low: str, high: str, width: int) -> DataFrame:
    """Interval join with inclusive bounds: ranges are cut at multiples of ``width``, so points meet ranges by key and
    bucket. ``width`` should be near the usual length of a range."""
    cut = ranges.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return points.withColumn("bucket", F.floor(F.col(at) / width)).join(cut, [*keys, "bucket"]).where(F.col(at).between(F.col(low), F.col(high))).drop("bucket")


def fuzzy_names(seen: DataFrame, known: DataFrame) -> DataFrame:
    """(name, status, matched, score): matched where a known name is equal without case and separators (of several the
    lowest), heuristic where exactly one contains it or is contained best, ambiguous on ties, unmapped else. Candidates for
    containment share three characters, or all of the shorter name where that has fewer, so names don't meet all names."""

    def plain(df: DataFrame, name: str) -> DataFrame:
        return df.select(name, E.observed(F.col(name)).alias(f"{name}_plain")).where(f"{name}_plain <> ''")

    def grams(df: DataFrame, name: str, size: int) -> DataFrame:
        text = F.col(f"{name}_plain")
        pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (size - 1)), lambda k: F.substring(text, k, F.lit(size))))
        return df.where(F.length(text) >= size).withColumn("gram", F.explode(pieces))

    asked = seen.select("name").distinct()
    a, b = plain(asked, "name"), plain(known.select(F.col("name").alias("matched")).distinct(), "matched")
    columns = ["name", "name_plain", "matched", "matched_plain"]
    near = grams(a, "name", 3).join(grams(b, "matched", 3), "gram").select(columns)
    for size in (1, 2):
        short_a, short_b = (df.where(F.length(f"{n}_plain") == size).withColumn("gram", F.col(f"{n}_plain")) for df, n in ((a, "name"), (b, "matched")))
        near = near.union(short_a.join(grams(b, "matched", size), "gram").select(columns)).union(grams(a, "name", size).join(short_b, "gram").select(columns))
    near = near.distinct().where(F.col("name_plain") != F.col("matched_plain")).withColumn("score", E.containment(F.col("name_plain"), F.col("matched_plain"))).where("score IS NOT NULL")
    exact = a.join(b, a["name_plain"] == b["matched_plain"]).select("name", "matched", F.lit(1.0).alias("score"), F.lit(0).alias("class"))
    both = exact.union(near.select("name", "matched", "score", F.lit(1).alias("class")))
    ranked = both.withColumn("r", F.rank().over(W.partitionBy("name").orderBy("class", F.col("score").desc()))).where("r = 1")
    best = ranked.groupBy("name").agg(F.count("*").alias("n"), F.min("class").alias("class"), F.min("matched").alias("matched"), F.max("score").alias("score"))
    status = F.when(F.col("n").isNull(), "unmapped").when(F.col("class") == 0, "matched").when(F.col("n") > 1, "ambiguous").otherwise("heuristic")
    sure = (F.col("n") == 1) | (F.col("class") == 0)
    out = asked.join(best, "name", "left").withColumn("status", status)
    return out.select("name", "status", F.when(sure, F.col("matched")).alias("matched"), F.when(sure, F.col("score")).alias("score"))


def resolve_name(names: DataFrame, asked: str, column: str = "name") -> DataFrame:
    """The row of the exact name, else of the only name that contains it in any case, else none."""
    distinct = names.select(column).distinct()
    exact = distinct.where(F.col(column) == asked).withColumn("class", F.lit(0))
    part = distinct.where(F.lower(column).contains(asked.lower())).withColumn("class", F.lit(1))
    best = exact.union(part).withColumn("r", F.rank().over(W.orderBy("class")))
    one = best.where("r = 1").groupBy("r").agg(F.count("*").alias("n"), F.min(column).alias(column)).where("n = 1")
    return one.select(column)


def containing(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(asked, name) where the name contains the asked text in any case. A name has all pieces of three characters of a text it
    contains (or the whole of a shorter one), so a text meets the names that have its rarest piece only. The empty text is in
    all names, as one row asks it."""
    def pieces(text: Column, size: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda k: F.substring(text, k, size)))

    a = asked.select("asked", F.lower("asked").alias("low"))
    n = names.select("name", F.lower("name").alias("low_name"))
    sizes = F.explode(F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: k <= F.length("low_name")))
    known = n.withColumn("size", sizes).withColumn("piece", F.explode(pieces(F.col("low_name"), F.col("size")))).select("name", "low_name", "piece")
    counts = known.groupBy("piece").agg(F.count("*").alias("n"))
    own = a.where("low <> ''").withColumn("piece", F.explode(pieces(F.col("low"), F.least(F.lit(3), F.length("low"))))).join(counts, "piece", "left")
    rarest = own.groupBy("asked", "low").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece"))["piece"].alias("piece"))
    found = rarest.join(known, "piece").where(F.col("low_name").contains(F.col("low"))).select("asked", "name")
    return found.union(a.where("low = ''").select("asked").crossJoin(n.select("name")))


def name_resolutions(asked: DataFrame, names: DataFrame) -> DataFrame:
    """The same for a table of asked names: (asked, status, name)."""
    a, n = asked.select("asked").distinct(), names.select("name").distinct()
    exact = a.join(n, a["asked"] == n["name"]).select("asked", "name", F.lit(0).alias("class"))
    part = containing(a, n).select("asked", "name", F.lit(1).alias("class"))
    ranked = exact.union(part).withColumn("r", F.rank().over(W.partitionBy("asked").orderBy("class"))).where("r = 1")
    best = ranked.groupBy("asked").agg(F.countDistinct("name").alias("n"), F.min("name").alias("name"))
    status = F.when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "ambiguous").otherwise("found")
    return a.join(best, "asked", "left").select("asked", status.alias("status"), F.when(F.col("n") == 1, F.col("name")).alias("name"))


def overlay_claims(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """One runtime row for each static key: exact matches before heuristic ones; of exact ones the last, of heuristic ones
    the first, by ``order``."""
    exact = rows.where("status = 'matched'").groupBy(*key).agg(F.max(F.struct(order.alias("_order"), *rows.columns)).alias("x"))
    exact = exact.select([F.col(f"x.{c}").alias(c) for c in rows.columns])
    rest = rows.where("status = 'heuristic'").join(exact.select(*key), key, "left_anti").groupBy(*key).agg(F.min(F.struct(order.alias("_order"), *rows.columns)).alias("x"))
    return exact.unionByName(rest.select([F.col(f"x.{c}").alias(c) for c in rows.columns]))


def edge_claims(relations: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runtime relations on pairs of services, in three passes: first those with both ends equal to a service (of several the
    last by calls and name); then those with both ends found, for pairs not taken (the first of them); what is left is
    unresolved, by end, and a relation whose pair another one took in the same pass is dropped. relations: (source, target,
    calls, error_rate); names: what fuzzy_names says (name, status, matched). Returns claims and unresolved ends."""
    def end(side: str) -> DataFrame:
        return names.select(F.col("name").alias(side), F.col("status").alias(f"{side}_status"), F.col("matched").alias(f"{side}_node"))

    rows = relations.join(end("source"), "source").join(end("target"), "target")
    exact, sure = (F.col("source_status").isin(*s) & F.col("target_status").isin(*s) for s in (("matched",), ("matched", "heuristic")))
    rows = rows.withColumn("status", F.when(exact, "matched").when(sure, "heuristic"))
    order = F.struct(F.col("calls"), F.col("source"), F.col("target"))
    claims = overlay_claims(rows.where("status IS NOT NULL"), ["source_node", "target_node"], order)
    lost = rows.where("status IS NULL")
    ends = [lost.where(~F.col(f"{side}_status").isin("matched", "heuristic")).select(F.col(side).alias("name"), F.lit(role).alias("role"), "calls", "error_rate", F.col(f"{side}_status").alias("status")) for side, role in (("source", "source"), ("target", "destination"))]
    return claims.select("source_node", "target_node", "calls", "error_rate", "status"), ends[0].unionByName(ends[1])


def persistence_owners(uses: DataFrame, classes: DataFrame, reach: DataFrame) -> DataFrame:
    """(service, collection, module, name): the persistence classes of a used collection in modules that the service reaches,
    itself included; without one there, the only class of all. uses: (service, collection); classes: (collection, module,
    name); reach: (source, target)."""
    near = reach.select(F.col("source").alias("service"), F.col("target").alias("module")).union(uses.select("service", F.col("service").alias("module"))).distinct()
    candidates = uses.select("service", "collection").distinct().join(classes, "collection")
    scoped = candidates.join(near, ["service", "module"], "left_semi")
    one = classes.groupBy("collection").agg(F.count("*").alias("n")).where("n = 1").select("collection")
    rest = candidates.join(scoped.select("service", "collection").distinct(), ["service", "collection"], "left_anti").join(one, "collection", "left_semi")
    return scoped.unionByName(rest).select("service", "collection", "module", "name")


def with_workloads(modules: DataFrame, workloads: DataFrame) -> DataFrame:
    """Modules with all workloads of exactly their name, sorted."""
    named = workloads.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("namespace", "kind"))).alias("workloads"))
    return modules.join(named, "name", "left").withColumn("workloads", F.coalesce("workloads", F.array()))


def unresolved_merge(rows: DataFrame) -> DataFrame:
    """Unmapped names by role: calls added, all candidates once."""
    return rows.groupBy("name", "role").agg(F.sum("calls").alias("calls"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("candidates")))).alias("candidates"))


def unique_artifact_dependencies(declared: DataFrame, modules: DataFrame) -> DataFrame:
    """(source, target): a declared dependency's module by path, else by an artifact name that one module has; local only."""
    by_path = declared.join(modules.select(F.col("path").alias("ref"), F.col("path").alias("target")), "ref")
    names = modules.groupBy(F.col("name").alias("ref")).agg(F.min("path").alias("target"), F.count("*").alias("n")).where("n = 1").select("ref", "target")
    by_name = declared.join(by_path.select("source", "ref").distinct(), ["source", "ref"], "left_anti").join(names, "ref")
    return by_path.select("source", "target").union(by_name.select("source", "target")).where(F.col("source") != F.col("target")).distinct()


def request_reply(topics: DataFrame, prefix: str = "retour_") -> DataFrame:
    """(request, reply): a topic that is the prefix and an existing topic."""
    names = topics.select("topic").distinct()
    replies = names.where(F.col("topic").startswith(prefix)).select(F.substring("topic", len(prefix) + 1, 1_000_000).alias("request"), F.col("topic").alias("reply"))
    return replies.join(names.select(F.col("topic").alias("request")), "request")


def property_usage(endpoints: DataFrame, properties: DataFrame) -> DataFrame:
    """(id, key): endpoints whose snippet uses a known property as ``${key}``."""
    used = endpoints.select("id", F.explode(F.regexp_extract_all("snippet", F.lit(r"\$\{([^}:]+)"), F.lit(1))).alias("key")).distinct()
    return used.join(properties.select("key").distinct(), "key", "left_semi")


def type_references(uses: DataFrame, types: DataFrame) -> DataFrame:
    """(use_id, type_name): qualified, else imported, else same package, else the only one of the simple name.
    uses: (use_id, name, package, imports array); types: (qualified, package, simple)."""
    q = uses.join(types, F.col("name") == F.col("qualified")).select("use_id", "qualified", F.lit(0).alias("class"))
    i = uses.select("use_id", "name", F.explode("imports").alias("imported")).join(types, (F.col("imported") == F.col("qualified")) & (F.col("name") == F.col("simple"))).select("use_id", "qualified", F.lit(1).alias("class"))
    wild = uses.select("use_id", "name", F.explode("imports").alias("imported")).where(F.col("imported").endswith(".*")).withColumn("package", F.regexp_replace("imported", r"\.\*$", "")).drop("imported")
    w = wild.join(types, "package").where(F.col("name") == F.col("simple")).select("use_id", "qualified", F.lit(2).alias("class"))
    p = uses.join(types, "package").where(F.col("name") == F.col("simple")).select("use_id", "qualified", F.lit(3).alias("class"))
    one = types.groupBy("simple").agg(F.min("qualified").alias("qualified"), F.count("*").alias("n")).where("n = 1")
    s = uses.join(one, F.col("name") == F.col("simple")).select("use_id", "qualified", F.lit(4).alias("class"))
    ranked = q.union(i).union(w).union(p).union(s).withColumn("r", F.rank().over(W.partitionBy("use_id").orderBy("class"))).where("r = 1")
    return ranked.groupBy("use_id").agg(F.countDistinct("qualified").alias("n"), F.min("qualified").alias("type_name")).where("n = 1").select("use_id", "type_name")
