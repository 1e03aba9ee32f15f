"""Graph queries over edge tables: paths, flows, closure, cycles, layers, neighbours.

Edges are (source, target, kind, label). Recursion is a loop of joins whose frontier is deduplicated each round; rounds end
in checkpoints, so lineage stays short and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import checkpointed


def closure(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(source, target) for all pairs connected by at least one edge, by doubling path lengths."""
    reach = checkpointed(edges.select("source", "target").distinct())
    size = reach.count()
    for _ in range(max_rounds):
        left, right = reach.select("source", F.col("target").alias("mid")), reach.select(F.col("source").alias("mid"), "target")
        reach = checkpointed(reach.union(left.join(right, "mid").select("source", "target")).distinct())
        now = reach.count()
        if now == size:
            break
        size = now
    return reach


def _spread(value: DataFrame, links: DataFrame, max_rounds: int) -> DataFrame:
    """(node, value) where the lowest value has gone along all links (source, target)."""
    for _ in range(max_rounds):
        sent = links.join(value.withColumnRenamed("node", "source"), "source").select(F.col("target").alias("node"), "value")
        now = checkpointed(value.union(sent).groupBy("node").agg(F.min("value").alias("value")))
        same = now.join(value, ["node", "value"], "left_anti").isEmpty()
        value = now
        if same:
            break
    return value


def strong_components(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(node, component, size) of nodes on cycles: the component is its lowest node. No table of all pairs: every node takes
    the lowest node that reaches it as its colour; the nodes of a colour that reach that node are its component; these go, and
    links between colours with them. Nodes without a way in or out go first."""
    pairs = edges.select("source", "target").distinct()
    loops = checkpointed(pairs.where("source = target").select(F.col("source").alias("node")))
    links, found = checkpointed(pairs.where("source <> target")), None
    while not links.isEmpty():
        both = links.select(F.col("source").alias("node")).distinct().join(links.select(F.col("target").alias("node")).distinct(), "node", "left_semi")
        inner = checkpointed(links.join(both.withColumnRenamed("node", "source"), "source", "left_semi").join(both.withColumnRenamed("node", "target"), "target", "left_semi").select("source", "target"))
        if inner.count() < links.count():
            links = inner
            continue
        nodes = links.select(F.col("source").alias("node")).distinct()
        colour = _spread(nodes.withColumn("value", F.col("node")), links, max_rounds)
        own = colour.select(F.col("node").alias("source"), F.col("value").alias("a")), colour.select(F.col("node").alias("target"), F.col("value").alias("b"))
        within = checkpointed(links.join(own[0], "source").join(own[1], "target").where("a = b").select("source", "target"))
        back = within.select(F.col("target").alias("source"), F.col("source").alias("target"))
        part = _spread(colour.where("node = value"), back, max_rounds).withColumnRenamed("value", "component")
        found = part if found is None else checkpointed(found.union(part))
        left = checkpointed(nodes.join(part, "node", "left_anti"))
        links = checkpointed(within.join(left.withColumnRenamed("node", "source"), "source", "left_semi").join(left.withColumnRenamed("node", "target"), "target", "left_semi"))
    alone = loops.select("node", F.col("node").alias("component"))
    all_found = alone if found is None else found.union(alone.join(found, "node", "left_anti"))
    sizes = all_found.groupBy("component").agg(F.count("*").alias("size"))
    return all_found.join(sizes, "component").join(loops.withColumn("loop", F.lit(True)), "node", "left").where("size > 1 OR loop").select("node", "component", "size")


def event_cycles(components: DataFrame, kinds: DataFrame, least: int = 3) -> DataFrame:
    """Components of at least three nodes with at least two services and a topic. kinds: (node, kind)."""
    rows = components.where(F.col("size") >= least).join(kinds, "node")
    out = rows.groupBy("component").agg(F.sort_array(F.collect_set("node")).alias("nodes"), F.sum(F.when(F.col("kind") == "service", 1).otherwise(0)).alias("services"), F.sum(F.when(F.col("kind") == "topic", 1).otherwise(0)).alias("topics"))
    return out.where("services >= 2 AND topics >= 1")


def type_closure(roots: DataFrame, references: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(root, type): all types that a root type refers to, itself included, each root's way for itself. references: (source,
    target)."""
    found = checkpointed(roots.select("root", F.col("root").alias("type")).distinct())
    front = found
    for _ in range(max_rounds):
        step = front.join(references.select(F.col("source").alias("type"), F.col("target").alias("next")), "type").select("root", F.col("next").alias("type")).distinct()
        front = checkpointed(step.join(found, ["root", "type"], "left_anti"))
        if front.isEmpty():
            break
        found = checkpointed(found.union(front))
    return found


def two_way_pairs(edges: DataFrame) -> DataFrame:
    """(source, target) with source < target and edges both ways."""
    pairs = edges.select("source", "target").distinct()
    back = pairs.select(F.col("source").alias("target"), F.col("target").alias("source"))
    return pairs.where(F.col("source") < F.col("target")).join(back, ["source", "target"], "left_semi")


def shortest_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, max_depth: int = 12, limit: int | None = None) -> DataFrame:
    """(start, end, length, path): all shortest simple paths between the given nodes; parallel labelled edges give a path
    each. Nodes that a start has reached before are not entered again, so only shortest paths grow."""
    step = edges.select(F.col("source").alias("at"), F.col("target").alias("next"), F.coalesce("label", F.lit("")).alias("label")).distinct()
    wanted = ends.select(F.col("node").alias("end")).distinct()
    front = starts.select(F.col("node").alias("start"), F.col("node").alias("at"), F.col("node").alias("path")).distinct()
    seen = front.select("start", "at").distinct()
    found = front.join(wanted, front["at"] == wanted["end"]).select("start", "end", F.lit(0).alias("length"), "path")
    for depth in range(1, max_depth + 1):
        moved = front.join(step, "at").select("start", F.col("next").alias("at"), F.concat("path", F.lit(" -["), "label", F.lit("]-> "), "next").alias("path"))
        front = checkpointed(moved.join(seen, ["start", "at"], "left_anti"))
        if front.isEmpty():
            break
        seen = checkpointed(seen.union(front.select("start", "at").distinct()))
        found = found.union(front.join(wanted, front["at"] == wanted["end"]).select("start", "end", F.lit(depth).alias("length"), "path"))
    return found if limit is None else found.orderBy("start", "end", "length", "path").limit(limit)


def flow_trace(consumes: DataFrame, publishes: DataFrame, topics: DataFrame, max_depth: int = 6, limit: int | None = None) -> DataFrame:
    """(topic, depth, path, cycle_detected): topic, consumer, published topic and so on; a service met again ends the path.
    The depth counts services; paths sort as a depth-first walk would meet them."""
    use = consumes.select(F.col("topic").alias("at_topic"), "service").distinct()
    make = publishes.select("service", F.col("topic").alias("next_topic")).distinct()
    front = topics.select("topic", F.col("topic").alias("at_topic"), F.array(F.col("topic")).alias("path"), F.array().cast("array<string>").alias("services")).distinct()
    found = None
    for depth in range(1, max_depth + 1):
        met = front.join(use, "at_topic").withColumn("cycle_detected", F.array_contains("services", F.col("service")))
        met = checkpointed(met.select("topic", F.lit(depth).alias("depth"), F.array_append("path", F.col("service")).alias("path"), F.array_append("services", F.col("service")).alias("services"), "service", "cycle_detected"))
        found = met.select("topic", "depth", "path", "cycle_detected") if found is None else found.union(met.select("topic", "depth", "path", "cycle_detected"))
        front = met.where(~F.col("cycle_detected")).join(make, "service").select("topic", F.col("next_topic").alias("at_topic"), F.array_append("path", F.col("next_topic")).alias("path"), "services")
        if front.isEmpty():
            break
    out = found.withColumn("path", F.array_join("path", " > "))
    return out if limit is None else out.orderBy("topic", "path").limit(limit)


def layers(edges: DataFrame, nodes: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, layer): the longest way from a node without predecessors; nodes on or behind cycles share the last layer."""
    pairs = edges.where(F.col("source") != F.col("target")).select("source", "target").distinct()
    level = checkpointed(nodes.select("node").distinct().join(pairs.select(F.col("target").alias("node")).distinct(), "node", "left_anti").withColumn("layer", F.lit(0)))
    rest = checkpointed(nodes.select("node").distinct().join(level, "node", "left_anti"))
    for k in range(1, max_rounds):
        if rest.isEmpty():
            break
        blocked = pairs.join(rest.select(F.col("node").alias("source")), "source", "left_semi").select(F.col("target").alias("node")).distinct()
        free = rest.join(blocked, "node", "left_anti")
        if free.isEmpty():
            break
        level = checkpointed(level.union(free.withColumn("layer", F.lit(k))))
        rest = checkpointed(rest.join(level, "node", "left_anti"))
    last = level.agg(F.coalesce(F.max("layer") + 1, F.lit(0)).alias("layer"))
    return level.union(rest.crossJoin(F.broadcast(last)).select("node", "layer"))  # one row is broadcast


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, direction, relation, neighbour), once each."""
    out = edges.select(F.col("source").alias("node"), F.lit("out").alias("direction"), F.col("kind").alias("relation"), F.col("target").alias("neighbour"))
    return out.union(edges.select(F.col("target").alias("node"), F.lit("in").alias("direction"), F.col("kind").alias("relation"), F.col("source").alias("neighbour"))).distinct()


def degrees(edges: DataFrame, kinds: list[str]) -> DataFrame:
    """Distinct edges at each node, in all and by kind."""
    once = edges.select("source", "target", "kind").distinct()
    ends = once.select(F.col("source").alias("node"), "kind").union(once.select(F.col("target").alias("node"), "kind"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"), *(F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"n_{k}") for k in kinds))


def itinerary(edges: DataFrame, stops: list[str], max_depth: int = 12) -> DataFrame:
    """Shortest paths from stop to stop: (leg, start, end, length, path)."""
    spark, out = edges.sparkSession, None
    for k, (a, b) in enumerate(zip(stops, stops[1:])):
        one = shortest_paths(edges, spark.createDataFrame([(a,)], "node string"), spark.createDataFrame([(b,)], "node string"), max_depth).withColumn("leg", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out
