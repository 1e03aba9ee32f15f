from pyspark.sql import functions as F

from atlasq.functions import expr as E
from atlasq.operators import catalog, graph, incremental, resolve, rules, search, telemetry, traces


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


ENDPOINTS = "id string, role string, system string, topic string, topic_dynamic boolean, path string, start_line int, snippet string, module string, message_type string"


def endpoints(spark, *facts):
    return spark.createDataFrame([(f"e{i}", role, system, topic, topic.endswith("<dynamic>"), "f.java", i, snippet, system, None) for i, (role, system, topic, snippet) in enumerate(facts)], ENDPOINTS)


def names(spark, *services):
    return spark.createDataFrame([(s, s) for s in services], "service string, alias string")


def test_rest_edges_need_a_known_host_and_a_matching_route(spark):
    facts = endpoints(spark, ("call", "a", "GET /x/1", "http://b"), ("serve", "b", "GET /x/{id}", ""), ("call", "b", "GET /x/1", "none"), ("call", "c", "GET /y", "http://b"), ("call", "b", "GET /x/1", "http://b"))
    assert rows(resolve.rest_edges(facts, names(spark, "a", "b", "c")).select("source", "target", "call_id", "serve_id")) == [("a", "b", "e0", "e1")]
    both = spark.createDataFrame([("b", "B."), ("c", "b")], "service string, alias string")
    assert resolve.rest_edges(facts, both).count() == 0  # the alias means two services
    assert rows(resolve.ambiguous_aliases(both)) == [("b", 2)]


def test_rest_edges_are_all_pairs_that_match(spark, monkeypatch):
    monkeypatch.setattr(resolve, "CELL", 3)
    routes = ["/x/{id}", "/x/1", "/{a}/1", "/{a}/{b}", "/x/**", "/x", "/", "/y/2?z=1", "/y//2/", "**", "<dynamic>", "/x/{}", "/x/{1", "/a/b/c"]
    methods = ["GET", "POST", "ANY"]
    facts = [(role, system, f"{methods[(i + k) % 3]} {route}", f"http://{host}/") for k in range(3) for i, route in enumerate(routes) for role, system, host in (("call", "a", "b"), ("call", "c", "b"), ("serve", "b", "b"), ("call", "b", "b"))]
    ends = endpoints(spark, *facts)
    ends = ends.union(ends.where("id in ('e0', 'e2')"))  # repeated rows are one
    calls = ends.where("role = 'call' AND system <> 'b'").select(F.col("system").alias("source"), F.col("id").alias("call_id"), F.col("topic").alias("called"))
    serves = ends.where("role = 'serve'").select(F.col("id").alias("serve_id"), "topic")
    expected = calls.crossJoin(serves).where(E.paths_match(F.col("called"), F.col("topic"))).select("source", F.lit("b").alias("target"), "call_id", "serve_id", "topic").distinct()
    found = resolve.rest_edges(ends, names(spark, "a", "b", "c"))
    assert rows(found) == rows(expected) and found.count() > 100
    assert rows(resolve.matched_calls(ends, names(spark, "a", "b", "c"))) == rows(expected.select("call_id").distinct())


def test_routes_of_many_endpoints_meet_once(spark):
    facts = endpoints(spark, *[("call", "a", f"GET /x/{i % 4}", "http://b") for i in range(60)], *[("serve", "b", "GET /x/{id}", "") for _ in range(50)])
    calls, serves = resolve._calls(facts, names(spark, "a", "b")), resolve._serves(facts)
    assert resolve._matching(calls, serves).count() == 4
    assert resolve.rest_edges(facts, names(spark, "a", "b")).distinct().count() == 3000


def test_topic_edges_leave_dynamic_topics(spark):
    facts = endpoints(spark, ("produce", "a", "t", ""), ("consume", "b", "t", ""), ("consume", "a", "t", ""), ("produce", "a", "<dynamic>", ""), ("consume", "b", "<dynamic>", ""))
    edges = resolve.topic_edges(facts)
    assert rows(edges) == [("a", "b", "t")]
    assert rules.orphan_producers(facts, edges).count() == 0 and rows(rules.orphan_consumers(facts, edges).select("subject", "detail")) == [("a", "t")]
    assert rules.dynamic_topics(facts).count() == 2


def test_interval_join_is_inclusive(spark):
    points = spark.createDataFrame([("f", 10), ("f", 20), ("f", 21), ("g", 15)], "path string, line int")
    ranges = spark.createDataFrame([("f", 10, 20)], "path string, low int, high int")
    assert rows(resolve.inside_ranges(points, ranges, ["path"], "line", "low", "high", 7).select("path", "line")) == [("f", 10), ("f", 20)]


def test_nearest_owner_and_property(spark):
    files = spark.createDataFrame([("a/b/c.java",), ("x.java",)], "path string")
    owners = spark.createDataFrame([("a", "A"), ("a/b", "B")], "folder string, owner string")
    assert rows(resolve.nearest_owner(files, owners)) == [("a/b/c.java", "B"), ("x.java", None)]
    uses = spark.createDataFrame([("a/b/c.java", "k", None), ("x.java", "k", "dflt"), ("x.java", "z", "")], "path string, key string, default_value string")
    props = spark.createDataFrame([("a", 0, "k", "far"), ("a/b", 1, "k", "second"), ("a/b", 0, "k", "near")], "folder string, rank int, key string, value string")
    assert rows(resolve.nearest_property(uses, props)) == [("a/b/c.java", "k", "near"), ("x.java", "k", "dflt"), ("x.java", "z", None)]


def test_fuzzy_names(spark):
    seen = spark.createDataFrame([("Order-Svc",), ("payments-worker",), ("ghost",), ("inv",)], "name string")
    known = spark.createDataFrame([("ordersvc",), ("payments",), ("inva",), ("invb",)], "name string")
    assert rows(resolve.fuzzy_names(seen, known).select("name", "status", "matched")) == [("Order-Svc", "matched", "ordersvc"), ("ghost", "unmapped", None), ("inv", "ambiguous", None), ("payments-worker", "heuristic", "payments")]


def test_dependency_metrics_and_budget(spark):
    buckets = spark.createDataFrame([("orders", "inventory", None, "success", 10, 500_000), ("orders", "inventory", None, "failure", 2, 300_000), ("orders", "payments", None, "success", 5, 1_000_000), ("", "x", None, "success", 1, 1)], "source string, target string, target_type string, outcome string, calls long, duration_us long")
    out = telemetry.rounded(telemetry.dependency_metrics(buckets)).orderBy(*telemetry.digest_order()).collect()
    assert (out[0]["calls"], out[0]["failure_calls"], out[0]["error_rate"], out[0]["average_ms"]) == (12, 2, 0.166667, 66.667) and len(out) == 2
    kept, cut = telemetry.byte_budget(telemetry.dependency_metrics(buckets), telemetry.digest_order(), 200)
    assert len(kept) == 1 and cut
    assert telemetry.coverage_envelope(telemetry.dependency_metrics(buckets), 1).first()["reasons"] == "limit"


def test_windows_count_back_from_the_end(spark):
    df = spark.createDataFrame([("2024-01-01 01:00:00",), ("2024-01-01 00:59:59",), ("2024-01-01 00:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("ts"))
    at = telemetry.window_index(F.col("ts"), F.lit("2024-01-01 02:00:00").cast("timestamp"), 3600)
    assert [r[0] for r in df.select(at).collect()] == [0, 1, 1]


def test_hourly_p95_is_the_largest(spark):
    base = [("s", 0, 100.0)] * 3 + [("s", 1, 900.0)]
    df = spark.createDataFrame([(s, w, 1, d, True, True) for s, w, d in base], "service string, w int, calls long, duration_us double, known boolean, success boolean")
    out = telemetry.merged_latency(telemetry.hourly_latency(df, ["service"], F.col("w")), ["service"]).first()
    assert (out["calls"], out["p95_us"], out["error_rate"], out["outcome_coverage"]) == (4, 900.0, 0.0, 1.0)


def test_terciles(spark):
    df = spark.createDataFrame([(k, "m", v) for k, v in (("a", 1), ("b", 1), ("c", 2), ("d", 9))], "key string, kind string, calls int")
    assert [r["tier"] for r in telemetry.soft_terciles(df, "calls", "key", "kind").orderBy("key").collect()] == [1, 1, 2, 3]
    assert [r["level"] for r in telemetry.volume_levels(df).orderBy("key").collect()] == ["medium", "medium", "high", "high"]


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, "rest", "") for a, b in pairs], "source string, target string, kind string, label string")


def test_graph_queries(spark):
    ring = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"))
    assert graph.closure(ring).where("source = 'a'").count() == 5
    assert rows(graph.strong_components(ring)) == [("a", "a", 3), ("b", "a", 3), ("c", "a", 3), ("d", "d", 2), ("e", "d", 2)]
    assert rows(graph.two_way_pairs(ring)) == [("d", "e")]
    start, end = (spark.createDataFrame([(n,)], "node string") for n in ("a", "e"))
    assert [(r["length"], r["path"]) for r in graph.shortest_paths(ring, start, end).collect()] == [(4, "a -[]-> b -[]-> c -[]-> d -[]-> e")]
    assert [(r["length"], r["path"]) for r in graph.shortest_paths(ring, start, start).collect()] == [(0, "a")]
    line = edges(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"))
    nodes = spark.createDataFrame([(n,) for n in "abcxy"], "node string")
    assert rows(graph.layers(line, nodes)) == [("a", 0), ("b", 1), ("c", 2), ("x", 3), ("y", 3)]
    kinds = spark.createDataFrame([("a", "service"), ("b", "topic"), ("c", "service")], "node string, kind string")
    assert [r["nodes"] for r in graph.event_cycles(graph.strong_components(ring), kinds).collect()] == [["a", "b", "c"]]


def test_flow_trace_marks_cycles(spark):
    use = spark.createDataFrame([("t", "b"), ("u", "a")], "topic string, service string")
    make = spark.createDataFrame([("a", "t"), ("b", "u")], "service string, topic string")
    got = graph.flow_trace(use, make, spark.createDataFrame([("t",)], "topic string")).orderBy("depth").collect()
    assert [(r["path"], r["cycle_detected"]) for r in got] == [("t > b", False), ("t > b > u > a", False), ("t > b > u > a > t > b", True)]


def test_span_trees(spark):
    spans = spark.createDataFrame([(1, 0, None), (1, 1, 0), (1, 2, 1), (2, 5, 9), (3, 7, 8), (3, 8, 7)], "trace_id long, span_id long, parent_id long")
    want = [(1, 0, 0), (1, 1, 1), (1, 2, 2), (2, 5, 0), (3, 7, 20), (3, 8, 20)]  # the last two are a cycle
    assert rows(traces.span_depth(spans)) == want and rows(traces.span_depth_by_paths(spans)) == want


def test_contracts_and_search(spark):
    base = spark.createDataFrame([("produce", "a", "t", "X"), ("consume", "b", "t", "Y"), ("produce", "a", "u", "X"), ("consume", "b", "u", None)], "role string, system string, topic string, message_type string").withColumn("topic_dynamic", F.lit(False))
    assert rows(rules.contract_mismatch(base).select("subject")) == [("t",)] and rows(rules.contract_unknown(base).select("subject")) == [("u",)]
    findings = spark.createDataFrame([("1", "sql-injection", "SQL query built from input", "a/B.java", ["CWE-89"], "ERROR"), ("2", "log", "input logged", "c/D.java", [], "INFO")], "id string, rule_id string, message string, path string, cwe array<string>, severity string")
    assert [r["id"] for r in search.search(findings, "sql input").collect()] == ["1"]
    assert [r["id"] for r in search.search(findings, "").collect()] == ["1", "2"]
    assert search.search(findings, "sql missing").count() == 0


def test_delta_and_replacement(spark):
    before = spark.createDataFrame([("a", "1"), ("pom.xml", "2"), ("c", "3")], "path string, sha256 string")
    now = spark.createDataFrame([("a", "1"), ("pom.xml", "9"), ("d", "4")], "path string, sha256 string")
    delta = incremental.hash_delta(before, now)
    assert rows(delta) == [("a", "unchanged"), ("c", "deleted"), ("d", "added"), ("pom.xml", "modified")]
    assert incremental.needs_full(delta).first()["full"] and rows(incremental.purged(before, delta).select("path")) == [("a",), ("pom.xml",)]


def test_catalog(spark):
    facts = endpoints(spark, ("call", "a", "GET /x", "http://b"), ("serve", "b", "GET /x", ""), ("produce", "b", "t", ""), ("consume", "c", "t", ""))
    own = catalog.Catalog(facts, names(spark, "a", "b", "c"))
    assert [r[0] for r in own.list("service").collect()] == ["a", "b", "c"]
    assert [r["path"] for r in own.paths("a", "c").collect()] == ["a -[GET /x]-> b -[t]-> c"]
    assert [r["path"] for r in own.flows("t").collect()] == ["t > c"]
    found = catalog.relations(facts, own.rest_edges(), own.topic_edges())
    assert {r["relation"]: r["n"] for r in catalog.coverage(found).collect()} == {"publishes": 1, "consumes": 1, "provides": 1, "calls": 1, "calls_service": 1, "publishes_to": 1}


def test_unresolved_lists_cut_ties_alike_in_any_order(spark):
    kind = "id string, module string, topic string, role string, path string, start_line int, topic_dynamic boolean, message_type string"
    rows = [(f"{role}{kept}", "m", "t", role, "p", 7, True, kept) for role in ("produce", "consume") for kept in ("A", "B", None)]
    none = spark.createDataFrame([], "call_id string")

    def lists(own):
        return sorted((r["list"], r["role"]) for r in catalog.unresolved(spark.createDataFrame(own, kind).coalesce(1), none, limit=3).collect())

    dynamic, untyped = "dynamic_kafka_topics", "unknown_kafka_message_types"
    expected = [(dynamic, "consume"), (dynamic, "consume"), (dynamic, "produce"), (untyped, "consume"), (untyped, "produce")]
    assert lists(rows) == lists(rows[::-1]) == lists(rows[3:] + rows[:3]) == expected
