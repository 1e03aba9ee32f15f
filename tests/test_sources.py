import json

import pytest
from pyspark.sql import functions as F

from atlasq.plans import testbed
from atlasq.sources import files, manifests, snapshot
from atlasq.streaming import metrics
from tests.conftest import DATA


def texts(spark, **named):
    return spark.createDataFrame([(k.replace("__", "/").replace("_", "."), v) for k, v in named.items()], "path string, text string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_scan(spark, tmp_path):
    for name in ("a/src/main/X.java", "a/src/test/Y.java", ".git/z", "b/pom.xml"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    found = files.scan(spark, str(tmp_path))
    assert [r["path"] for r in found.orderBy("path").collect()] == ["a/src/main/X.java", "b/pom.xml"]
    assert [r["path"] for r in files.scan(spark, str(tmp_path), include=("*.xml",)).collect()] == ["b/pom.xml"]
    assert {r["text"] for r in files.texts(found).collect()} == {"a/src/main/X.java", "b/pom.xml"}


def test_configuration(spark):
    docs = spark.createDataFrame([("p.properties", "# c\na.b = 1\nc:x=y\n\na.b=2"), ("q.yml", "a:\n  b: true\n  c: [1, 2]\n---\nd: x"), ("bad.yml", "a: [")], "path string, text string")
    assert rows(files.properties(docs)) == [("p.properties", "a.b", "2"), ("p.properties", "c", "x=y")]
    assert rows(files.yaml_properties(docs)) == [("q.yml", "a.b", "true"), ("q.yml", "a.c[0]", "1"), ("q.yml", "a.c[1]", "2"), ("q.yml", "d", "x")]
    code = spark.createDataFrame([("X.java", '@Value("${db.password:x}") env.getProperty("server.port")')], "path string, text string")
    assert rows(files.property_templates(code)) == [("X.java", "db.password", "<secret>"), ("X.java", "server.port", "0")]


def test_manifests(spark):
    md = "### orders\n**Producer**\n| Topic | Nom physique |\n|---|---|\n| created | `orders.created.v1` |\n| plain | |\n**Consumer**\n| Topic |\n|---|\n| paid |\n"
    assert rows(manifests.markdown_topics(texts(spark, m_md=md)).select("module", "role", "topic")) == [("orders", "consume", "paid"), ("orders", "produce", "orders.created.v1"), ("orders", "produce", "plain")]
    flow = json.dumps({"topics": {"a": "phys.a"}, "producers": {"s": ["a", "b"]}, "consumers": {"t": ["a"]}})
    assert rows(manifests.flow_manifest(texts(spark, f_json=flow)).select("service", "role", "topic")) == [("s", "produce", "b"), ("s", "produce", "phys.a"), ("t", "consume", "phys.a")]
    api = json.dumps({"paths": {"/a/{id}": {"get": {"x": 1}, "parameters": []}, "b": {"post": {}}}})
    assert rows(manifests.openapi_routes(texts(spark, o_json=api)).select("topic")) == [("GET /a/{id}",), ("POST /b",)]


def test_builds_and_workloads(spark):
    pom = '<project xmlns="http://maven.apache.org/POM/4.0.0"><parent><version>7</version></parent><artifactId>a</artifactId><dependencies><dependency><artifactId>lib</artifactId></dependency></dependencies></project>'
    maven = manifests.maven_modules(spark.createDataFrame([("x/pom.xml", pom)], "path string, text string"))
    assert rows(maven.select("folder", "name", "version", "packaging")) == [("x", "a", "7", "jar")] and maven.first()["dependencies"] == ["lib"]
    build = "version = '1.2'\ndependencies { implementation project(':core') }"
    gradle = manifests.gradle_modules(spark.createDataFrame([("x/build.gradle", build), ("y/z/build.gradle.kts", build)], "path string, text string"))
    assert rows(gradle.select("folder", "name", "version")) == [("x", "x", "1.2"), ("y/z", "z", "1.2")] and gradle.first()["dependencies"] == ["core"]
    assert rows(manifests.modules(maven, gradle).select("folder", "build")) == [("x", "maven"), ("y/z", "gradle")]
    items = {"items": [{"kind": "Deployment", "metadata": {"name": "a", "namespace": "n"}, "spec": {"replicas": 2, "template": {"spec": {"containers": [{"resources": {"requests": {"cpu": "250m", "memory": "1Ki"}}}, {"resources": {"requests": {"cpu": "1"}}}]}}}}]}
    r = manifests.workloads(texts(spark, k_json=json.dumps(items))).first()
    assert (r["name"], r["replicas"], r["cpu_request_millicores"], r["memory_request_bytes"], r["cpu_limit_millicores"]) == ("a", 2, 1250, 1024, None)


def test_snapshots_are_atomic(spark, tmp_path):
    root = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        snapshot.read(spark, root, "t")
    assert snapshot.publish(spark, root, {"t": spark.range(3)}, {"signature": "a"}) == 1
    old = snapshot.read(spark, root, "t")
    with pytest.raises(Exception, match="boom"):
        snapshot.publish(spark, root, {"t": spark.range(9), "u": spark.range(1).select(F.raise_error(F.lit("boom")).alias("x"))})
    assert snapshot.read(spark, root, "t").count() == 3
    assert snapshot.publish(spark, root, {"t": spark.range(5)}) == 2
    assert (old.count(), snapshot.read(spark, root, "t").count()) == (3, 5)
    found, warnings = snapshot.federation(spark, {"a": root, "b": str(tmp_path / "none")}, "t")
    assert list(found) == ["a"] and len(warnings) == 1


def test_streaming_counts_like_batch(spark, tmp_path):
    testbed.latency_rows(spark, DATA).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    metrics.sink_parquet(metrics.windowed_latency(source, ["service"]), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).agg(F.sum("calls")).first()[0]
    total = spark.read.parquet(str(tmp_path / "in")).count()
    assert 0.95 * total < got <= total  # windows behind the last watermark are still open
