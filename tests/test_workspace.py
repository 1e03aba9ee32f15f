import json

import pytest

from atlasq import __main__ as cli
from atlasq import workspace
from atlasq.sources import java, paged

POM = "<project><artifactId>{name}</artifactId><version>1</version><dependencies><dependency><artifactId>{dep}</artifactId></dependency></dependencies></project>"
SERVER = """package b; @RestController @RequestMapping("${{api.base:/none}}") class B {{
  // {pad}
  @GetMapping("/x/{{id}}") A get() {{ return null; }}
  @KafkaListener(topics = "paid") void on(Order o) {{ }}
  public static void main(String[] a) {{ SpringApplication.run(B.class, a); }}
}}
@Document class Thing {{ }}
"""
CLIENT = """class A {{ void a(String id) {{
  restTemplate.getForObject("http://b/v1/x/" + id, String.class); kafkaTemplate.send("paid", new Order());
}} }}
"""


@pytest.fixture
def tree(tmp_path):
    for folder, name, dep, file, text in (("a", "a", "b", "A.java", CLIENT), ("b", "b", "spring-boot", "B.java", SERVER), ("b-test", "b-test", "b", "T.java", CLIENT)):
        (tmp_path / "src" / folder / "main").mkdir(parents=True)
        (tmp_path / "src" / folder / "pom.xml").write_text(POM.format(name=name, dep=dep))
        (tmp_path / "src" / folder / "main" / file).write_text(text.format(pad="x" * 5000))
    (tmp_path / "src" / "b" / "application.yml").write_text("api:\n  base: /v1\n")
    (tmp_path / "src" / "b" / "main" / "Broken.java").write_text("class X {")
    return str(tmp_path / "src"), str(tmp_path / "store")


def test_index_and_tools(spark, tree, capsys):
    root, store = tree
    first = workspace.index(spark, root, store, "local").first()
    assert first["added"] == 8 and first["facts"] > 0
    again = workspace.index(spark, root, store, "local").first()
    assert again["added"] == again["modified"] == 0 and again["unchanged"] == 8
    tools = workspace.Tools(spark, {"local": store})
    edges = {(r["source"], r["target"], r["kind"], r["label"]) for r in tools.graph().collect()}
    assert edges == {("a", "b", "rest", "GET /v1/x/{id}"), ("a", "b", "kafka", "paid")}  # nothing of the test module
    assert [r["path"] for r in tools.architecture_catalog("microservice", "path", "a", "b").collect()] == ["a -[GET /v1/x/{id}]-> b", "a -[paid]-> b"]
    assert [r["service"] for r in tools.architecture_catalog("topic", "consumers", "paid").collect()] == ["b"]
    assert {r["neighbour"] for r in tools.architecture_catalog("service", "impact", "paid").collect()} == {"a", "b"}
    assert [r["name"] for r in tools.architecture_catalog("collections").collect()] == ["thing"]
    assert {r["system"] for r in tools.trace_message_flow("PAI").collect()} == {"a", "b"}
    assert {r["relation"] for r in tools.architecture_coverage().collect()} == {"publishes", "consumes", "provides", "calls", "calls_service", "publishes_to"}
    assert tools.architecture_audit().count() == 0 and tools.audit_dependency_graph().count() == 0
    assert {r["name"]: r["starts_application"] for r in tools.list_modules().collect()}["b"]
    assert sorted(r["service"] for r in tools.list_workspace_services().collect()) == ["a", "b"]
    checks = {r["name"]: (r["status"], r["detail"]) for r in workspace.doctor(spark, store).collect()}
    assert checks["index"][0] == "ok" and checks["extraction"] == ("warning", "1 files could not be read")
    assert workspace.doctor(spark, store + "-none", "min_severity: LOUD").collect()[0]["status"] == "error"
    assert cli.main(["catalog", store, "topic"], spark) == 0
    assert json.loads(capsys.readouterr().out.strip())["name"] == "paid"
    with pytest.raises(ValueError):
        tools.architecture_catalog("topic", "path", "a")


def test_config():
    assert workspace.Config.parsed(workspace.Config(include=("a/*",)).text()) == workspace.Config(include=("a/*",))
    with pytest.raises(ValueError):
        workspace.Config.parsed("min_severity: LOUD")


def test_model_text():
    text = workspace.model_text([("a b", "service"), ("a-b", "service"), ("a_b", "topic")], [("a b", "a_b", "it's")])
    assert "a_b = service 'a b'" in text and "a_b_2 = topic 'a_b'" in text and "a_b -> a_b_2 'it\\'s'" in text


def test_pages(spark):
    def fetch(after):
        start = 0 if after is None else after
        return [{"a": k, "b": str(k)} for k in range(start, min(start + 10, 25))], start + 10 if start + 10 < 25 else None

    rows = lambda cap: paged.read(spark, fetch, "a int, b string", cap).collect()
    assert [r["a"] for r in rows(100)] == list(range(25)) and not rows(100)[0]["truncated"]
    assert len(rows(20)) == 20 and rows(20)[0]["truncated"] and not rows(25)[0]["truncated"]


def test_extensions(spark):
    texts = spark.createDataFrame([("A.java", "class A { }")], "path string, text string")
    extra = lambda path, source: [(path, "own", None, "t", False, "mine", 1, 1, source, None)]
    assert [r["framework"] for r in java.facts(texts, (extra,)).collect()] == ["mine"]
