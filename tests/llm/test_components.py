import collections
import re

import pytest

from atlasq.llm import components as components_module
from atlasq.llm.components import components


def of(spark, edges):
    rows = components(spark.createDataFrame(edges, "a string, b string").repartition(3)).collect()
    out = collections.defaultdict(set)
    for r in rows:
        out[r["label"]].add(r["node"])
        assert not r["levels"] or r["levels"][-1] == r["label"]
    assert len(rows) == len({r["node"] for r in rows})
    return sorted(map(sorted, out.values()))


def test_long_chains_and_hot_hubs(spark):
    chain = [(f"c{k:04}", f"c{k + 1:04}") for k in range(400)]
    hub = [("hub", f"h{k:04}") for k in range(2000)]
    assert of(spark, chain + hub) == [sorted({x for e in chain for x in e}), sorted({x for e in hub for x in e})]


def test_nulls_loops_repeats_and_nothing(spark):
    assert of(spark, [("a", "a"), ("b", None), (None, None), ("x", "y"), ("y", "x"), ("x", "y")]) == [["a"], ["x", "y"]]
    assert of(spark, [("a", "a")]) == [["a"]]
    assert of(spark, []) == []


def test_rounds_neither_broadcast_nor_pile_up_joins(spark, monkeypatch):
    """The driver holds what it broadcasts, and the plans of all joins of a query at once."""
    plans, write = [], components_module.materialise

    def seen(df, *path):
        plans.append(df)
        return write(df, *path)

    monkeypatch.setattr(components_module, "materialise", seen)
    monkeypatch.setattr(components_module, "LOCAL", 0)
    assert of(spark, [(f"c{k:04}", f"c{k + 1:04}") for k in range(400)]) == [[f"c{k:04}" for k in range(401)]]
    shown = [df._jdf.queryExecution().executedPlan().toString() for df in plans]
    assert len(shown) > 8 and not any("Broadcast" in p for p in shown)
    assert max(len(re.findall(r"(?<!\w)\w+Join\b", p)) for p in shown) == 2


@pytest.mark.parametrize("local", [0, 40, 10_000])
def test_rounds_on_tables_and_in_one_task_agree(spark, monkeypatch, local):
    monkeypatch.setattr(components_module, "LOCAL", local)
    edges = [(f"{k}c{i:02}", f"{k}c{i + 1:02}") for k in range(9) for i in range(3 * k + 1)] + [("hub", f"h{i}") for i in range(50)] + [("l", "l"), ("x", None)]
    expected = sorted([*([f"{k}c{i:02}" for i in range(3 * k + 2)] for k in range(9)), sorted(["hub", *(f"h{i}" for i in range(50))]), ["l"]])
    assert of(spark, edges) == expected
    for schema, values in (("a bigint, b bigint", (1, 2, 3)), ("a binary, b binary", (b"1", b"2", b"3"))):
        x, y, z = values
        found = components(spark.createDataFrame([(x, y), (y, z)], schema)).collect()
        assert sorted(r["node"] for r in found) == list(values) and len({r["label"] for r in found}) == 1


def test_few_edges_take_few_queries(spark, monkeypatch):
    made, write = [], components_module.materialise
    monkeypatch.setattr(components_module, "materialise", lambda df, *path: made.append(df) or write(df, *path))
    assert of(spark, [(f"c{k:04}", f"c{k + 1:04}") for k in range(400)]) == [[f"c{k:04}" for k in range(401)]]
    assert len(made) == 2
