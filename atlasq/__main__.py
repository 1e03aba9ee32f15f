"""``python -m atlasq index ROOT STORE``, ``catalog KIND [ACTION] [NAME]``, ``audit``, ``flow QUERY``, ``doctor`` and more over a
published store; rows are printed as JSON lines."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import workspace


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="atlasq")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, wanted in {"index": ("root", "store"), "doctor": ("store",), "audit": ("store",), "coverage": ("store",), "modules": ("store",), "graph": ("store",), "endpoints": ("store",), "flow": ("store", "query")}.items():
        one = commands.add_parser(name)
        for w in wanted:
            one.add_argument(w)
        if name == "index":
            one.add_argument("--system", default="local")
            one.add_argument("--config")
    one = commands.add_parser("catalog")
    for w in ("store", "kind"):
        one.add_argument(w)
    one.add_argument("action", nargs="?", default="list")
    one.add_argument("name", nargs="?")
    one.add_argument("target", nargs="?")
    given = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("atlasq").getOrCreate()
    tools = workspace.Tools(spark, {"local": given.store})
    if given.command == "index":
        config = workspace.Config()
        if given.config:
            with open(given.config, encoding="utf-8") as f:
                config = workspace.Config.parsed(f.read())
        out = workspace.index(spark, given.root, given.store, given.system, config)
    elif given.command == "doctor":
        out = workspace.doctor(spark, given.store)
    elif given.command == "catalog":
        out = tools.architecture_catalog(given.kind, given.action, given.name, given.target)
    elif given.command == "flow":
        out = tools.trace_message_flow(given.query)
    else:
        out = {"audit": tools.architecture_audit, "coverage": tools.architecture_coverage, "modules": tools.list_modules, "graph": tools.graph, "endpoints": tools.list_endpoints}[given.command]()
    for line in out.toJSON().collect():
        print(line)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
