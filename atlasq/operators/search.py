"""Lexical search over findings by weighted fields, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E

#: The weight of each field, and what the kinds of match count.
WEIGHTS = {"rule_id": 6, "message": 4, "path": 3, "cwe": 5, "owasp": 5, "snippet": 2, "severity": 1}
EXACT, PART, PLAIN_EXACT, PLAIN_PART = 8, 4, 6, 3


def _plain(text: Column) -> Column:
    """The words alone, with single spaces between."""
    return F.array_join(E.word_tokens(text), " ")


def _text(df: DataFrame, field: str) -> Column:
    """A field as text; several values stand side by side."""
    kind = dict(df.dtypes)[field]
    return F.coalesce(F.array_join(field, " ") if kind.startswith("array") else F.col(field).cast("string"), F.lit(""))


def scored(findings: DataFrame, query: str, weights: dict[str, int] = WEIGHTS) -> DataFrame:
    """findings with score: 0 unless every word of the query occurs in some field."""
    low, words = query.lower().strip(), sorted(set(re.findall(r"\w+", query.lower())))
    bare = " ".join(re.findall(r"\w+", low))
    fields = {f: w for f, w in weights.items() if f in findings.columns}
    total, present = F.lit(0), {w: F.lit(False) for w in words}
    for field, weight in fields.items():
        text = F.lower(_text(findings, field))
        plain = _plain(text)
        whole = F.when(text == low, EXACT).when(text.contains(low), PART).otherwise(0) if low else F.lit(0)
        loose = F.when(plain == bare, PLAIN_EXACT).when(plain.contains(bare), PLAIN_PART).otherwise(0) if bare else F.lit(0)
        tokens = E.word_tokens(text)
        total = total + (whole + loose) * weight
        for word in words:
            has = F.array_contains(tokens, word)
            total = total + F.when(has, weight).otherwise(0)
            present[word] = present[word] | has
    every = F.lit(True)
    for has in present.values():
        every = every & has
    return findings.withColumn("score", F.when(every, total).otherwise(0) if words else F.lit(0))


def search(findings: DataFrame, query: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Hits, best first; an empty query gives all in inventory order."""
    order = [c for c in ("path", "start_line", "end_line", "id") if c in findings.columns]
    if not query.strip():
        out = findings.withColumn("score", F.lit(0)).orderBy(E.severity_rank(F.col("severity")).desc(), *order)
    else:
        out = scored(findings, query).where("score > 0").orderBy(F.col("score").desc(), E.severity_rank(F.col("severity")).desc(), *order)
    return (out.offset(offset) if offset else out) if limit is None else out.offset(offset).limit(limit)


def summary(findings: DataFrame, top_rules: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts by severity, of the most frequent rules, and by top folder."""
    rules = findings.groupBy("rule_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "rule_id").limit(top_rules)
    return findings.groupBy("severity").agg(F.count("*").alias("n")), rules, findings.groupBy(F.substring_index("path", "/", 1).alias("folder")).agg(F.count("*").alias("n"))


def filtered(findings: DataFrame, least_severity: str | None = None, rule_id: str | None = None, path_glob: str | None = None, module: str | None = None) -> DataFrame:
    out = findings
    if least_severity is not None:
        out = out.where(E.severity_rank(F.col("severity")) >= E.SEVERITIES.index(least_severity))
    if rule_id is not None:
        out = out.where(F.col("rule_id") == rule_id)
    if path_glob is not None:
        out = out.where(E.glob(F.col("path"), path_glob))
    return out if module is None else out.where(F.col("module") == module)


def trace_flow(endpoints: DataFrame, query: str) -> DataFrame:
    """All endpoints of the topic or route that the query means: the exact one, else the only one that contains it."""
    from .resolve import resolve_name

    one = resolve_name(endpoints, query, "topic")
    return endpoints.join(F.broadcast(one), "topic", "left_semi").dropDuplicates(["system", "id"])  # one row


def context(files: DataFrame, places: DataFrame, around: int = 5) -> DataFrame:
    """places(path, line) with the lines around. files: (path, text)."""
    lines = F.split("text", "\n")
    first = F.greatest(F.lit(1), F.col("line") - around)
    return places.join(files, "path").select("path", "line", first.alias("first_line"), F.array_join(F.slice(lines, first, F.col("line") + around - first + 1), "\n").alias("context"))
