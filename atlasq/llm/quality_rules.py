"""Weak supervision of quality rules, in DataFrame functions only.

Each rule votes good or bad or abstains. Expectation-maximisation over the counts of vote patterns (at most 3 to the
power of the number of rules, whatever the size of the corpus) estimates, for either hidden class, how often each rule
casts each vote; the posterior probability of the good class replaces the demand that all rules pass.

One Project measures a text: its word array is bound once as a lambda's variable, so nothing is evaluated twice.

Defined results: a null or wordless text measures as zeros, fails the base rules and is not kept; repeated rows are
measured each and count each in the estimates; an empty table gives an empty table; input columns are kept, but one that
has an added column's name is replaced (the filter returns the input's columns alone).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import besides, materialise, own_names, plain_names

#: Characters between words, and characters that count as symbols.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]", r"[#*$%&|<>]"
#: The columns that judging adds.
ADDED = ("measures", "votes", "posterior", "base_failed", "kept")
GOOD, BAD, ABSTAIN = "g", "b", "a"
#: A document is kept from this posterior probability on.
LEAST_POSTERIOR = 0.5
#: Rounds of expectation-maximisation at most, and the change at which it ends before.
ROUNDS, STILL = 200, 1e-9


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _size(array: Column) -> Column:
    return F.size(array).cast("long")


def _chars(text: Column, others: str) -> Column:
    """Characters left when those of the class ``others`` are taken away."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def _repeated(words: Column) -> Column:
    """Words in windows of three that occur twice or more: windows sorted by hash stand beside their equals."""

    def equal(a: Column, b: Column) -> Column:
        return (a["h"] == b["h"]) & (a["x"] == b["x"]) & (a["y"] == b["y"]) & (a["z"] == b["z"])

    def window(w: Column, i: Column) -> Column:
        y, z = F.get(words, i + 1), F.get(words, i + 2)
        return F.struct(F.xxhash64(w, y, z).alias("h"), w.alias("x"), y.alias("y"), z.alias("z"), i.alias("i"))

    windows = F.slice(F.transform(words, window), F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    marked = _let(
        F.sort_array(windows),
        lambda s: F.filter(
            F.transform(s, lambda x, j: F.when(equal(x, F.get(s, j - 1)) | equal(x, F.get(s, j + 1)), x["i"])),
            lambda i: i.isNotNull(),
        ),
    )
    return _size(F.array_distinct(F.flatten(F.transform(marked, lambda i: F.array(i, i + 1, i + 2)))))


def measured(docs: DataFrame, text_col: str = "text", out_col: str = "measures") -> DataFrame:
    """docs with a struct of counts for each text."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def of(words: Column) -> Column:
        def of_lines(lines: Column) -> list[Column]:
            return [_size(lines).alias("n_lines"), (_size(lines) - _size(F.array_distinct(lines))).alias("n_dup_lines")]

        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            _size(words).alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _chars(text, r"[^#*$%&|<>]+").alias("n_symbols"),
            _let(lines, lambda x: F.struct(*of_lines(x))).alias("lines"),
            _repeated(words).alias("n_repeat_words"),
            _chars(text, r"\P{Lu}+").alias("n_capitals"),
            _chars(text, r"[^!?]+").alias("n_shouts"),
            _chars(text, r"[^\p{L}\p{N}]+").alias("n_alnum"),
            _size(F.filter(words, lambda w: ~w.rlike(r"[\p{L}\p{N}]"))).alias("n_bare"),
        )

    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    return docs.withColumn(out_col, _let(words, of))


def rules(m: Column) -> dict[str, Column]:
    """The vote of each rule from the measures."""
    n, chars = m["n_words"], m["word_chars"]

    def vote(bad: Column, good: Column) -> Column:
        return F.when(n == 0, F.lit(ABSTAIN)).when(bad, F.lit(BAD)).when(good, F.lit(GOOD)).otherwise(F.lit(ABSTAIN))

    lines = m["lines"]
    return {
        "length": vote(n < 20, n >= 50),
        "symbols": vote(m["n_symbols"] * 10 > n, m["n_symbols"] * 50 <= n),
        "capitals": vote(m["n_capitals"] * 5 > chars * 2, m["n_capitals"] * 5 < chars),
        "letters": vote(m["n_alnum"] * 5 < chars * 4, m["n_alnum"] * 20 >= chars * 17),
        "bare words": vote(m["n_bare"] * 5 > n, m["n_bare"] * 20 <= n),
        "shouting": vote(m["n_shouts"] * 5 > n, m["n_shouts"] * 20 <= n),
        "repeated lines": vote(lines["n_dup_lines"] * 10 > lines["n_lines"] * 3, (lines["n_dup_lines"] * 20 <= lines["n_lines"]) & (lines["n_lines"] > 2)),
        "repeated words": vote(m["n_repeat_words"] * 10 > n * 3, m["n_repeat_words"] * 20 <= n),
        "word length": vote((chars < n * 2) | (chars > n * 12), (chars >= n * 3) & (chars <= n * 9)),
    }


def base_failed(m: Column) -> Column:
    """The two base rules."""
    return (m["n_words"] < 50) | (m["n_repeat_words"] * 100 > m["n_words"] * 50)


def fit(patterns: dict[str, int], n_rules: int) -> tuple[float, list[dict[str, float]]]:
    """The log odds of the good class, and what each vote of each rule adds to them.

    The prior of a rule (as of a hundredth of a percent of the corpus, two documents at least) is that it rather abstains
    than votes wrong; it decides only where the corpus says nothing, and which of the classes is the good one.
    """
    total = sum(patterns.values())
    if not total:
        return 0.0, [dict.fromkeys((GOOD, BAD, ABSTAIN), 0.0) for _ in range(n_rules)]
    strength = max(2.0, total * 1e-4)
    prior = {True: {GOOD: 0.6, BAD: 0.01, ABSTAIN: 0.39}, False: {GOOD: 0.3, BAD: 0.3, ABSTAIN: 0.4}}
    likely = {p: 0.02 if BAD in p else 0.98 for p in patterns}
    start, gains = 0.0, []
    for _ in range(ROUNDS):
        good = sum(n * likely[p] for p, n in patterns.items())
        start = math.log((good + 1) / (total - good + 1))
        gains = []
        for j in range(n_rules):
            seen = {True: dict.fromkeys((GOOD, BAD, ABSTAIN), 0.0), False: dict.fromkeys((GOOD, BAD, ABSTAIN), 0.0)}
            for p, n in patterns.items():
                seen[True][p[j]] += n * likely[p]
                seen[False][p[j]] += n * (1 - likely[p])
            rate = {y: {v: (seen[y][v] + strength * prior[y][v]) / (sum(seen[y].values()) + strength) for v in seen[y]} for y in seen}
            gains.append({v: math.log(rate[True][v] / rate[False][v]) for v in rate[True]})
        now = {p: 1 / (1 + math.exp(-max(-700.0, min(700.0, start + sum(g[v] for g, v in zip(gains, p)))))) for p in patterns}
        change, likely = max(abs(now[p] - likely[p]) for p in patterns), now
        if change < STILL:
            break
    return start, gains


def judged(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with their measures, posterior and kept; a scratch table holds these columns and the
    measures between the two reads."""
    kept = besides(docs.columns if keep is None else keep, ADDED)
    found = measured(docs, text_col).select(*(F.col(f"`{c}`") for c in kept), "measures")
    votes = rules(F.col("measures"))
    found = materialise(found.withColumn("votes", F.concat(*votes.values())))
    patterns = {r["votes"]: r["n"] for r in found.groupBy("votes").agg(F.count("*").alias("n")).collect()}  # at most 3 ** len(votes) rows
    start, gains = fit(patterns, len(votes))
    odds = F.lit(start)
    for j, gain in enumerate(gains):
        vote = F.substring("votes", j + 1, 1)
        odds = odds + F.when(vote == GOOD, gain[GOOD]).when(vote == BAD, gain[BAD]).otherwise(gain[ABSTAIN])
    return (
        found.withColumn("posterior", F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)))
        .withColumn("base_failed", base_failed(F.col("measures")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= LEAST_POSTERIOR))
    )


def filtered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are kept, with the columns of docs."""
    return own_names(judged(*plain_names(docs, text_col)).where("kept"), docs)


def op2_quality_rules(docs: DataFrame) -> DataFrame:
    """The result of query op2 over documents."""
    m = F.col("measures")
    out = judged(docs.select("doc_id", "text"), keep=["doc_id"])
    return out.select("doc_id", m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"), m["lines"]["n_dup_lines"].alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words"), "base_failed", "kept", "posterior")
