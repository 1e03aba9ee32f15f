import collections
import math
import re
import unicodedata

from atlasq.llm import quality_rules
from tests.conftest import DATA


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    times = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_measures_against_brute_force(spark, plain):
    docs = plain.union(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"))
    got = sorted(map(str, ((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality_rules.op2_quality_rules(docs).collect())))
    assert got == sorted(str((r["doc_id"], *brute(r["text"]))) for r in docs.collect())


def test_labels_are_met(spark):
    d = DATA.replace("0.001", "0.01")
    out = quality_rules.op2_quality_rules(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in out) >= 0.98 * len(out)


def test_expectation_maximisation_tells_the_classes():
    patterns = {"gggg": 800, "gagg": 100, "bbgg": 40, "gbbg": 40, "bgbb": 20}
    start, gains = quality_rules.fit(patterns, 4)
    odds = {p: start + sum(g[v] for g, v in zip(gains, p)) for p in patterns}
    assert all((odds[p] > 0) == (p in ("gggg", "gagg")) for p in patterns)
    assert quality_rules.fit({}, 2)[0] == 0.0


def test_odd_and_empty_tables(odd):
    assert quality_rules.filtered(odd).columns == odd.columns
    assert not quality_rules.op2_quality_rules(odd.where("text IS NULL")).first()["kept"]
    assert quality_rules.op2_quality_rules(odd.where("false")).count() == 0
    assert "own" in {r["lang"] for r in quality_rules.judged(odd).collect()}


def votes(text):
    """The nine rules by plain counting, in their order."""
    text = text or ""
    n, chars, symbols, dup, repeated, _ = brute(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    of = lambda kinds: sum(unicodedata.category(c) in kinds or unicodedata.category(c)[0] in kinds for c in text)
    capitals, shouts, alnum = of(("Lu",)), sum(c in "!?" for c in text), of(("L", "N"))
    bare = sum(not any(unicodedata.category(c)[0] in "LN" for c in w) for w in words)
    pairs = [
        (n < 20, n >= 50), (symbols * 10 > n, symbols * 50 <= n), (capitals * 5 > chars * 2, capitals * 5 < chars), (alnum * 5 < chars * 4, alnum * 20 >= chars * 17), (bare * 5 > n, bare * 20 <= n),
        (shouts * 5 > n, shouts * 20 <= n), (dup * 10 > len(lines) * 3, dup * 20 <= len(lines) and len(lines) > 2), (repeated * 10 > n * 3, repeated * 20 <= n), (chars < n * 2 or chars > n * 12, n * 3 <= chars <= n * 9),
    ]
    return "".join("a" if not n else "b" if bad else "g" if good else "a" for bad, good in pairs)


def test_posterior_and_kept_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    cast = {r["doc_id"]: votes(r["text"]) for r in docs.collect()}
    start, gains = quality_rules.fit(dict(collections.Counter(cast.values())), 9)
    for r in quality_rules.op2_quality_rules(docs).collect():
        odds = start + sum(g[v] for g, v in zip(gains, cast[r["doc_id"]]))
        assert abs(r["posterior"] - 1 / (1 + math.exp(-odds))) < 1e-9
        assert r["kept"] == (not r["base_failed"] and odds >= 0)
