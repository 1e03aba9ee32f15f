import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasq.llm import near_duplicates
from tests.conftest import DATA


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """Class and number of links of every row, by position."""
    sets, parent, links = [shingles(t) for _, t in rows], list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    at = collections.defaultdict(list)
    for i, s in enumerate(sets):
        common = collections.Counter(j for g in s for j in at[g])
        for g in s:
            at[g].append(i)
        for j, k in common.items():
            if 5 * k >= 4 * (len(s) + len(sets[j]) - k):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    lowest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            lowest[find(i)] = min(doc, lowest.get(find(i), doc))
    return sorted((str((doc, lowest.get(find(i)) if sets[i] else doc, links[i])) for i, (doc, _) in enumerate(rows)))


def families(n):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for k in range(12):
        base = list(rng.choice(vocabulary, 120))
        for c in range(n):
            own = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 5)):
                own[at] = rng.choice(vocabulary)
            rows.append((k * 100 + c, " ".join(own)))
    return rows


@pytest.mark.parametrize("block", [128, 7])
def test_links_and_classes_against_brute_force(spark, plain, monkeypatch, block):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    rows = families(14) + [tuple(r) for r in plain.collect()] + [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(str(tuple(r)) for r in near_duplicates.op3_near_duplicates(docs).collect()) == brute(rows)


def test_pruning_bound():
    least = near_duplicates.least_matches(24, 0.8, 1e-6)
    assert 0 < least < 24 * 0.8 and near_duplicates.least_matches(240, 0.8, 1e-6) > 10 * least


def test_both_ways_of_verifying_agree():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    sets = [np.unique(np.where(rng.random(len(base)) < 0.04, rng.integers(0, 2**63, len(base)).astype(np.uint64), base)) for _ in range(40)]
    a, b = np.triu_indices(40, 1)
    many = near_duplicates._verified(sets, a, b)
    few = np.concatenate([near_duplicates._verified(sets, a[i : i + 9], b[i : i + 9]) for i in range(0, len(a), 9)])
    assert (many == few).all() and many.any() and not many.all()


def test_one_of_each_class_stays(spark, odd):
    rows = families(5) + families(5)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = near_duplicates.one_of_each(docs).collect()
    classes = {r["class_id"] for r in near_duplicates.op3_near_duplicates(docs).collect()}
    assert sorted(r["doc_id"] for r in left) == sorted(classes)
    kept = near_duplicates.one_of_each(odd)
    assert kept.columns == odd.columns
    texts = [r["text"] for r in kept.collect()]
    assert texts.count("A short one.") == 1 and texts.count("Another text of the same id.") == 1 and None in texts and "" in texts
    assert near_duplicates.one_of_each(odd.where("false")).count() == 0


def test_one_large_chain_is_dealt_without_all_pairs_of_blocks(spark):
    """5,000 texts, each like its neighbours and unlike those far away."""
    n, size = 5000, 120
    rows = [(i, " ".join(f"w{3 * i + k}" for k in range(size))) for i in range(n)]
    docs = spark.createDataFrame(rows, "id bigint, text string").repartition(4)
    keyed = near_duplicates.keyed(docs, with_bands=True).cache()
    banded = keyed.selectExpr("key", "explode(bands) AS bucket")
    buckets = banded.groupBy("bucket").agg(F.min("key").alias("hub"), F.count("*").alias("n")).where("n > 1").select("bucket", "hub")
    shared = banded.join(buckets, "bucket").cache()
    near = near_duplicates.components(shared.selectExpr("key AS a", "hub AS b"))
    assert near.select("label").distinct().count() == 1
    placed = near_duplicates.blocks(near).cache()
    n_blocks, pairs = placed.select("block").distinct().count(), near_duplicates.block_pairs(shared, placed)
    largest = placed.groupBy("block").count().agg(F.max("count")).first()[0]
    assert placed.count() == n and n // 128 <= n_blocks and largest < 400
    assert pairs.count() == pairs.distinct().count() <= 6 * n_blocks  # not the square
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates.op3_near_duplicates(docs.withColumnRenamed("id", "doc_id")).collect()}
    assert got == {i: (0, sum(0 <= j < n for d in range(1, 5) for j in (i - d, i + d))) for i in range(n)}


def test_many_rows_without_or_with_one_id(spark):
    texts = [" ".join(f"w{k * 7 + j}" for j in range(40)) for k in range(30)]
    rows = [(None, t) for t in texts for _ in range(3)] + [(1, t) for t in texts]
    out = near_duplicates.op3_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert len(out) == 120 and all(r["n_links"] == 3 for r in out)
