import numpy as np
import pyarrow as pa
import pytest

from atlasq.llm import mil_quality
from tests.conftest import DATA


def test_gradient(monkeypatch):
    monkeypatch.setattr(mil_quality, "STEPS", 1)
    rng = np.random.default_rng(0)
    x, begins, y = rng.normal(size=(9, mil_quality.N_FEATURES)), np.array([0, 3, 4, 9]), np.array([1.0, 0, 1])
    model = mil_quality.Model().fit(x, begins, y)
    scaled = model.scaled(x)
    gradient = model.gradient(scaled, begins, y)

    def loss():
        s = model._forward(scaled, begins)[-1]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for name, value in gradient.items():
        own = model.weights[name] = np.array(model.weights[name])
        at = (0,) * own.ndim
        kept = float(own[at])
        own[at] = kept + 1e-6
        up = loss()
        own[at] = kept - 1e-6
        down = loss()
        own[at] = kept
        assert (up - down) / 2e-6 == pytest.approx(float(np.asarray(value)[at]), abs=1e-7)


def test_passages_cover_the_text():
    x, begins = mil_quality.features(pa.array(["", " ", "one two", "w " * 130, "#$% AB! 12 é\nq"]))
    assert begins.tolist() == [0, 1, 2, 3, 6, 7] and not x[:2].any()
    assert np.allclose(x[3:6, 8] * mil_quality.PASSAGE, [64, 64, 2])


def test_held_out_ranking(spark):
    d = DATA.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = mil_quality.op9_quality_classifier(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r["score"] for r in out if r["quality"]], [r["score"] for r in out if not r["quality"]]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in out)


def test_odd_and_empty_tables(spark, odd):
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (8, 1, 0), (None, 0, 0), (9, None, 0)], "doc_id bigint, quality int, toxic int")
    out = mil_quality.op9_quality_classifier(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in mil_quality.op9_quality_classifier(odd, labels.where("false")).collect()} == {0.5}
    assert mil_quality.op9_quality_classifier(odd.where("false"), labels).count() == 0
    bags = mil_quality.scored(odd, mil_quality.Model(0.4))
    assert {r["lang"] for r in bags.collect()} == {"own"} and all(sum(r["attention"]) >= 1 for r in bags.collect())


def test_features_do_not_depend_on_neighbours():
    import pyarrow as pa

    texts = ["a a a b c d", "a a a", "x", "", "a a a b c d " * 30]
    alone = [mil_quality.features(pa.array([t]))[0] for t in texts]
    together, begins = mil_quality.features(pa.array(texts))
    assert all(np.array_equal(x, together[a:b]) for x, a, b in zip(alone, begins, begins[1:]))


def test_scores_against_brute_force(spark):
    """The fitted model's attention and score, passage by passage and unit by unit."""
    import math

    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    from pyspark.sql import functions as F

    model = mil_quality.fitted(*mil_quality.sample_of(docs, labels, F.crc32(F.col("key").cast("string")) % 5 != 0, "doc_id", "quality"))
    got = {r["doc_id"]: r["score"] for r in mil_quality.op9_quality_classifier(docs, labels).collect()}
    p, sigmoid = model.weights, lambda x: 1 / (1 + math.exp(-x))
    for r in docs.where("doc_id < 40").collect():
        x, _ = mil_quality.features(pa.array([r["text"] or ""]))
        encoded, logits = [], []
        for row in x:
            scaled = [max(-8.0, min(8.0, (v - m) / s)) for v, m, s in zip(row, model.mean, model.std)]
            h = [math.tanh(sum(v * w for v, w in zip(scaled, p["we"][:, j])) + p["be"][j]) for j in range(mil_quality.ENCODED)]
            gated = [math.tanh(sum(a * w for a, w in zip(h, p["wt"][:, j]))) * sigmoid(sum(a * w for a, w in zip(h, p["wg"][:, j]))) for j in range(mil_quality.ATTENTION)]
            encoded.append(h)
            logits.append(sum(a * w for a, w in zip(gated, p["wa"])))
        weights = [math.exp(v - max(logits)) for v in logits]
        bag = [sum(w * h[j] for w, h in zip(weights, encoded)) / sum(weights) for j in range(mil_quality.ENCODED)]
        assert got[r["doc_id"]] == pytest.approx(sigmoid(sum(a * w for a, w in zip(bag, p["wo"])) + p["bo"]), abs=1e-9)
