import collections
import functools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasq.llm import katz
from tests.conftest import DATA


def tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [("end",)]


class Brute:
    """The model by plain counting."""

    def __init__(self, texts, order):
        self.c, self.after = [collections.Counter() for _ in range(order + 1)], collections.defaultdict(collections.Counter)
        for t in texts:
            padded = [("start",)] * (order - 1) + t
            for i in range(len(t)):
                for k in range(1, order + 1):
                    gram = tuple(padded[i + order - k : i + order])
                    self.c[k][gram] += 1
                    self.after[gram[:-1]][gram[-1]] += 1
        coc = lambda counts: [float(sum(v == r for v in counts.values())) for r in range(1, katz.LARGE + 2)]
        self.by = [None, *(katz.Discounts(sum(c.values()), len(c), coc(c)) for c in self.c[1:])]
        self.unigrams = katz.Unigrams(self.by[1])
        self.n, self.v = sum(self.c[1].values()), len(self.c[1])

    def discounted(self, k, n):
        return float(self.by[k].discounted(np.array([float(n)]))[0])

    @functools.cache
    def weight(self, h):
        """Back-off weight, and what counts are divided by."""
        k, after = len(h) + 1, self.after[h]
        total = sum(after.values())
        freed = sum(n - self.discounted(k, n) for n in after.values())
        rest = 1 - sum(self.p(h[1:], w) for w in after)
        return (freed / total / rest, total) if freed > 0 else (1 / (total + 1) / rest, total + 1)

    @functools.cache
    def p(self, h, w):
        k, n = len(h) + 1, self.c[len(h) + 1].get((*h, w), 0)
        if not h:
            return float(self.unigrams.of(np.array([float(n)]))[0])
        if h not in self.after:
            return self.p(h[1:], w)
        weight, over = self.weight(h)
        return (n if over > sum(self.after[h].values()) else self.discounted(k, n)) / over if n else weight * self.p(h[1:], w)

    def score(self, t, order):
        padded = [("start",)] * (order - 1) + t
        return sum(math.log10(self.p(tuple(padded[i : i + order - 1]), w)) for i, w in enumerate(t))


@pytest.mark.parametrize(("size", "order"), [(10**9, 3), (4000, 3), (4000, 2), (1000, 4), (4000, 1)])
def test_scores_against_plain_counting(spark, plain, size, order):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").union(plain.where("doc_id < 4 OR doc_id > 5 OR doc_id IS NULL"))
    docs = docs.where("length(text) < 3000 OR doc_id % 5 = 0 OR text IS NULL").repartition(3)
    rows = [(r["doc_id"], tokens(r["text"])) for r in docs.collect()]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    model = Brute([t for d, t in rows if not held(d)], order)
    want = sorted((str(d), held(d), len(t), sum((w,) in model.c[1] for w in t), model.n) for d, t in rows)
    marked = docs.withColumn("train", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 != 0)
    got = katz.scored(marked, "train", order=order, pack_tokens=size).collect()
    assert sorted((str(r["id"]), not r["train"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == want
    scores = {(str(r["id"]), r["n_tokens"]): r for r in got}
    for d, t in rows:
        r = scores[str(d), len(t)]
        assert r["score"] == pytest.approx(model.score(t, order), rel=1e-9), (d, held(d))
        assert r["base_score"] == pytest.approx(sum(math.log10((model.c[1].get((w,), 0) + 0.1) / (model.n + 0.1 * (model.v + 1))) for w in t), rel=1e-9)
    histories = sorted((h for h in model.after if len(h) == order - 1), key=str)
    for h in [("start",) * (order - 1), *histories[50:55], *sorted(histories, key=lambda h: -len(model.after[h]))[:3]]:
        h = tuple(("start",) if x == "start" else x for x in h)
        assert sum(model.p(h, w) for (w,) in model.c[1]) + model.p(h, ("unknown",)) == pytest.approx(1, abs=1e-12)
    if order > 1:
        held_out = [r for r in got if not r["train"]]
        assert sum(r["score"] for r in held_out) > sum(r["base_score"] for r in held_out)


def test_op1(spark, plain):
    out = katz.op1_katz(plain).collect()
    assert len(out) == plain.count() and all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 10 == 0) for r in out)


def test_nothing_to_learn_from_and_nothing_to_score(spark, odd):
    rows = odd.withColumn("train", F.lit(False))
    out = katz.scored(rows, "train").collect()
    assert len(out) == odd.count() and all(r["score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in out)
    assert katz.op1_katz(odd.where("false")).count() == 0


def test_tables_stay_where_asked(spark, plain, tmp_path):
    katz.scored(plain.withColumn("train", F.lit(True)), "train", tables=str(tmp_path / "model"), pack_tokens=2000).count()
    for name in ("counts-1", "counts-2", "counts-3", "weights-2", "weights-3"):
        assert spark.read.parquet(str(tmp_path / "model" / name)).where("pack = -1 AND keys IS NOT NULL").count() > 0
