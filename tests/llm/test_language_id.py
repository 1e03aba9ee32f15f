import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasq.llm import language_id
from atlasq.llm.registry import piece_file
from tests.conftest import DATA


def test_forward_sums_all_segmentations_and_counts_are_expected():
    vocab = language_id.vocabulary(piece_file())
    index = {p: i for i, p in enumerate(vocab.pieces)}
    log = np.random.default_rng(0).normal(-8, 1, (len(index), 2))
    words = [b"abc", "▁the".encode(), "▁été".encode(), b"x"]

    def segmentations(w):
        return [[w[:k], *t] for k in range(1, len(w) + 1) if w[:k] in index for t in segmentations(w[k:])] if w else [[]]

    lattice = language_id.Lattice(vocab, words)
    counts = np.array([[1.0, 2], [3, 1], [2, 2], [1, 0]])
    expected = np.zeros_like(log)
    for k, w in enumerate(words):
        for lang in range(2):
            weights = {tuple(s): np.exp(sum(log[index[p], lang] for p in s)) for s in segmentations(w)}
            assert lattice.totals(log)[k, lang] == pytest.approx(np.log(sum(weights.values())))
            for s, weight in weights.items():
                for p in s:
                    expected[index[p], lang] += counts[k, lang] * weight / sum(weights.values())
    assert np.allclose(lattice.expected(log, counts), expected)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet".replace("0.001", "0.01"))
    out = language_id.op6_language_id(docs, piece_file()).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 150 and sum(r["lang"] == r["lang_pred"] for r in out) >= 0.99 * len(out)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_odd_and_empty_tables(spark, odd):
    languages, log = language_id.fit(language_id.vocabulary(piece_file()), [("en", "the words"), ("de", "die Wörter")])
    out = language_id.predict(odd, piece_file(), languages, log).collect()
    assert len(out) == odd.count() and {r["lang"] for r in out} == {"own"}
    und = {r["doc_id"] for r in out if r["lang_pred"] == "und"}
    assert {1, 2, 3, 6} <= und and 8 not in und
    none = language_id.fit(language_id.vocabulary(piece_file()), [])
    assert {r["lang_pred"] for r in language_id.predict(odd, piece_file(), *none).collect()} == {"und"}
    assert language_id.op6_language_id(odd.where("false"), piece_file()).count() == 0


def test_sample_is_bounded_and_by_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language_id.sample_of(docs, F.lit(True), F.col("doc_id"), size=5)
    langs = [lang for lang, _ in got]
    assert set(langs) == {r["lang"] for r in docs.select("lang").distinct().collect()} and max(map(langs.count, langs)) == 5


def test_predictions_against_brute_force(spark):
    import math
    import re
    import zlib

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").where("doc_id < 60 OR text IS NULL")
    vocab = language_id.vocabulary(piece_file())
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    rows = docs.collect()
    sample = language_id.sample_of(docs, F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.col("doc_id"))
    assert sorted(sample) == sorted((r["lang"], r["text"]) for r in rows if not held(r["doc_id"]) and r["lang"] and r["text"] is not None)
    languages, log = language_id.fit(vocab, sample)
    index, known = {p: i for i, p in enumerate(vocab.pieces)}, {}

    def word(w):
        if w not in known:
            sums = [np.zeros(len(languages))] + [np.full(len(languages), -np.inf) for _ in w]
            for end in range(1, len(w) + 1):
                ways = [sums[a] + log[index[w[a:end]]] for a in range(max(0, end - max(vocab.lengths)), end) if w[a:end] in index]
                sums[end] = np.logaddexp.reduce(ways) if ways else sums[end]
            known[w] = sums[-1]
        return known[w]

    got = {r["doc_id"]: r for r in language_id.op6_language_id(docs, piece_file()).collect()}
    for r in rows:
        out, text = got[r["doc_id"]], r["text"] or ""
        words = re.findall(rb"[a-zA-Z\x80-\xff]+", text.lower().encode())
        if not any(map(str.isalpha, text)):
            assert (out["lang_pred"], out["score"]) == ("und", 0)
            continue
        total = sum((word("▁".encode() + w) for w in words), np.zeros(len(languages)))
        assert out["lang_pred"] == languages[int(total.argmax())] and out["held_out"] == held(r["doc_id"])
        assert out["score"] == pytest.approx(1 / sum(math.exp(x - total.max()) for x in total), abs=1e-9)


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, "same words here")], "doc_id bigint, text string")
    languages, log = language_id.fit(language_id.vocabulary(piece_file()), [("b", "a text"), ("a", "a text")])
    assert [(r["lang_pred"], r["score"]) for r in language_id.predict(docs, piece_file(), languages, log).collect()] == [("a", 0.5)]
