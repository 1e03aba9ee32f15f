import collections
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from atlasq.llm import unit_dedup
from tests.conftest import DATA


def units(text):
    out, prev = [], None
    capital = lambda c: "A" <= c <= "Z" or "À" <= c <= "Þ"
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text or ""):
        if prev is None or "\n" in text[prev.end() : m.start()] or text[prev.end() - 1] in ".!?" or (capital(m[0][0]) and not capital(prev[0][0])):
            out.append([])
        out[-1].append(m)
        prev = m
    return [(" ".join(re.sub("[A-Z]", lambda x: x[0].lower(), m[0]) for m in u), u[0].start(), u[-1].end(), len(u)) for u in out]


def brute(rows, least):
    first, times = {}, collections.Counter()
    split = {d: units(t) for d, t in rows}
    for d, own in split.items():
        for g, a, *_ in own:
            times[g] += 1
            first[g] = min(first.get(g, (d, a)), (d, a))
    out = {}
    for d, t in rows:
        spans, last = [], None
        for k, (g, a, b, n) in enumerate(split[d]):
            if times[g] > 1 and first[g] != (d, a) and n >= least:
                if last == k - 1:
                    spans[-1] = (spans[-1][0], b, spans[-1][2] + 1)
                else:
                    spans.append((a, b, 1))
                last = k
        out[d] = len(split[d]), sum(n for *_, n in spans), [(a, b) for a, b, _ in spans], unit_dedup.without(t or "", spans)
    return out


PASSAGE = "Here begins a passage that many texts share. It has a few sentences of some length, as they do. And it ends with this one here."


def corpus(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows += [(10_000 + i, f"own words {i} before {PASSAGE} and after {i} too\nline {i}") for i in range(30)]
    return rows + [(20_000, None), (20_001, ""), (20_002, "é " * 9000), (20_003, "Short line.\nShort line.")]


def whole_units(texts):
    return {g for t in texts for g, *_ in units(t)}


@pytest.mark.parametrize(("size", "least"), [(10**9, 1), (100_000, 4)])
def test_units_against_brute_force(spark, size, least):
    rows = corpus(spark)
    out = unit_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), least=least, pack_bytes=size).collect()
    got = {r["id"]: (r["n_units"], r["n_removed"], [tuple(x) for x in r["removed"]], r["text"]) for r in out}
    assert got == brute(rows, least)
    kept = {d: [u for u in units(t) if not any(a <= u[1] < b for a, b in got[d][2])] for d, t in rows}
    assert {g for own in kept.values() for g, *_ in own} == whole_units(t for _, t in rows)  # no unit is lost
    assert max(collections.Counter(g for own in kept.values() for g, _, _, n in own if n >= least).values()) == 1  # and none stays twice
    assert got[20_003][3] == ("Short line.\n" if least == 1 else "Short line.\nShort line.")


def test_query_leaves_no_unit_twice_and_loses_passages_only(spark):
    rows = corpus(spark)
    got = {r["doc_id"]: r["removed"] for r in unit_dedup.op7_unit_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    gone = {d: [tuple(map(int, s.split(":"))) for s in x.split(",") if s] for d, x in got.items()}
    whole = collections.Counter(u[0] for d, t in rows for u in units(t) if u[3] >= 4 and not any(a <= u[1] and u[2] <= b for a, b in gone[d]))
    assert max(whole.values()) == 1
    assert all(not gone[10_000 + i] for i in range(1)) and all(gone[10_000 + i] for i in range(1, 30))


def test_ids_of_any_type_are_ranked_by_their_order(spark):
    line = "The same line of several words"
    for ids, kind in ((["b", "a", "c", None], "string"), ([2.5, 1.5, 3.5, None], "double")):
        docs = spark.createDataFrame([(i, f"{line}\nown {i}") for i in ids], f"doc_id {kind}, text string").repartition(4)
        assert [r["id"] for r in unit_dedup.deduplicated(docs).collect() if r["n_removed"] == 0] == [ids[1]]


def test_tables_go_after_an_error(spark, monkeypatch):
    before = len(spark.catalog.listTables())
    monkeypatch.setattr(unit_dedup, "_owned", lambda table: 1 / 0)
    with pytest.raises(Exception, match="division"):
        unit_dedup.deduplicated(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"))
    assert len(spark.catalog.listTables()) == before


def test_repeated_ids_and_odd_tables(spark, odd):
    out = unit_dedup.op7_unit_dedup(odd)
    assert out.count() == odd.count()
    same = [r["text"] for r in out.where("doc_id IS NULL").collect()]
    assert sorted(map(len, same))[0] == 0 and len(same[0]) + len(same[1]) > 0  # one of the repeated rows stays
    assert unit_dedup.op7_unit_dedup(odd.where("false")).count() == 0


def whole(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    return [r["text"] for r in unit_dedup.op7_unit_dedup(rows).orderBy("doc_id").collect()]


def test_repeats_of_short_units_go(spark):
    shouted = " ".join(f"WORD{k}!!" for k in range(60))
    mixed = " ".join(f"WORD{k * 7 % 60}!!" for k in range(60))
    lines = "\n".join(f"Line {k}." for k in range(40))
    got = whole(spark, [shouted, lines, f"Some more.\n{shouted}\n{lines}", mixed])
    assert got[:2] == [shouted, lines] and got[2].strip() == "Some more."
    assert got[3] == mixed  # known words in another order are no repeat


def test_passages_inside_units_go(spark):
    passage = " ".join(f"token{k}" for k in range(70))
    tall = [f"one{i} begins so {passage} and goes{i} on{i} here" for i in range(4)]
    got = whole(spark, tall)
    assert got[0] == tall[0]
    for i, text in enumerate(got[1:], 1):
        assert f"one{i}" in text and f"goes{i} on{i} here" in text and sum(w in text.split() for w in passage.split()) <= 35
    periodic = "again and " * 30
    assert whole(spark, [periodic])[0].split()[:12] == periodic.split()[:12]


def test_whole_repeated_lines_go(spark):
    got = whole(spark, [f"{k} own.\nA line of five words.\nNo {k}.\nTwo. In One short line.\nSo short.\nUnlike{k} and a line of five" for k in range(3)])
    assert got[0].count("\n") == 5
    assert got[1:] == [f"{k} own.\nNo {k}.\nSo short.\nUnlike{k} and a line of five" for k in (1, 2)]


def test_units_between_repeats_stay(spark):
    before, after = "One sentence that many texts have got.", "Another sentence that many texts have got."
    got = whole(spark, [f"{before} Yes {k}. {after}" for k in range(3)])
    assert [x.split() for x in got[1:]] == [["Yes", "1."], ["Yes", "2."]]


def test_rows_of_packs_are_small(monkeypatch):
    """A row goes through several buffers of an executor at once."""
    monkeypatch.setattr(unit_dedup, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    words = np.char.mod("w%d", np.random.default_rng(1).integers(0, 10**6, 300))
    texts = pa.array([" ".join(np.roll(words, i)) + "." for i in range(8000)])
    ids = pa.array(range(len(texts)), pa.int64())
    rows = list(unit_dedup._packs(iter([pa.RecordBatch.from_arrays([ids, ids, texts], names=["id", "rank", "text"])]), True, unit_dedup.PACK_BYTES))
    assert sum(len(r.column("ids")[0]) for r in rows) == len(texts)
    assert max(r.nbytes for r in rows) < 6_000_000
