import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from atlasq.llm.components import components
from atlasq.llm.packs import pack, pack_keys, unpack, unpack_keys
from atlasq.llm.shared import ALNUM, SPACED, Words, slices


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aBz 9\n\t.é日\x00-", max_size=20), min_size=1, max_size=6))
def test_words_are_those_of_the_patterns(texts):
    for alphabet, pattern, low in ((SPACED, r"[^\x20\x09-\x0D]+", False), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        words = Words(pa.array(texts), alphabet)
        got = [(int(d), bytes(words.data[a:b]).decode()) for d, a, b in zip(words.doc, words.start, words.end)]
        want = [(i, w) for i, t in enumerate(texts) for w in re.findall(pattern, lowered(t) if low else t)]
        assert [(d, lowered(w)) for d, w in got] == [(d, lowered(w)) for d, w in want]
        by = {}
        for (_, w), h in zip(want, words.hash.tolist()):
            assert by.setdefault(lowered(w), h) == h
        assert len(set(by.values())) == len(by)


def test_slices_cover_all_texts():
    texts = pa.array(["a" * 900_000, None, "b" * 3_000_000, "", "c"])
    parts = list(slices(texts))
    assert [i for i, _ in parts] == list(np.cumsum([0, *(len(p) for _, p in parts)]))[:-1]
    assert [x for _, p in parts for x in p.to_pylist()] == [x or "" for x in texts.to_pylist()]


@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=50))
def test_packed_arrays_come_back(values):
    keys = np.sort(np.array(values, np.uint64))
    assert (unpack_keys(pack_keys(keys)) == keys).all()
    assert (unpack(pack(keys), np.uint64) == keys).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (201, 202), (202, 200), (None, 5)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and len({got[i] for i in (200, 201, 202)}) == 1
    assert len(set(got.values())) == 3
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
