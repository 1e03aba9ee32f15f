import numpy as np
import pyarrow as pa

from atlasq.llm import packs


def test_round_trips():
    rng = np.random.default_rng(1)
    for values in (np.zeros(0, np.uint32), rng.integers(0, 2**32, 1000).astype(np.uint32), rng.normal(size=7)):
        assert np.array_equal(packs.unpack(packs.pack(values), values.dtype.type), values)
    keys = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    assert np.array_equal(packs.unpack_keys(packs.pack_keys(keys)), keys) and len(packs.unpack_keys(packs.pack_keys(keys[:0]))) == 0


def test_keys_are_dealt_by_ranges_and_answers_come_back_in_order():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2))
    batches = list(packs.asked(3, keys, np.arange(len(keys)), None, 7))
    told = {"told_1": []}
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rows, own, unique, at = packs.gathered(table)
        answer = packs.told_table(table["part"][0].as_py(), rows, own, unique[at] >> np.uint64(1))
        told["told_1"] += [{"part": r["part"], "told": r["told"]} for r in answer.to_pylist()]
    assert np.array_equal(packs.answer_of(told, 1, np.uint64), keys >> np.uint64(1))
    assert not list(packs.asked(3, keys[:0], np.arange(0), None, 7)) and len(packs.answer_of({"told_1": None}, 1, np.uint64)) == 0
