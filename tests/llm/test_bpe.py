import hashlib
import random
import time

import pyarrow as pa
import tiktoken

from atlasq.llm import bpe, near_duplicates
from atlasq.llm.registry import byte_bpe
from atlasq.llm.shared import idles, release

PIECES = ["a", "aa", "aaa", " ", "  ", "\n", "é", "日本", "0", "!!", "the", "ing", "'s", "\x00", "🎉", "zq", "\t"]


def reference():
    own = bpe.tokenizer(*byte_bpe())
    return own, tiktoken.Encoding("own", pat_str=byte_bpe()[1], mergeable_ranks=own.rank, special_tokens={})


def test_encodes_like_the_library_and_back():
    own, lib = reference()
    rng = random.Random(3)
    for _ in range(800):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30)))
        ids = own.encode(text)
        assert ids == lib.encode_ordinary(text) and own.decode(ids) == text.encode()


def test_every_token_is_reached_and_pairs_agree_with_the_library():
    own, lib = reference()
    assert not own.unreachable
    rng = random.Random(5)
    tokens = list(own.bytes_of)
    for _ in range(3000):
        a, b = rng.choice(tokens), rng.choice(tokens[:2000])
        assert own.is_stable(a, b) == (lib._encode_single_piece(own.bytes_of[a] + own.bytes_of[b]) == [a, b])


def test_appends_and_edits_are_exact_and_local():
    own, lib = reference()
    state = bpe.PrefixState()
    for k, byte in enumerate(b" antidisestablishmentarianism"):
        own.append(state, bytes([byte]))
        assert own.trace(state) == lib._encode_single_piece(b" antidisestablishmentarianism"[: k + 1])
    rng = random.Random(9)
    for _ in range(300):
        text = bpe.EditableText(own, "".join(rng.choice(PIECES) for _ in range(30)))
        i = rng.randint(0, len(text.text))
        text.edit(i, rng.randint(i, len(text.text)), rng.choice(PIECES)).append(rng.choice(PIECES))
        assert text.ids == lib.encode_ordinary(text.text)
    long = bpe.EditableText(own, "some words here " * 500)
    long.edit(4000, 4004, "other")
    assert long.encoded < 10 and long.ids == lib.encode_ordinary(long.text)


def test_columns(odd):
    own, lib = reference()
    rows = bpe.encode(odd, *byte_bpe(), outputs=("ids", "n_tokens", "ids_sha256", "decoded_sha256"))
    for r in bpe.decode(rows, *byte_bpe()).collect():
        ids = lib.encode_ordinary(r["text"] or "")
        assert (r["ids"], r["n_tokens"]) == (ids, len(ids)) and bytes(r["decoded"]) == (r["text"] or "").encode()
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
        assert r["lang"] == "own"
    assert bpe.op8_bpe(odd.where("false"), *byte_bpe()).count() == 0


def test_other_stages_get_back_the_memory_of_a_worker(spark):
    """A worker that has encoded texts keeps nothing of them when near duplicates use it."""
    own = bpe.tokenizer(*byte_bpe())
    own.encode(" ".join(f"word{i} longerword{i}thanothers" for i in range(500)))
    assert len(own.memory) > 500 and own.stable
    release()
    assert not own.memory and not own.stems and not own.stable
    assert own.decode(own.encode("again the same")) == b"again the same"

    def encode(batches):
        for batch in batches:
            bpe.tokenizer(*byte_bpe()).encode("a text of some words")
            yield batch

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(bpe.tokenizer(*byte_bpe()).memory)]})

    rows = spark.range(1).coalesce(1)
    rows.mapInArrow(encode, "id bigint").collect()
    before = rows.mapInArrow(held, "n bigint").first()[0]
    docs = spark.createDataFrame([(1, "one text of words")], "id bigint, text string").coalesce(1)
    for _ in range(8):  # every idle worker
        near_duplicates.keyed(docs, with_bands=False).collect()
    assert rows.mapInArrow(held, "n bigint").first()[0] < max(1, before)


def test_an_idle_worker_gives_back_its_memory(spark, monkeypatch):
    """What a worker remembers goes while stages without Python follow, not at once."""

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(bpe.tokenizer(*byte_bpe()).memory)]})

    def most():
        return max(spark.range(1).coalesce(1).mapInArrow(held, "n bigint").collect()[0][0] for _ in range(8))  # in every idle worker

    monkeypatch.setattr(bpe, "idles", lambda step: idles(step, 5.0))
    rows = spark.createDataFrame([("a text of some words",)], "text string").coalesce(1)
    assert [r[0] for _ in range(8) for r in bpe.encode(rows, *byte_bpe(), outputs=("n_tokens",), keep=[]).collect()] == [5] * 8
    assert most() > 0
    time.sleep(7)
    assert most() == 0


def test_a_task_in_time_keeps_the_memory():
    own = bpe.tokenizer(*byte_bpe())

    def step(batches):
        for batch in batches:
            own.encode("a text of some words")
            yield batch

    for _ in range(4):
        assert list(idles(step, 0.6)([1])) == [1]
        time.sleep(0.3)
    assert own.memory
    time.sleep(1.2)
    assert not own.memory and not own.stems and not own.stable
    assert own.decode(own.encode("again the same")) == b"again the same"
