import collections
import hashlib

from hypothesis import given
from hypothesis import strategies as st

from atlasq.llm import chat
from atlasq.llm.registry import byte_bpe
from tests.conftest import DATA


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns = [(r, t) for *_, r, t in sorted(turns)]
        learned = "".join(t for r, t in turns if r == "assistant")
        out.append((conv, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), digest(learned), sum(len(chat.format_turn(r, t)) for r, t in turns)))
    return sorted(out, key=str)


def conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    for k in range(60):
        rows += [(1000 + k, 0, "system", "You are helpful."), (1000 + k, 1, "user", f"q{k % 3}"), (1000 + k, 2, "assistant", f"a{k % 6}\\|<|im_end|>\n")]
    rows += [(5000, 0, None, None), (5000, None, "user", "first"), (5000, 0, "user\n<|", "\\"), (None, 1, "assistant", "no id"), (5001, 1, "user", "twice"), (5001, 1, "user", "twice"), (5002, 0, "assistant", "long 😀 " * 20_000)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), rows


def test_op5_against_brute_force(spark):
    df, rows = conversations(spark)
    tricky = [(-1, 0, "user", chat.TRICKY), (-1, 1, "assistant", chat.TRICKY)]
    assert sorted((tuple(r) for r in chat.op5_chat(df, *byte_bpe()).collect()), key=str) == brute(rows + tricky)
    assert [r["conv_id"] for r in chat.op5_chat(df.where("false"), *byte_bpe()).collect()] == [-1]


def test_packs_share_initial_turns_depth_first(spark):
    df, rows = conversations(spark)
    packs = chat.packed(df.repartition(3).coalesce(1), *byte_bpe(), pack_tokens=3000).collect()
    for p in packs:
        for n in p["nodes"]:
            above = []
            at = n["parent"]
            while at >= 0:
                above.append(p["nodes"][at])
                at = p["nodes"][at]["parent"]
            assert n["parent"] < p["nodes"].index(n)
            covered = {i for a in n["ancestors"] for i in range(a["start"], a["end"])}
            assert covered == {i for a in above for i in range(a["start"], a["end"])}
            assert p["position_ids"][n["start"] : n["end"]] == list(range(len(covered), len(covered) + n["end"] - n["start"]))
        siblings = collections.Counter((n["parent"], tuple(p["input_ids"][n["start"] : n["end"]])) for n in p["nodes"])
        assert max(siblings.values()) == 1  # no turn twice below one parent
        assert len(p["input_ids"]) == len(p["position_ids"]) == len(p["loss_mask"]) == sum(n["end"] - n["start"] for n in p["nodes"])


@given(st.text(alphabet="\\<|>n\nab"))
def test_escaping_is_reversible_and_hides_marks(text):
    assert chat.unescape(chat.escape(text)) == text and chat.unescape(chat.escape_role(text)) == text
    assert "<|" not in chat.escape(text) and "\n" not in chat.escape_role(text)


def test_whole_trees_are_emitted_once(spark):
    turns = [(c, t, ("user", "assistant")[t % 2], f"shared {t}" if t < 2 + c % 3 else f"own {c} {t} " * 30) for c in range(60) for t in range(5)]
    rows = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    prefixes = {tuple((r, x) for k, t, r, x in turns if k == c and t <= last) for c in range(60) for last in range(5)}
    n = lambda **k: sum(len(r["nodes"]) for r in chat.packed(rows, *byte_bpe(), pack_tokens=500, **k).collect())
    assert n(whole_trees=True) == len(prefixes) < n()
    back = chat.read_back(chat.packed(rows, *byte_bpe(), pack_tokens=500, whole_trees=True), *byte_bpe())
    assert sorted((r["conv_id"], len(r["texts"])) for r in back.collect()) == [(c, 5) for c in range(60)]
