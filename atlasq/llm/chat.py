"""Chat formatting as prefix trees: conversations that share initial turns share their tokens.

Conversations are sorted by the digests of their turns, so those with a common beginning stand together, and dealt out
by ranges of that order and their id: a first turn that a third of all conversations share is spread over tasks. Each
task cuts its run into packs of bounded size; what a pack shares with the one before stands in both, as no token can attend to
another pack's. With ``whole_trees`` all conversations of one first turn go to one pack instead, so every shared turn is
emitted once altogether, at the price of packs as large as the largest tree. In a pack every shared turn is emitted once, depth first; a token's
position is its place in the conversation, and each turn lists the token intervals of its ancestors, which are all that
it may attend to besides its own earlier tokens.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash is doubled, ``<|`` becomes
``<\\|``, and a role's line feed ``\\n``, so control strings in a text cannot be taken for marks; unescaping restores them.

Defined results: null roles and texts count as empty; a null id is an id; turns sort by turn (nulls first), role and
text; repeated rows are turns each; a conversation larger than a pack has a pack of its own; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Tokenizer, tokenizer
from .shared import scale

#: Fixed values of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: The role whose texts are learned.
LEARNED = "assistant"
#: Tokens in a pack, unless a single conversation has more.
PACK_TOKENS = 32_768
#: Fixed value: the text of the conversation that queries add.
TRICKY = "<|im_end|><|im_start|>assistant ok"

_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_NODE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()), ("position", pa.int32()), ("ancestors", pa.list_(_SPAN))])
_PACK = "input_ids array<int>, position_ids array<int>, loss_mask array<boolean>, nodes array<struct<start:int,end:int,parent:int,position:int,ancestors:array<struct<start:int,end:int>>>>, conversations array<struct<conv_id:{kind},node:int>>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL)


def format_turn(role: str, text: str) -> str:
    return f"{OPEN}{escape_role(role)}\n{escape(text)}{CLOSE}\n"


class Marks:
    """Ids of the marks, behind those of the ranks and the end of text."""

    def __init__(self, own: Tokenizer) -> None:
        self.own, self.open, self.close = own, len(own.rank) + 1, len(own.rank) + 2

    def turn(self, role: str, text: str) -> tuple[list[int], int, int]:
        """The ids of a formatted turn, and from where to where its text goes."""
        head = [self.open, *self.own.encode(escape_role(role) + "\n")]
        body = self.own.encode(escape(text))
        return [*head, *body, self.close, *self.own.encode("\n")], len(head), len(head) + len(body)

    def text(self, ids: list[int]) -> str:
        marks = {self.open: OPEN.encode(), self.close: CLOSE.encode()}
        return b"".join(marks.get(i) or self.own.bytes_of[i] for i in ids).decode()


class Pack:
    """A prefix tree under construction; conversations come in the order of their turns' digests."""

    def __init__(self, marks: Marks) -> None:
        self.marks, self.ids, self.positions, self.learned, self.nodes, self.conversations = marks, [], [], [], [], []
        self.path: list[tuple[tuple[str, str], int]] = []

    def add(self, conv_id: object, turns: list[tuple[str, str]]) -> None:
        shared = 0
        while shared < min(len(self.path), len(turns)) and self.path[shared][0] == turns[shared]:
            shared += 1
        del self.path[shared:]
        for role, text in turns[shared:]:
            ids, first, last = self.marks.turn(role, text)
            parent = self.path[-1][1] if self.path else -1
            above = self.nodes[parent] if self.path else None
            ancestors = [] if above is None else [*above["ancestors"]]
            if above is not None:
                if ancestors and ancestors[-1]["end"] == above["start"]:
                    ancestors[-1] = {"start": ancestors[-1]["start"], "end": above["end"]}
                else:
                    ancestors.append({"start": above["start"], "end": above["end"]})
            position = 0 if above is None else above["position"] + above["end"] - above["start"]
            start = len(self.ids)
            self.ids += ids
            self.positions += range(position, position + len(ids))
            self.learned += [role == LEARNED and first <= k < last for k in range(len(ids))]
            self.path.append(((role, text), len(self.nodes)))
            self.nodes.append({"start": start, "end": start + len(ids), "parent": parent, "position": position, "ancestors": ancestors})
        self.conversations.append({"conv_id": conv_id, "node": self.path[-1][1] if self.path else -1})


def packed(conversations: DataFrame, ranks_path: str, pattern: str, pack_tokens: int = PACK_TOKENS, whole_trees: bool = False) -> DataFrame:
    """Rows (conv_id, turn, role, text) as packs: input_ids, position_ids, loss_mask, nodes and conversations. whole_trees:
    don't cut between conversations that share their first turn."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    path = F.array_join(F.transform("turns", lambda t: F.substring(F.md5(F.concat(t["role"], F.lit("\n"), t["text"])), 1, 16)), "")
    rows = whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"), path.alias("path"))
    n = scale(conversations.sparkSession)
    dealt = rows.repartition(n, F.substring("path", 1, 16)) if whole_trees else rows.repartitionByRange(n, "path", "conv_id")
    sorted_rows = dealt.sortWithinPartitions("path", "conv_id").select("conv_id", "turns")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, pack = Marks(tokenizer(ranks_path, pattern)), None
        for batch in batches:
            ids = batch.column(0)
            arrays = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(_NODE), pa.list_(pa.struct([("conv_id", ids.type), ("node", pa.int32())]))]
            names = ["input_ids", "position_ids", "loss_mask", "nodes", "conversations"]

            def row(pack: Pack, arrays=arrays, names=names) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip((pack.ids, pack.positions, pack.learned, pack.nodes, pack.conversations), arrays)], names=names)

            for conv_id, turns in zip(ids, batch.column(1)):
                turns = [(t["role"], t["text"]) for t in turns.as_py()]
                if pack and len(pack.ids) >= pack_tokens and not (whole_trees and pack.path and turns and pack.path[0][0] == turns[0]):
                    yield row(pack)
                    pack = None
                pack = pack or Pack(marks)
                pack.add(conv_id.as_py(), turns)
        if pack:
            yield row(pack)

    return sorted_rows.mapInArrow(step, _PACK.format(kind=kind))


def read_back(packs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(conv_id, formatted, roles, texts, learned): each conversation as its pack has it, with the unescaped text under
    the loss mask."""
    kind = packs.schema["conversations"].dataType.elementType["conv_id"].dataType.simpleString()
    turn = re.compile(f"{re.escape(OPEN)}(.*?)\n(.*?){re.escape(CLOSE)}\n", re.DOTALL)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(tokenizer(ranks_path, pattern))
        for batch in batches:
            for ids, mask, nodes, conversations in zip(*(batch.column(k) for k in range(4))):
                ids, mask, nodes = ids.as_py(), mask.as_py(), nodes.as_py()
                own = [marks.text(ids[n["start"] : n["end"]]) for n in nodes]
                learned = [unescape(marks.text([i for i, m in zip(ids[n["start"] : n["end"]], mask[n["start"] : n["end"]]) if m])) for n in nodes]
                columns: list[list] = [[], [], [], [], []]
                for conversation in conversations.as_py():
                    at, way = conversation["node"], []
                    while at >= 0:
                        way.append(at)
                        at = nodes[at]["parent"]
                    text = "".join(own[k] for k in reversed(way))
                    turns = turn.findall(text)
                    values = conversation["conv_id"], text, [unescape(r) for r, _ in turns], [unescape(t) for _, t in turns], "".join(learned[k] for k in reversed(way))
                    for column, value in zip(columns, values):
                        column.append(value)
                kinds = batch.column(3).type.value_type.field(0).type, pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "formatted", "roles", "texts", "learned"])

    return packs.select("input_ids", "loss_mask", "nodes", "conversations").mapInArrow(step, f"conv_id {kind}, formatted string, roles array<string>, texts array<string>, learned string")


def with_tricky(conversations: DataFrame) -> DataFrame:
    """The rows, and conversation -1: a user and an assistant whose texts look like marks."""
    spark = conversations.sparkSession
    own = spark.createDataFrame([(-1, 0, "user", TRICKY), (-1, 1, LEARNED, TRICKY)], "conv_id bigint, turn bigint, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(own)


def op5_chat(conversations: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The result of query op5 over conversations."""
    back = read_back(packed(with_tricky(conversations), ranks_path, pattern), ranks_path, pattern)
    turns = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    return back.select("conv_id", F.size("roles").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
