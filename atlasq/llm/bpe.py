"""Byte-level BPE by prefix dynamic programming.

For every prefix of a pre-token's bytes there is exactly one token that can end a valid encoding of that prefix: the
token whose predecessor is in turn the prefix's own last token and with which it forms a stable pair. So one array of
last tokens encodes all prefixes at once; appending bytes extends it, and following it backwards gives the ids.

Two neighbours are stable if no merge ever crosses their border. Token ids are merge times, so the later of the two
tokens is taken apart first, and at each state a mergeable pair that is due earlier than what has been taken apart
would have crossed the border.

Defined results: a null text encodes like an empty one (no ids, null ids never occur); text outside Unicode cannot
occur in a string column; repeated rows are encoded each; an empty table gives an empty table; input columns are kept, but one
that has an output's name is replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import besides, idles, keeps

#: Distinct pre-tokens that a Python worker remembers, and the longest one that it does.
REMEMBERED, LONGEST = 650_000, 64
#: Lengths at which the states of a pre-token's beginning are remembered for others.
STEMS = (7,)
#: Texts whose results are held at once.
PART = 500
#: In place of the halves of a token that no merge makes.
UNREACHABLE = (-1, -1)


class PrefixState:
    """The last token of each prefix of one pre-token."""

    __slots__ = ("data", "last")

    def __init__(self) -> None:
        self.data, self.last = bytearray(), []


class Tokenizer:
    """Ranks in the tiktoken text format, and the pattern that cuts texts into pre-tokens."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        with open(ranks_path, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in rows}
        self.bytes_of = dict(zip(self.rank.values(), self.rank))
        self.pattern = regex.compile(pattern)
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.stems: dict[bytes, tuple[int, ...]] = {}
        self.stable: dict[int, bool] = {}
        ends: dict[bytes, set[int]] = {}
        for token in self.rank:
            ends.setdefault(token[-3:], set()).add(len(token))
        #: By the last three bytes, or two where no longer token ends so: how long the tokens are that do, longest first.
        self.lengths = {k: tuple(sorted({*v, *(n for n in (1, 2) if k[-n:] in self.rank)}, reverse=True)) for k, v in ends.items()}
        self.unreachable = frozenset(t for t in self.bytes_of if self.split(t) == UNREACHABLE)
        self.memory = _Memory(self)

    def forget(self) -> None:
        """Gives up what was remembered of pre-tokens."""
        self.memory.clear()
        self.stems.clear()
        self.stable.clear()

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte; UNREACHABLE if merges never make it."""
        if token not in self.halves:
            data = self.bytes_of[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                due = [self.rank.get(a + b, token) for a, b in zip(parts, parts[1:])]
                first = min(due)
                if first >= token:
                    break
                i = due.index(first)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[token] = None if len(data) == 1 else (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 and all(p in self.rank for p in parts) else UNREACHABLE
        return self.halves[token]

    def is_stable(self, left: int, right: int) -> bool:
        """Whether the pair of neighbours is what encoding their joint bytes gives."""
        if len(self.stable) >= REMEMBERED:
            self.stable.clear()
        known = self.stable[left << 32 | right] = self._survives(left, right)
        return known

    def _survives(self, left: int, right: int) -> bool:
        due_before = len(self.rank) + max(left, right) + 1
        while True:
            crossing = self.rank.get(self.bytes_of[left] + self.bytes_of[right])
            if crossing is not None and crossing < due_before:
                return False
            later_left = left > right
            parts = self.split(left if later_left else right)
            if parts is None:
                return True  # both are single bytes: the later one is
            if later_left:  # of merges due together the leftmost goes first, which is the one on the left
                due_before, left = left, parts[1]
            else:  # and here the crossing one
                due_before, right = right + 1, parts[0]

    def append(self, state: PrefixState, more: bytes) -> PrefixState:
        """Extends a pre-token; earlier prefixes keep their entries."""
        state.data += more
        data, last, token_of, lengths, known = bytes(state.data), state.last, self.rank.get, self.lengths.get, self.stable.get
        for end in range(len(last) + 1, len(data) + 1):
            for size in lengths(data[max(0, end - 3) : end]) or lengths(data[max(0, end - 2) : end], (1,)):
                start = end - size
                if start < 0 or (token := token_of(data[start:end])) is None or token in self.unreachable:
                    continue
                if not start:
                    last.append(token)
                    break
                stable = known(last[start - 1] << 32 | token)
                if self.is_stable(last[start - 1], token) if stable is None else stable:
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends byte {end} of {data[:80]!r}: the ranks lack single bytes")
        return state

    def trace(self, state: PrefixState, size: int | None = None) -> list[int]:
        """The ids of the first ``size`` bytes, or of all."""
        at, ids = len(state.last) if size is None else size, []
        while at:
            ids.append(state.last[at - 1])
            at -= len(self.bytes_of[ids[-1]])
        return ids[::-1]

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token; one that is a token itself stays whole."""
        whole = self.rank.get(piece)
        if whole is not None:
            return (whole,)
        state, at = PrefixState(), 0
        for size in STEMS:  # pre-tokens of the same beginning share its states
            if len(piece) > size:
                stem = piece[:size]
                known = self.stems.get(stem)
                if known is None:
                    self.append(state, stem[at:])
                    if 4 * len(self.stems) >= REMEMBERED:
                        self.stems.clear()
                    self.stems[stem] = tuple(state.last)
                else:
                    state.data, state.last = bytearray(stem), list(known)
                at = size
        return tuple(self.trace(self.append(state, piece[at:])))

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.encoded(text) for i in piece.ids]

    def encoded(self, text: str) -> list[Piece]:
        return list(map(self.memory.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Piece:
    """A pre-token's ids, the same as decimal text, and the bytes that they decode to."""

    __slots__ = ("bytes", "decimal", "ids")

    def __init__(self, tokenizer: Tokenizer, ids: tuple[int, ...]) -> None:
        self.ids, self.decimal, self.bytes = ids, " ".join(map(str, ids)), tokenizer.decode(ids)


class _Memory(dict):
    """Encoded pre-tokens, forgotten all at once when there are too many."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer = tokenizer

    def __missing__(self, text: str) -> Piece:
        piece = Piece(self.tokenizer, self.tokenizer.encode_piece(text.encode()))
        if len(text) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[text] = piece
        return piece


class EditableText:
    """An encoded text that is encoded anew only near its edits."""

    def __init__(self, tokenizer: Tokenizer, text: str = "") -> None:
        self.tokenizer, self.text, self.pieces, self.encoded = tokenizer, "", [], 0
        self.edit(0, 0, text)

    @property
    def ids(self) -> list[int]:
        return [i for _, piece in self.pieces for i in piece.ids]

    def append(self, text: str) -> EditableText:
        return self.edit(len(self.text), len(self.text), text)

    def edit(self, start: int, end: int, new: str) -> EditableText:
        """Replaces characters start to end. Pre-tokens from two before the edit on are cut anew until a border falls on
        an old one behind the edit; what follows stays, as no pattern looks back. ``encoded`` counts the anew encoded."""
        first = 0
        while first < len(self.pieces) and (self.pieces[first + 1][0] if first + 1 < len(self.pieces) else len(self.text)) <= start:
            first += 1
        first = max(0, first - 2)
        at = self.pieces[first][0] if first < len(self.pieces) else 0
        shift = len(new) - (end - start)
        text = self.text[:start] + new + self.text[end:]
        old = {begin + shift: k for k, (begin, _) in enumerate(self.pieces) if begin >= end}
        made, rest = [], []
        for m in self.tokenizer.pattern.finditer(text, at):
            if m.start() >= start + len(new) and m.start() in old:
                rest = [(begin + shift, piece) for begin, piece in self.pieces[old[m.start()] :]]
                break
            made.append((m.start(), self.tokenizer.memory[m[0]]))
        self.text, self.pieces, self.encoded = text, [*self.pieces[:first], *made, *rest], len(made)
        return self


@lru_cache(maxsize=2)
def tokenizer(ranks_path: str, pattern: str) -> Tokenizer:
    """One tokenizer for each Python process."""
    own = Tokenizer(ranks_path, pattern)
    keeps(own.forget)
    return own


#: What encode can append, with its type.
OUTPUTS = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
_ARROW = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def _made(pieces: list[Piece], output: str) -> list[int] | int | str:
    if output == "ids":
        return [i for piece in pieces for i in piece.ids]
    if output == "n_tokens":
        return sum([len(piece.ids) for piece in pieces])
    if output == "ids_sha256":
        return hashlib.sha256(" ".join([piece.decimal for piece in pieces]).encode()).hexdigest()
    return hashlib.sha256(b"".join([piece.bytes for piece in pieces])).hexdigest()


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", outputs: tuple[str, ...] = ("ids",), keep: list[str] | None = None) -> DataFrame:
    """Encodes each whole text and appends the outputs to df, or to its columns ``keep``: the ids, how many there are, the
    SHA-256 of the decimal ids joined by single spaces, or that of the bytes that the ids decode to. One pass, one
    Python worker a task; a worker's memory is bounded by REMEMBERED pre-tokens and by PART texts, and an idle worker forgets the
    pre-tokens."""
    kept = besides(df.columns if keep is None else keep, outputs)
    at, kept_at = df.columns.index(text_col), [df.columns.index(c) for c in kept]
    names = [*kept, *outputs]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(ranks_path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, PART):
                part = batch.slice(i, PART)
                columns: list[list] = [[] for _ in outputs]
                for text in part.column(at):
                    pieces = own.encoded(text.as_py()) if text.is_valid else []
                    for column, output in zip(columns, outputs):
                        column.append(_made(pieces, output))
                made = [pa.array(c, _ARROW[o]) for c, o in zip(columns, outputs)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept_at), *made], names=names)

    return df.mapInArrow(idles(step), T.StructType([*(df.schema.fields[k] for k in kept_at), *(T.StructField(o, OUTPUTS[o]) for o in outputs)]))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Appends the bytes that the ids stand for; null ids stand for none."""
    at = df.columns.index(ids_col)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(ranks_path, pattern)
        for batch in batches:
            made = pa.array((own.decode(x.values.to_numpy().tolist()) if x.is_valid else b"" for x in batch.column(at)), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out_col])

    return df.mapInArrow(step, T.StructType([*df.schema.fields, T.StructField(out_col, T.BinaryType())]))


def op8_bpe(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The result of query op8 over documents."""
    return encode(docs.select("doc_id", "text"), ranks_path, pattern, outputs=("n_tokens", "ids_sha256", "decoded_sha256"), keep=["doc_id"])
