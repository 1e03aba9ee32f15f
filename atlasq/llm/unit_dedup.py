"""Substring deduplication by hashing lines and the sentences in them.

Units are lines, cut further behind words that end in ``.``, ``!`` or ``?`` and before a capitalised word that follows an
uncapitalised one, so that a passage pasted into the middle of a line is made of units of its own. A unit is normalised to
its words, ASCII letters lowered, joined by single spaces, and hashed. Digests are grouped over the whole corpus; the
occurrence of the lowest rank (document rank, then offset) stays, and every later one of ``least`` words or more goes (1 by
default: all).

With ``passages`` more pieces than units are hashed. Shorter units go as well where they stand in a run of whole units with RUN
words (the shortest from each unit on), or in a whole line of ``least`` words, that is itself a repeat; a text of short units
that are all known, but not in this order, stays. Passages that begin or end inside a unit are found by cuts that depend on the
words alone: before one in CUT pairs of neighbouring words, chosen by their hash. Runs of pieces between cuts with RUN words
(again the shortest from each cut on) go where they are repeats. What may stay of such a passage are the words before its
first cut and behind its last, CUT each on average. The registered query has ``passages`` and SEED as ``least``, so that
everyday lines of up to three words stay.

Digests are grouped by the rounds of ``packs``: a pack asks once for each of its distinct digests, with the lowest rank it
has, so a line in every document is no hot key.

Defined results: null and wordless texts have no units and lose nothing; ranks that are null come last; of equal ranks
(repeated rows) one stays; ids of any type that sorts are ranked by their own order; offsets are code points of the original
text, end exclusive; a unit that is no repeat never goes as a whole; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .packs import ASKED, Rounds, answer_of, asked, batch_of, gathered, pack, told_table, unpack
from .shared import SPACED, Words, materialise, places, slices, splitmix

#: Words in a unit that goes by itself in the query, words in a run, and bytes of text in a pack.
SEED, RUN, PACK_BYTES = 4, 12, 4_000_000

_PACKED = "pack bigint, n_keys bigint, ids array<{kind}>, ranks array<bigint>, texts array<string>, n_units binary, digests binary, starts binary, ends binary, words binary, n_more binary, more_digests binary, more_starts binary, more_ends binary, more_kinds binary"
_RESULT = "id {kind}, n_units bigint, n_removed bigint, removed array<struct<start:int,end:int>>, text string"
#: One in so many pairs of words is a cut.
CUT = 8
#: Kinds of pieces besides units.
OF_UNITS, OF_CUTS, OF_LINES = 1, 2, 3
#: Base of the polynomial that hashes runs of words.
_BASE = 0x9E3779B97F4A7C13


class Runs:
    """Digests of any runs of words of some texts."""

    def __init__(self, words: Words) -> None:
        n = len(words.hash)
        power, self.inverse = (np.append(np.uint64(1), np.cumprod(np.full(n, b, np.uint64))) for b in (_BASE, pow(_BASE, -1, 2**64)))
        self.sums = np.append(np.uint64(0), np.cumsum(words.hash * power[:-1], dtype=np.uint64))

    def digest(self, begin: np.ndarray, end: np.ndarray, kind: int) -> np.ndarray:
        """Of the words from begin to before end, another one for each kind."""
        return splitmix(splitmix((self.sums[end] - self.sums[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64)) + np.uint64(kind))


def shortest(doc: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last piece of the shortest run of pieces from each on that has RUN words in one text, where there is one."""
    last = np.searchsorted(at + size, at + RUN)
    first = np.flatnonzero(last < len(at))
    first = first[doc[last[first]] == doc[first]]
    return first, last[first]


class Units:
    """Units of some texts: the text of each, digest, code point offsets and number of words; and with ``passages`` the other
    pieces (``more``): the text of each, digest, code point offsets and kind."""

    def __init__(self, texts: pa.Array, passages: bool = False) -> None:
        words = Words(texts, SPACED)
        n, data = len(words.start), words.data
        self.n_texts = len(texts)
        if not n:
            self.doc = self.start = self.end = self.words = np.zeros(0, np.int64)
            self.digest = np.zeros(0, np.uint64)
            self.more = [self.doc, self.digest, self.doc, self.doc, self.doc]
            return
        first, last = data[words.start], data[words.end - 1]
        second = data[np.minimum(words.start + 1, len(data) - 1)]
        capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        lines = np.append(0, np.cumsum(data == 10))
        new = np.ones(n, bool)
        new[1:] = (words.doc[1:] != words.doc[:-1]) | (lines[words.start[1:]] > lines[words.end[:-1]]) | np.isin(last[:-1], (33, 46, 63)) | (capital[1:] & ~capital[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, n))
        place = np.arange(n) - np.repeat(at, size)
        self.digest = splitmix(np.add.reduceat(words.hash * places(int(size.max()))[place], at) + size.astype(np.uint64))
        self.doc, self.words = words.doc[at], size
        points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        lengths = np.fromiter((len(t.as_buffer()) if t.is_valid else 0 for t in texts), np.int64, len(texts))
        base = points[(np.cumsum(lengths) - lengths)[self.doc]]
        self.start = points[words.start[at]] - base
        self.end = points[words.end[at + size - 1]] - base
        line = lines[words.start[at]]
        new_line = np.append(True, (self.doc[1:] != self.doc[:-1]) | (line[1:] != line[:-1]))
        pieces = self._pieces(words, at, size, new_line) if passages else []
        begin, end, digest, kind = (np.concatenate(x) for x in zip(*pieces)) if pieces else (at[:0], at[:0], self.digest[:0], at[:0])
        order = np.argsort(words.doc[begin], kind="stable")
        begin, end = begin[order], end[order]
        base = points[(np.cumsum(lengths) - lengths)[words.doc[begin]]]
        self.more = [words.doc[begin], digest[order], points[words.start[begin]] - base, points[words.end[end - 1]] - base, kind[order]]

    def _pieces(self, words: Words, at: np.ndarray, size: np.ndarray, new_line: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """First word, word behind the last, digest and kind of the other pieces."""
        of, out = Runs(words), []

        def add(begin: np.ndarray, end: np.ndarray, kind: int) -> None:
            out.append((begin, end, of.digest(begin, end, kind), np.full(len(begin), kind)))

        first, last = shortest(self.doc, at, size)
        short = np.append(0, np.cumsum(size < SEED))
        some = short[last + 1] > short[first]
        add(at[first[some]], (at + size)[last[some]], OF_UNITS)
        n = len(words.hash)
        cut = np.ones(n, bool)
        cut[1:] = words.doc[1:] != words.doc[:-1]
        cut[:-1] |= splitmix(words.hash[:-1] * np.uint64(3) + words.hash[1:]) % np.uint64(CUT) == 0
        cuts = np.flatnonzero(cut)
        ends = np.append(cuts[1:], n)
        first, last = shortest(words.doc[cuts], cuts, ends - cuts)
        add(cuts[first], ends[last], OF_CUTS)
        first = np.flatnonzero(new_line)
        begin, end = at[first], np.append(at[first[1:]], n)
        some = (np.diff(np.append(first, len(at))) > 1) & (end - begin >= SEED) & (end - begin < RUN)  # longer ones are runs
        add(begin[some], end[some], OF_LINES)
        return out

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_texts)


def _packs(batches: Iterator[pa.RecordBatch], passages: bool, pack_bytes: int) -> Iterator[pa.RecordBatch]:
    """(id, rank, text) as packed rows."""
    number, held, size = (TaskContext.get().partitionId() << 32) - 1, [], 0

    def made() -> pa.RecordBatch:
        nonlocal number
        number += 1
        ids, ranks, texts = (pa.concat_arrays([h[k] for h in held]) for k in range(3))
        units = [h[3] for h in held]
        blobs = [np.concatenate([u.counts() for u in units]).astype(np.uint32), np.concatenate([u.digest for u in units]), *(np.concatenate([getattr(u, k) for u in units]).astype(np.uint32) for k in ("start", "end", "words"))]
        more = [np.concatenate([u.more[k] for u in units]) for k in range(1, 5)]
        blobs += [np.concatenate([np.bincount(u.more[0], minlength=u.n_texts) for u in units]).astype(np.uint32), more[0], *(x.astype(np.uint32) for x in more[1:3]), more[3].astype(np.uint8)]
        ends = pa.array([0, len(ids)], pa.int32())
        held.clear()
        return batch_of(_PACKED, [pa.array([number], pa.int64()), pa.array([len(blobs[1]) + len(more[0])], pa.int64()), *(pa.ListArray.from_arrays(ends, x) for x in (ids, ranks, texts)), *(pa.array([pack(b)], pa.binary()) for b in blobs)])

    for batch in batches:
        for i, texts in slices(batch.column(2)):
            held.append((batch.column(0).slice(i, len(texts)), batch.column(1).slice(i, len(texts)), texts, Units(texts, passages)))
            size += texts.nbytes
            if size >= pack_bytes:
                yield made()
                size = 0
    if held:
        yield made()


def _first_of(digest: np.ndarray, rank: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct digests, the unit of the lowest rank and offset for each, and how often it occurs."""
    order = np.lexsort((start, rank, digest))
    sorted_digest = digest[order]
    new = np.flatnonzero(np.append(True, sorted_digest[1:] != sorted_digest[:-1])) if len(order) else np.zeros(0, np.int64)
    return sorted_digest[new], order[new], np.diff(np.append(new, len(order)))


def _ask(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            digest, start = (np.concatenate([unpack(row[k], kind), unpack(row[f"more_{k}"], kind)]) for k, kind in (("digests", np.uint64), ("starts", np.uint32)))
            rank = np.concatenate([np.repeat(np.array(row["ranks"], np.int64), unpack(row[k], np.uint32)) for k in ("n_units", "n_more")])
            keys, first, times = _first_of(digest, rank, start)
            yield from asked(row["pack"], keys, rank[first], start[first].astype(np.uint64) * np.uint64(2) + (times > 1), parts)


def _owned(table: pa.Table) -> pa.Table:
    """1 if the digest occurs more than once, and 2 more if this pack has its lowest rank."""
    rows, keys, unique, at = gathered(table)
    rank = np.concatenate([unpack(r["a"], np.int64) for r in rows])
    more = np.concatenate([unpack(r["b"], np.uint64) for r in rows])
    order = np.lexsort((np.arange(len(at)), more >> np.uint64(1), rank, at))
    first = order[np.flatnonzero(np.append(True, at[order][1:] != at[order][:-1]))]
    several = (np.bincount(at, minlength=len(unique)) > 1) | (np.bincount(at, (more & np.uint64(1)).astype(np.float64), len(unique)) > 0)
    answer = several[at].astype(np.uint8)
    answer[first] += 2
    return told_table(table.column("part")[0].as_py(), rows, keys, answer)


def joined(gone: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """The spans of units next to each other that go."""
    steps = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
    return list(zip(start[np.flatnonzero(steps > 0)].tolist(), end[np.flatnonzero(steps < 0) - 1].tolist()))


def merged(spans: list[tuple[int, int]], start: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int]]:
    """The union of spans, with the number of units that each one is the first to take words from."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    ends = np.searchsorted(start, [b for _, b in out])
    begins = np.maximum(np.searchsorted(end, [a for a, _ in out], side="right"), np.append(0, ends[:-1]))
    return [(a, b, n) for (a, b), n in zip(out, (ends - begins).tolist())]


def without(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text that stays; a line that becomes empty goes with its line feed."""
    parts, at = [], 0
    for a, b, _ in spans:
        parts.append(text[at:a])
        at = b
        if (not a or text[a - 1] == "\n") and text[at : at + 1] == "\n":
            at += 1
    return "".join([*parts, text[at:]])


def _covered(units: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which units lie in one of the spans. Places grow over all texts."""
    n = len(units[0])
    steps = np.bincount(np.searchsorted(units[0], start), minlength=n + 1) - np.bincount(np.searchsorted(units[1], end, side="right"), minlength=n + 1)
    return np.cumsum(steps)[:n] > 0


def _kept(row: dict, kind: pa.DataType, schema: str, least: int) -> Iterator[pa.RecordBatch]:
    n_units = unpack(row["n_units"], np.uint32).astype(np.int64)
    digest, start, end, words = unpack(row["digests"], np.uint64), *(unpack(row[k], np.uint32) for k in ("starts", "ends", "words"))
    n_more, kinds = unpack(row["n_more"], np.uint32).astype(np.int64), unpack(row["more_kinds"], np.uint8)
    all_digests, all_starts, all_ends = (np.concatenate([x, unpack(row[f"more_{k}"], x.dtype.type)]) for k, x in (("digests", digest), ("starts", start), ("ends", end)))
    number = np.concatenate([np.repeat(np.arange(len(n_units)), n) for n in (n_units, n_more)])
    keys, first, _ = _first_of(all_digests, np.array(row["ranks"], np.int64)[number], all_starts)
    answer = answer_of(row, 1, np.uint8)
    which = np.searchsorted(keys, all_digests)
    repeated = ((answer & 1) > 0)[which]
    repeated[first[answer == 3]] = False
    earliest = first[which]
    repeated &= (answer[which] != 3) | (number[earliest] != number) | (all_ends[earliest] <= all_starts)  # what overlaps the one that stays is none
    repeat, again = repeated[: len(digest)], repeated[len(digest) :]
    place = (number << 32) + all_starts, (number << 32) + all_ends
    units, more = ([x[: len(digest)] for x in place], [x[len(digest) :] for x in place])
    inside = _covered(units, *(x[again & (kinds != OF_CUTS)] for x in more))
    gone = repeat & (inside | (words >= least))
    some_cuts = again & (kinds == OF_CUTS)
    cut_spans = list(zip(all_starts[len(digest) :][some_cuts].tolist(), all_ends[len(digest) :][some_cuts].tolist()))
    more_bounds = np.searchsorted(number[len(digest) :][some_cuts], np.arange(len(n_units) + 1)).tolist()
    removed, texts, counts = [], [], []
    bounds = np.append(0, np.cumsum(n_units)).tolist()
    some = np.append(0, np.cumsum(gone))
    for text, a, b, i, j in zip(row["texts"], bounds, bounds[1:], more_bounds, more_bounds[1:]):
        spans = []
        if some[b] > some[a] or j > i:
            spans = merged(cut_spans[i:j] + joined(gone[a:b], start[a:b], end[a:b]), start[a:b], end[a:b])
        removed.append([{"start": s, "end": e} for s, e, _ in spans])
        counts.append(sum(n for *_, n in spans))
        texts.append(without(text, spans))
    columns = [pa.array(row["ids"], kind), pa.array(n_units), pa.array(counts, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(texts, pa.string())]
    yield batch_of(schema, columns)


def _ranked(docs: DataFrame, id_col: str, rank: Column) -> DataFrame:
    """docs with the column _rank: integers as they are, else the place of the value among all, by a sorted table."""
    spark, kind = docs.sparkSession, docs.select(rank.alias("r")).schema["r"].dataType
    if isinstance(kind, T.IntegralType):
        return docs.withColumn("_rank", F.coalesce(rank.cast("bigint"), F.lit(2**63 - 1)))
    order = materialise(docs.select(rank.alias("_value")).distinct().where("_value IS NOT NULL").orderBy("_value").withColumn("_place", F.monotonically_increasing_id()))
    return docs.withColumn("_value", rank).join(order, "_value", "left").withColumn("_rank", F.coalesce("_place", F.lit(2**63 - 1)))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank: Column | None = None, passages: bool = False, least: int = 1, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """(id, n_units, n_removed, removed, text): what goes from each document as spans of its original text, and what stays.
    rank: which occurrence is the earliest, by default the id. passages: hash more pieces than units. least: words in a unit
    that goes by itself."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _ranked(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col(id_col) if rank is None else rank).alias("r")), "id", F.col("r"))
    schema = "id x, n_units x, n_removed x, removed x, text x"
    with Rounds(docs.sparkSession, rows.select("id", F.col("_rank").alias("rank"), "text").mapInArrow(lambda batches: _packs(batches, passages, pack_bytes), _PACKED.format(kind=kind))) as rounds:
        parts = rounds.parts
        questions = rounds.packs.select("pack", "ranks", "n_units", "digests", "starts", "n_more", "more_digests", "more_starts").mapInArrow(lambda batches: _ask(batches, parts), ASKED)
        told = rounds.told(questions, _owned, "units")
        columns, arrow = [c for c in rounds.packs.columns if c not in ("pack", "n_keys")], to_arrow_type(docs.schema[id_col].dataType)
        return materialise(rounds.with_answers(columns, {1: told}, lambda row: _kept(row, arrow, schema, least), _RESULT.format(kind=kind)))


def op7_unit_dedup(docs: DataFrame, passages: bool = True, least: int = SEED) -> DataFrame:
    """The result of query op7 over documents: removed spans as start:end, comma-joined, and the text that stays."""
    spans = F.array_join(F.transform("removed", lambda r: F.concat(r["start"].cast("string"), F.lit(":"), r["end"].cast("string"))), ",")
    return deduplicated(docs, passages=passages, least=least).select(F.col("id").alias("doc_id"), "n_units", "n_removed", spans.alias("removed"), "text")
