"""Katz back-off language model over words: Good-Turing discounted n-grams up to ORDER words, exactly normalised.

    P(w | h) = d(c(h, w)) c(h, w) / c(h)                     if the n-gram h w was seen in training
             = a(h) P(w | h without its first word)            if h was
             = P(w | h without its first word)                 otherwise, and at last P(w) = d(c(w)) c(w) / N

d is the Good-Turing ratio of the order for counts up to LARGE, 1 above. What the discount of a history's n-grams frees,
divided by the lower order's probability of all words not seen after it, is its back-off weight a(h); what the discount of
unigrams frees is the probability of the unknown word. Where nothing is freed (all counts after h are large), h counts once
more. So every distribution sums to one over the vocabulary and the unknown word. Texts begin behind ORDER - 1 start marks.

The corpus is read once. A task packs several hundred thousand tokens into one row: its distinct words and its texts as numbers
of words. Rounds then look up, for the distinct keys of each such row, what the whole corpus knows: the counts of words, of
pairs, of triples, and then the back-off weights order by order. In each round the keys go to partitions of the hash space,
are summed there, and the totals return, one value for each key asked. However frequent a word or copied a text, a row asks
for it once, so no partition is hot. An n-gram one of whose two parts (all but the last word, all but the first) no other row
has is in no other row either, so its count is known without asking; and only those weights are asked for that a text not
learned from can need, or whose history has a large count. Nothing is cut off, and all that is gathered grows with the corpus;
the driver sees only counts of counts.

Defined results: a null or empty text has the end token alone; a null id counts as the empty text for the split that
the caller makes; repeated rows are trained on and scored each; without training texts all words are the unknown word, of
probability one; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .packs import ASKED, Rounds, answer_of, asked, batch_of, gathered, pack, pack_keys, told_table, unpack, unpack_keys
from .shared import SPACED, Words, crc_bucket, materialise, slices, splitmix

#: Words in the longest n-grams, tokens that are packed together, and the largest count that is discounted.
ORDER, PACK, LARGE = 3, 700_000, 5
#: Stand-ins for the hashes of the begin and the end of a text.
START, END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)

_PACKED = "pack bigint, n_keys bigint, ids array<{kind}>, train array<boolean>, sizes binary, words binary, stream binary"
#: Bits of an answer below the count: this row is the first that taught the key; several rows have it; a text that is not
#: learned from has it as a history.
_OWNED, _SHARED, _WANTED, _BITS = 1, 2, 4, 3


def _packs(batches: Iterator[pa.RecordBatch], pack_tokens: int) -> Iterator[pa.RecordBatch]:
    """(id, text, train) as packed rows."""
    number = (TaskContext.get().partitionId() << 32) - 1
    hashes: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    ids: list[pa.Array] = []
    train: list[np.ndarray] = []

    def made() -> pa.RecordBatch:
        nonlocal number
        number += 1
        words, stream = np.unique(np.concatenate([*hashes, [START]]), return_inverse=True)
        size, teach = np.concatenate(sizes), np.concatenate(train)
        ends = pa.array([0, len(size)], pa.int32())
        blobs = [pack(size.astype(np.uint32)), pack_keys(words), pack(stream[:-1].astype(np.uint32))]
        columns = [pa.array([number], pa.int64()), pa.array([len(stream)], pa.int64()), pa.ListArray.from_arrays(ends, pa.concat_arrays(ids)), pa.ListArray.from_arrays(ends, pa.array(teach)), *(pa.array([b], pa.binary()) for b in blobs)]
        for held in (hashes, sizes, ids, train):
            held.clear()
        return batch_of(_PACKED, columns)

    waiting = 0
    for batch in batches:
        for i, texts in slices(batch.column(1)):
            words = Words(texts, SPACED)
            size = np.diff(words.bounds()) + 1
            hashes.append(np.insert(words.hash, np.cumsum(size - 1), END))
            sizes.append(size)
            ids.append(batch.column(0).slice(i, len(texts)))
            train.append(batch.column(2).slice(i, len(texts)).to_numpy(zero_copy_only=False).astype(bool))
            waiting += int(size.sum())
            if waiting >= pack_tokens:
                yield made()
                waiting = 0
    if sizes:
        yield made()


class Level:
    """The distinct n-grams of one order in a packed row, in the order of their keys."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, start: int) -> None:
        self.keys, self.counts, self.start = keys, counts, start  #: start: the n-gram of start marks alone
        self.hist = self.lower = self.held = np.zeros(0, np.int64)


class Packed:
    """A packed row and its n-grams up to an order."""

    def __init__(self, row: dict, order: int) -> None:
        words, self.w = unpack_keys(row["words"]), unpack(row["stream"], np.uint32).astype(np.int64)
        self.sizes = unpack(row["sizes"], np.uint32).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        taught = np.repeat(np.array(row["train"], bool), self.sizes)
        stream, start = self.w, int(np.searchsorted(words, START))
        self.end = int(np.searchsorted(words, END))
        self.levels = [Level(words, np.bincount(stream[taught], minlength=len(words)), start)]
        for k in range(2, order + 2):
            below = self.levels[-1]
            hist = np.empty_like(stream)
            hist[1:] = stream[:-1]
            hist[self.starts] = below.start
            below.held = np.bincount(hist[~taught], minlength=len(below.keys)) > 0
            if k > order:
                break
            mixed = splitmix(below.keys + np.uint64(k))
            keys, at = np.unique(splitmix(np.append(mixed[hist] + words[self.w], mixed[below.start] + words[start])), return_inverse=True)
            at, top = at[:-1], int(at[-1])
            own = Level(keys, np.bincount(at[taught], minlength=len(keys)), top)
            own.hist, own.lower = (np.full(len(keys), below.start, np.int32) for _ in range(2))
            own.hist[at], own.lower[at] = hist, stream
            del hist, mixed
            stream = at
            self.levels.append(own)
        self.stream = stream


class Known:
    """What the rounds so far told of a packed row's n-grams: totals and marks by order."""

    def __init__(self, packed: Packed, row: dict, order: int, prune: bool) -> None:
        self.packed, self.prune, self.totals, self.marks = packed, prune, [], []
        for k in range(1, order + 1):
            own = packed.levels[k - 1]
            open_ = self.open(k, prune)
            answer = (own.counts.astype(np.uint64) << np.uint64(_BITS)) + np.uint64(_WANTED) * own.held.astype(np.uint64) + (own.counts > 0).astype(np.uint64)
            answer[open_] = answer_of(row, k, np.uint64)
            self.totals.append((answer >> np.uint64(_BITS)).astype(np.float64))
            self.marks.append((answer & np.uint64((1 << _BITS) - 1)).astype(np.uint8))

    def open(self, k: int, prune: bool) -> np.ndarray:
        """Which n-grams of order k other rows may have, too."""
        own = self.packed.levels[k - 1]
        if k == 1 or not prune:
            return np.arange(len(own.keys))
        shared = (self.marks[k - 2] & _SHARED) > 0
        return np.flatnonzero(shared[own.hist] & shared[own.lower])

    def followed(self, k: int) -> np.ndarray:
        """How often n-grams of order k are followed by a token: as often as they occur, and start marks as often as texts end."""
        out = self.totals[k - 1].copy()
        out[self.packed.levels[k - 1].start] = self.totals[0][self.packed.end]
        return out

    def asking(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Histories of order k that other rows have and whose weight some row can need, as far as this row needs it or knows
        n-grams of them that it owns; and which of them it needs: those that its texts not learned from have, and those all of
        whose n-grams here have large counts."""
        followed, marks, above = self.followed(k), self.marks[k - 1], self.packed.levels[k]
        n, seen = len(marks), self.totals[k] > 0
        owned = np.bincount(above.hist[(self.marks[k] & _OWNED) > 0], minlength=n) > 0
        small = np.bincount(above.hist[seen & (self.totals[k] <= LARGE)], minlength=n) > 0
        needed = self.packed.levels[k - 1].held | ((followed > LARGE) & ~small)
        if not self.prune:
            return np.flatnonzero(followed > 0), np.ones(int((followed > 0).sum()), bool)
        at = np.flatnonzero(((marks & _SHARED) > 0) & (followed > 0) & (((marks & _WANTED) > 0) | (followed > LARGE)) & (owned | needed))
        return at, needed[at]


def _stats(totals: np.ndarray) -> np.ndarray:
    """Sum, number, and numbers of small ones of positive totals."""
    seen = totals[totals > 0].astype(np.int64)
    return np.concatenate([[seen.sum(), len(seen)], np.bincount(seen[seen <= LARGE + 1], minlength=LARGE + 2)[1:]]).astype(np.float64)


def _counted(table: pa.Table, whole: bool) -> pa.Table:
    """Totals and marks of the keys asked. Rows without keys bring statistics of n-grams that need no asking."""
    other = [unpack(r["b"], np.float64) for r in table.filter(pc.is_null(table.column("keys"))).to_pylist()]
    rows, keys, unique, at = gathered(table.filter(pc.is_valid(table.column("keys"))))
    part = table.column("part")[0].as_py()
    counts = np.concatenate([np.zeros(0, np.uint32), *(unpack(r["a"], np.uint32) for r in rows)])
    totals = np.bincount(at, counts, len(unique)).astype(np.uint64)
    taught = np.flatnonzero(counts)
    _, first = np.unique(at[taught], return_index=True)
    answer = totals[at] << np.uint64(_BITS)
    answer[taught[first]] += np.uint64(_OWNED)
    answer[np.bincount(at, minlength=len(unique))[at] > 1] += np.uint64(_SHARED)
    held = np.concatenate([np.zeros(0, np.uint8), *(unpack(r["b"], np.uint8) if r["b"] is not None else np.zeros(len(k), np.uint8) for r, k in zip(rows, keys))])
    answer[np.bincount(at, held, len(unique))[at] > 0] += np.uint64(_WANTED)
    seen = totals > 0
    stats = sum(other, _stats(totals)).tolist()
    return told_table(part, rows, keys, answer, stats, unique[seen] if whole else None, totals[seen])


def _weighed(table: pa.Table, whole: bool) -> pa.Table:
    """Freed counts (a; where the answer isn't needed, one more and negative) and lower-order probability (b) of what was seen
    after each history, as its weight; 0 where it isn't needed."""
    rows, keys, unique, at = gathered(table)
    freed, seen = (np.concatenate([unpack(r[c], np.float64) for r in rows]) for c in ("a", "b"))
    needed = freed >= 0
    weight = _weight(np.bincount(at, np.where(needed, freed, -1 - freed), len(unique)), np.bincount(at, seen, len(unique)))
    return told_table(table.column("part")[0].as_py(), rows, keys, np.where(needed, weight[at], 0.0), [], unique if whole else None, weight)


def _weight(freed: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """a / (1 - b); where nothing is freed, the history counts once more than it occurred, and the value is -1 / (1 - b)."""
    return np.where(freed > 0, freed, -1.0) / np.maximum(1 - seen, 1e-300)


class Discounts:
    """Good-Turing ratios of small counts from the counts of counts."""

    def __init__(self, total: float, distinct: float, counts_of_counts: list[float]) -> None:
        self.total, self.distinct, n = total, distinct, counts_of_counts
        self.ratio = np.ones(LARGE + 1)
        common = (LARGE + 1) * n[LARGE] / n[0] if n[0] else 0.0
        for r in range(1, LARGE + 1):
            value = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) if n[r - 1] and common < 1 else 0.0
            self.ratio[r] = value if 0 < value < 1 else (r - 0.5) / r  # where counts of counts are too irregular: absolute discounting
        self.freed = sum((1 - self.ratio[r]) * r * n[r - 1] for r in range(1, LARGE + 1))

    def discounted(self, counts: np.ndarray) -> np.ndarray:
        return counts * np.where(counts <= LARGE, self.ratio[np.minimum(counts, LARGE).astype(np.int64)], 1.0)


class Unigrams:
    """Probabilities of words, and of the unknown one."""

    def __init__(self, discounts: Discounts) -> None:
        self.by = discounts
        total, freed = discounts.total, discounts.freed
        self.over, self.unknown = (1.0, 1.0) if not total else (total, freed / total) if freed else (total + 1, 1 / (total + 1))

    def of(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.by.discounted(counts) / self.over, self.unknown)


class Model:
    """Probabilities of a packed row's n-grams, order by order."""

    def __init__(self, known: Known, by: list[Discounts]) -> None:
        self.known, self.by = known, by
        self.seen = [Unigrams(by[0]).of(known.totals[0])]
        self.weights: list[np.ndarray] = []

    def sums(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of n-grams of order k that this row owns, by history: freed counts, and lower-order probability."""
        own, totals, n = self.known.packed.levels[k - 1], self.known.totals[k - 1], len(self.known.packed.levels[k - 2].keys)
        owned = (self.known.marks[k - 1] & _OWNED) > 0
        freed = np.where(owned, totals - self.by[k - 1].discounted(totals), 0.0)
        return np.bincount(own.hist, freed, n), np.bincount(own.hist, np.where(owned, self.seen[k - 2][own.lower], 0.0), n)

    def add(self, k: int, told: np.ndarray) -> None:
        """Takes the weights told for the histories of order k - 1 that were asked for; others are this row's alone, or have
        small counts and no use."""
        own, totals = self.known.packed.levels[k - 1], self.known.totals[k - 1]
        asked_for, needed = self.known.asking(k - 1)
        weight = _weight(*self.sums(k))
        weight[((self.known.marks[k - 2] & _SHARED) > 0)] = 1.0
        weight[asked_for[needed]] = told[needed]
        over = np.maximum(self.known.followed(k - 1) + (weight < 0), 1)
        self.weights.append(np.where(self.known.followed(k - 1) > 0, np.abs(weight) / over, 1.0))
        self.seen.append(np.where((weight < 0)[own.hist], totals, self.by[k - 1].discounted(totals)) / over[own.hist])

    def logs(self) -> np.ndarray:
        """log10 of the probability of each n-gram of the highest order."""
        with np.errstate(divide="ignore"):
            out = np.log10(self.seen[0])
            for k in range(2, len(self.seen) + 1):
                own = self.known.packed.levels[k - 1]
                out = np.where(self.known.totals[k - 1] > 0, np.log10(np.maximum(self.seen[k - 1], 1e-300)), np.log10(self.weights[k - 2])[own.hist] + out[own.lower])
        return out


def scored(docs: DataFrame, train: str, id_col: str = "doc_id", text_col: str = "text", tables: str | None = None, order: int = ORDER, pack_tokens: int = PACK) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) for each document. train: the boolean column of those
    to learn from. tables: a folder in which the model's partitioned tables stay (part, keys, told): counts-k and weights-k of
    order k; then all n-grams are asked for, so that the tables have all."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(train), F.lit(False)).alias("train"))
    with Rounds(docs.sparkSession, rows.mapInArrow(lambda batches: _packs(batches, pack_tokens), _PACKED.format(kind=kind)), tables) as rounds:
        return _scored(rounds, docs.schema[id_col].dataType, order)


def _scored(rounds: Rounds, id_type: T.DataType, order: int) -> DataFrame:
    kind = to_arrow_type(id_type)
    parts, prune = rounds.parts, rounds.tables is None
    base, counts, weights, by = ["words", "sizes", "train", "stream"], [], [], []

    def discounts(told: DataFrame) -> Discounts:
        got = told.where("pack = -1").agg(*(F.coalesce(F.sum(F.col("stats")[i]), F.lit(0.0)) for i in range(LARGE + 3))).first()
        return Discounts(got[0], got[1], list(got[2:]))

    def questions(row: dict, known: Known, k: int) -> Iterator[pa.RecordBatch]:
        own, ask = known.packed.levels[k - 1], known.open(k, prune)
        yield from asked(row["pack"], own.keys[ask], own.counts[ask].astype(np.uint32), own.held[ask].astype(np.uint8) if k < order else None, parts)
        rest = np.ones(len(own.keys), bool)
        rest[ask] = False
        place = int(splitmix(np.array([row["pack"]], np.uint64))[0] % np.uint64(parts))
        yield batch_of(ASKED, [pa.array([place], pa.int32()), pa.array([row["pack"]], pa.int64()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([pack(_stats(own.counts[rest]))], pa.binary())])

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from questions(row, Known(Packed(row, 1), row, 0, prune), 1)

    def ask_counts(k: int):
        return lambda row: questions(row, Known(Packed(row, k), row, k - 1, prune), k)

    def model_of(row: dict, k: int, last: int) -> Model:
        """Of order k, with the weights up to the last order."""
        model = Model(Known(Packed(row, k), row, k, prune), by)
        for j in range(2, last + 1):
            model.add(j, answer_of(row, order + j, np.float64))
        return model

    def ask_weights(k: int):
        def ask(row: dict) -> Iterator[pa.RecordBatch]:
            model = model_of(row, k, k - 1)
            keys, (which, needed) = model.known.packed.levels[k - 2].keys, model.known.asking(k - 1)
            freed, seen = (x[which] for x in model.sums(k))
            yield from asked(row["pack"], keys[which], np.where(needed, freed, -1 - freed), seen, parts)

        return ask

    def score(row: dict) -> Iterator[pa.RecordBatch]:
        model = model_of(row, order, order)
        packed, words = model.known.packed, model.known.totals[0]
        base = np.log10((words + 0.1) / (by[0].total + 0.1 * (by[0].distinct + 1)))
        sums = [np.add.reduceat(x, packed.starts) for x in ((words > 0)[packed.w].astype(np.int64), base[packed.w], model.logs()[packed.stream])]
        columns = [pa.array(row["ids"], kind), pa.array(row["train"], pa.bool_()), pa.array(packed.sizes), pa.array(sums[0]), pa.array(np.full(len(packed.sizes), int(by[0].total))), pa.array(sums[1]), pa.array(sums[2])]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def told_so_far() -> dict[int, DataFrame]:
        return dict(enumerate(counts, 1)) | {order + j: df for j, df in enumerate(weights, 2)}

    whole = not prune
    counts.append(rounds.told(rounds.packs.select("pack", *base).mapInArrow(ask_words, ASKED), lambda t: _counted(t, whole), "counts-1"))
    for k in range(2, order + 1):
        counts.append(rounds.told(rounds.with_answers(base, told_so_far(), ask_counts(k), ASKED), lambda t: _counted(t, whole), f"counts-{k}"))
    by += [discounts(df) for df in counts]
    for k in range(2, order + 1):
        answers = {j: df for j, df in told_so_far().items() if j <= k or j > order}
        weights.append(rounds.told(rounds.with_answers(base, answers, ask_weights(k), ASKED), lambda t: _weighed(t, whole), f"weights-{k}"))
    result = f"id {id_type.simpleString()}, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return materialise(rounds.with_answers(["ids", *base], told_so_far(), score, result))


def op1_katz(docs: DataFrame) -> DataFrame:
    """The result of query op1 over documents."""
    rows = docs.select("doc_id", "text", (crc_bucket(F.col("doc_id"), 10) != 0).alias("train"))
    return scored(rows, "train").select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
