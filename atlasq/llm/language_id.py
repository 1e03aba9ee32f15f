"""Language identification by segmentation-marginalised unigrams.

A language gives each piece of a fixed public vocabulary a probability; a word's probability is the sum over all its
segmentations into pieces, by the forward algorithm over its bytes. The vocabulary's single bytes are pieces too, so
every text has a segmentation. Expectation-maximisation with the forward-backward algorithm estimates the pieces'
probabilities from the words of a bounded sample of training texts; scoring covers every word of every text.

Words are runs of ASCII letters and non-ASCII bytes of the lowered text, so digits, marks and markup don't count.

Defined results: a null text and one without a letter is ``und`` with score 0; without training texts all are; ties go
to the language that sorts first; repeated rows are predicted each; an empty table gives an empty table; input columns
are kept, but one named like a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Alphabet, Words, besides, crc_bucket, slices, splitmix

#: Training texts of each language, the ones of the lowest hash: the bound of the sample.
SAMPLE = 250
#: Rounds of expectation-maximisation, and the count added to every piece.
ROUNDS, ADDED = 5, 0.05
#: Words whose probabilities a Python worker remembers, and those computed at once.
REMEMBERED, AT_ONCE = 1_000_000, 50_000
#: In place of a language where a text has no letter.
UNDETERMINED = "und"
#: Fixed value: the mark of a word's begin in the vocabulary.
BEGIN = "▁"

LETTERS = Alphabet(r"\x00-\x60\x7B-\x7F")
LETTERS.inside[65:91] = True

_BASE = 0x9E3779B97F4A7C15 | 1


class Vocabulary:
    """The pieces of a SentencePiece model as byte strings."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found: dict[bytes, None] = {bytes([b]): None for b in range(256)}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                found[model.id_to_piece(i).encode()] = None
        self.pieces = list(found)
        self.lengths = sorted({len(p) for p in self.pieces})
        keys = np.zeros(len(self.pieces), np.uint64)
        for size in self.lengths:
            own = [k for k, p in enumerate(self.pieces) if len(p) == size]
            data = np.frombuffer(b"".join(self.pieces[k] for k in own), np.uint8)
            keys[own] = _Hashes(data).of(np.arange(len(own)) * size, size)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.keys & np.uint64(len(self.maybe) - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and which."""
        at = np.flatnonzero(self.maybe[(hashes & np.uint64(len(self.maybe) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        good = self.keys[place] == hashes[at]
        return at[good], self.order[place[good]]


class _Hashes:
    """Hashes of substrings: sums of bytes times powers of an odd base, shifted back to the substring's begin."""

    def __init__(self, data: np.ndarray) -> None:
        power = np.full(len(data) + 1, _BASE, np.uint64)
        back = np.full(len(data) + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        power[0] = back[0] = 1
        power, self.back = np.cumprod(power), np.cumprod(back)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, size: int) -> np.ndarray:
        return splitmix((self.sums[start + size] - self.sums[start]) * self.back[start] + np.uint64(size))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each Python process."""
    return Vocabulary(path)


class Lattice:
    """All pieces in some words. A word of n bytes has n + 1 places; an edge leads from place to place."""

    def __init__(self, vocab: Vocabulary, words: list[bytes]) -> None:
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        offset = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        left = np.repeat(offset + size, size) - np.arange(len(data))
        hashes, starts, pieces, sizes = _Hashes(data), [], [], []
        for n in vocab.lengths:
            begin = np.flatnonzero(left >= n)
            if not len(begin):
                break
            at, piece = vocab.find(hashes.of(begin, n))
            starts.append(begin[at])
            pieces.append(piece)
            sizes.append(np.full(len(at), n))
        start, self.piece, length = np.concatenate(starts), np.concatenate(pieces), np.concatenate(sizes)
        self.word = word[start]
        self.first, self.last = offset + np.arange(len(words)), offset + np.arange(len(words)) + size
        self.start = start + self.word
        self.end = self.start + length
        self.places, self.words = len(data) + len(words), len(words)

    def _sums(self, into: np.ndarray, out_of: np.ndarray, depth: np.ndarray, begin: np.ndarray, log: np.ndarray) -> np.ndarray:
        """log sums over all ways from ``begin`` to every place, taking the edges by depth."""
        order = np.lexsort((into, depth))
        sums = np.full((self.places, log.shape[1]), -np.inf)
        sums[begin] = 0
        ends = np.cumsum(np.bincount(depth)).tolist()
        for a, b in zip(ends, ends[1:]):
            if a < b:
                edges = order[a:b]
                to = into[edges]
                new = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
                sums[to[new]] = np.logaddexp.reduceat(sums[out_of[edges]] + log[self.piece[edges]], new, axis=0)
        return sums

    def forward(self, log: np.ndarray) -> np.ndarray:
        return self._sums(self.end, self.start, self.end - self.first[self.word], self.first, log)

    def backward(self, log: np.ndarray) -> np.ndarray:
        return self._sums(self.start, self.end, self.last[self.word] - self.start, self.last, log)

    def totals(self, log: np.ndarray) -> np.ndarray:
        """The log probability of each word, a column for each language."""
        return self.forward(log)[self.last]

    def expected(self, log: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each piece is used in words that occur so often, over all segmentations."""
        alpha, beta = self.forward(log), self.backward(log)
        use = np.exp(alpha[self.start] + log[self.piece] + beta[self.end] - alpha[self.last][self.word]) * counts[self.word]
        return np.stack([np.bincount(self.piece, use[:, k], len(log)) for k in range(log.shape[1])], axis=1)


def words_of(texts: pa.Array) -> tuple[Words, np.ndarray, list[bytes], np.ndarray]:
    """Words of lowered texts: their places, their distinct hashes, those words, and which one each is."""
    words = Words(pc.utf8_lower(texts), LETTERS)
    hashes, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
    raw = words.data.tobytes()
    begin = BEGIN.encode()
    return words, hashes, [begin + raw[a:b] for a, b in zip(words.start[first].tolist(), words.end[first].tolist())], which


def fit(vocab: Vocabulary, sample: list[tuple[str, str]], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """The languages of (language, text) rows, and the log probability of each piece in each."""
    languages = sorted({lang for lang, _ in sample})
    log = np.full((len(vocab.pieces), len(languages)), -np.log(len(vocab.pieces)))
    if not languages:
        return languages, log
    words, _, distinct, which = words_of(pa.array([text for _, text in sample], pa.string()))
    if not distinct:
        return languages, log
    lang = np.array([languages.index(x) for x, _ in sample])[words.doc]
    counts = np.zeros((len(distinct), len(languages)))
    np.add.at(counts, (which, lang), 1)
    lattices = [(Lattice(vocab, distinct[i : i + AT_ONCE]), counts[i : i + AT_ONCE]) for i in range(0, len(distinct), AT_ONCE)]
    for _ in range(rounds):
        used = sum(lattice.expected(log, n) for lattice, n in lattices) + ADDED
        log = np.log(used / used.sum(axis=0))
    return languages, log


class Scorer:
    """Log probabilities of words by language, remembered within a worker."""

    def __init__(self, vocab: Vocabulary, log: np.ndarray) -> None:
        self.vocab, self.log = vocab, log
        self.row: dict[int, int] = {}
        self.known = np.zeros((1024, log.shape[1]))

    def of(self, texts: pa.Array) -> np.ndarray:
        """The log probability of each text, a column for each language."""
        words, hashes, distinct, which = words_of(texts)
        keys = hashes.tolist()
        if len(self.row) + len(keys) > REMEMBERED:
            self.row.clear()
        new = [k for k, h in enumerate(keys) if h not in self.row]
        for i in range(0, len(new), AT_ONCE):
            some = new[i : i + AT_ONCE]
            at = len(self.row)
            while at + len(some) > len(self.known):
                self.known = np.concatenate([self.known, np.zeros_like(self.known)])
            self.known[at : at + len(some)] = Lattice(self.vocab, [distinct[k] for k in some]).totals(self.log)
            for j, k in enumerate(some):
                self.row[keys[k]] = at + j
        rows = np.fromiter((self.row[h] for h in keys), np.int64, len(keys))[which]
        out = np.zeros((len(texts), self.log.shape[1]))
        bounds = words.bounds()
        filled = np.flatnonzero(np.diff(bounds))
        if len(filled):
            out[filled] = np.add.reduceat(self.known[rows], bounds[filled], axis=0)
        return out


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(docs: DataFrame, vocab_path: str, languages: list[str], log: np.ndarray, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with lang_pred and score: the likeliest language under equal priors and its
    posterior probability."""
    kept = besides(docs.columns if keep is None else keep, ("lang_pred", "score"))
    at, kept_at = docs.columns.index(text_col), [docs.columns.index(c) for c in kept]
    model = docs.sparkSession.sparkContext.broadcast((languages, log))  # vocabulary times languages

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, log = model.value
        scorer = Scorer(vocabulary(vocab_path), log)
        for batch in batches:
            for i, texts in slices(batch.column(at)):
                part = batch.slice(i, len(texts))
                letters = np.fromiter((_has_letter(t.as_py()) for t in texts), bool, len(texts)) & bool(names)
                pred, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
                if names:
                    total = scorer.of(texts)
                    best = total.argmax(axis=1)
                    share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                    pred[letters], score[letters] = np.array(names, object)[best[letters]], share[letters]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept_at), pa.array(pred.tolist(), pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"])

    shape = ", ".join([*(f"`{docs.columns[k]}` {docs.schema[k].dataType.simpleString()}" for k in kept_at), "lang_pred string", "score double"])
    return docs.mapInArrow(step, shape)


def sample_of(docs: DataFrame, train: Column, key: Column, lang_col: str = "lang", text_col: str = "text", size: int = SAMPLE) -> list[tuple[str, str]]:
    """At most ``size`` whole training texts of each language, those of the lowest hash; of equal texts of one key one counts.
    Only hashes are ranked, at most ``size`` a language from each task; a second scan fetches the texts they name."""
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(key.cast("string"), F.col(text_col)).alias("h"))
    ranked = rows.select("lang", "h").withColumn("n", F.dense_rank().over(W.partitionBy("lang").orderBy("h")))
    lowest = ranked.where(F.col("n") <= size).select("lang", "h").distinct()
    found = rows.join(F.broadcast(lowest), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))  # ``size`` hashes a language are broadcast
    return [(r["lang"], r["text"]) for r in found.orderBy("lang", "h").select("lang", "text").collect()]


def op6_language_id(docs: DataFrame, vocab_path: str) -> DataFrame:
    """The result of query op6 over documents."""
    held_out = crc_bucket(F.col("doc_id"), 4) == 2
    languages, log = fit(vocabulary(vocab_path), sample_of(docs, ~held_out, F.col("doc_id")))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return predict(rows, vocab_path, languages, log, keep=["doc_id", "held_out"])
