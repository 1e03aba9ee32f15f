"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against all windows of all documents.

The set is broadcast in blocks of at most ``block_chars`` characters of test text; each block is one scan of the
documents, so what is broadcast has a fixed bound whatever the size of the test sets. Window hashes find candidates;
every candidate is verified word by word.

Defined results: null and wordless texts, of documents or items, have no words, windows or hits; a null item id counts
as the empty id; repeated item ids are one item; repeated documents are scored each; an empty table on either side gives no hits; input columns
are kept, but one that has an added column's name is replaced (``without_...`` return the input's columns alone).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import ALNUM, Words, besides, materialise, own_names, plain_names, slices, splitmix

#: Bytes of test text that are broadcast at once; with its windows a block needs about seven times as much memory.
BLOCK_CHARS = 16_000_000
#: Words in a window, and one in how many words must be hit.
WINDOW, SHARE = 13, 20

_RANGE = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_ADDED = [T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(_RANGE)), T.StructField("items", T.ArrayType(T.StringType()))]
_ARROW = [pa.int64(), pa.list_(pa.struct([(x, pa.int32()) for x in ("first", "last", "start", "end")])), pa.list_(pa.string())]


def _windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words."""
    factor = splitmix(np.arange(size, dtype=np.uint64) + np.uint64(1000 + size)) | np.uint64(1)
    out = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size):
        out += hashes[k : k + len(out)] * factor[k]
    return splitmix(out)


def _plain(words: Words, first: int, size: int) -> bytes:
    return b" ".join(words.data[words.start[i] : words.end[i]].tobytes() for i in range(first, first + size)).lower()


class WindowSet:
    """Windows of the test items, by size: sorted hashes, each with its first word and its item. The words are offsets into
    one copy of the items' text, so a window costs 20 bytes and a character one; the items' ids stand once."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        items = sorted(items)
        self.ids = sorted({item for item, _ in items})
        number = {item: k for k, item in enumerate(self.ids)}
        words = Words(pa.array([text for _, text in items], pa.large_string()), ALNUM)
        own = np.array([number[item] for item, _ in items], np.int32)
        self.text, self.start, self.end = words.data.copy(), words.start.astype(np.int32), words.end.astype(np.int32)
        bounds = words.bounds()
        counts = np.diff(bounds)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({min(n, window) for n in counts.tolist() if n}):
            hashes = _windows(words.hash, size)
            whole = words.doc[: len(hashes)] == words.doc[size - 1 :]
            at = np.flatnonzero(whole & ((counts[words.doc[: len(hashes)]] == size) if size < window else True))
            key, of = hashes[at], own[words.doc[at]]
            order = np.argsort(key)
            maybe = np.zeros(1 << 22, bool)
            maybe[(key & np.uint64(len(maybe) - 1)).astype(np.int64)] = True
            self.by_size[size] = key[order], maybe, at[order].astype(np.int32), of[order]

    def _plain(self, first: int, size: int) -> bytes:
        return b" ".join(self.text[self.start[i] : self.end[i]].tobytes() for i in range(first, first + size)).lower()

    def scan(self, words: Words) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """By text: the merged ranges of hit words, and the items that have an occurring window."""
        raw: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
        for size, (keys, maybe, first, of) in self.by_size.items():
            hashes = _windows(words.hash, size)
            at = np.flatnonzero(maybe[(hashes & np.uint64(len(maybe) - 1)).astype(np.int64)])
            at = at[words.doc[at] == words.doc[at + size - 1]]
            low, high = np.searchsorted(keys, hashes[at]), np.searchsorted(keys, hashes[at], side="right")
            known: dict[bytes, set[int]] = {}
            for i, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                text = _plain(words, i, size)
                if text not in known:
                    known[text] = {int(of[k]) for k in range(a, b) if self._plain(int(first[k]), size) == text}
                if known[text]:
                    ranges, found = raw.setdefault(int(words.doc[i]), ([], set()))
                    ranges.append((i, i + size))
                    found |= known[text]
        return {doc: (_merged(ranges), {self.ids[k] for k in found}) for doc, (ranges, found) in raw.items()}


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def find(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with n_words, hits (ranges of hit words with their code point offsets) and items (ids as text, sorted)."""
    spark = docs.sparkSession
    docs = docs.select([F.col(f"`{c}`") for c in besides(docs.columns, [f.name for f in _ADDED])])
    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    chars = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(chars / block_chars))
    at, schema = docs.columns.index(text_col), T.StructType([*docs.schema.fields, *_ADDED])
    out = docs
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        known = spark.sparkContext.broadcast(WindowSet([tuple(r) for r in block.distinct().collect()], window))

        def scan(batches: Iterator[pa.RecordBatch], known=known, first=k == 0) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, texts in slices(batch.column(at)):
                    part = batch.slice(i, len(texts))
                    words = Words(texts, ALNUM)
                    found, bounds = known.value.scan(words), words.bounds()
                    counts, hits, of = np.diff(bounds), [], []
                    for doc in range(len(texts)):
                        ranges, ids = found.get(doc, ([], set()))
                        base = int(bounds[doc])
                        ranges = [(a - base, b - base) for a, b in ranges]
                        if not first:
                            ids = ids | set(part.column(-1)[doc].as_py())
                            ranges = _merged(ranges + [(x["first"], x["last"]) for x in part.column(-2)[doc].as_py()])
                        if ranges:
                            text = texts[doc].as_py().encode()
                            skip = int(words.start[base]) - _first_word(text)
                            before = np.append(0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))
                            points = lambda x, before=before: int(before[x])
                            ranges = [{"first": a, "last": b, "start": points(int(words.start[base + a]) - skip), "end": points(int(words.end[base + b - 1]) - skip)} for a, b in ranges]
                        hits.append(ranges)
                        of.append(sorted(ids))
                    kept = part.columns if first else part.columns[:-3]
                    yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, kind) for x, kind in zip((counts, hits, of), _ARROW))], names=schema.names)

        out = out.mapInArrow(scan, schema)
        if blocks > 1:
            out = materialise(out)
    return out


def _first_word(text: bytes) -> int:
    return int(np.flatnonzero(ALNUM.inside[np.frombuffer(text, np.uint8)])[0])


def verdict(found: DataFrame, share: int = SHARE) -> DataFrame:
    """Appends n_hit, and contaminated: at least one word in ``share`` is hit."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def without_documents(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the contaminated ones, as they were."""
    plain, text = plain_names(docs, text_col)
    return own_names(verdict(find(plain, items, text)).where("NOT contaminated"), docs)


def without_spans(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the hit spans cut out of their texts."""
    plain, text = plain_names(docs, text_col)
    pieces = F.aggregate(
        "hits",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, x: F.struct(F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, x["start"] - s["at"])).alias("out"), x["end"].alias("at")),
        lambda s: F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, F.length(text))),
    )
    return own_names(find(plain, items, text).withColumn(text, F.when(F.col(text).isNotNull(), pieces)), docs)


def op10_decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The result of query op10 over documents and benchmark."""
    out = verdict(find(docs.select("doc_id", "text"), items))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
