"""Helpers of the training-data operators: shared scratch tables and vectorised tokenising.

Scratch tables go to the folder named by ``spark.checkpoint.dir``, which driver and executors share. Only where
that setting is absent (local tests) is a folder of the local machine used.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer single text is handled alone.
SLICE_BYTES = 2_000_000


_left: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession) -> str:
    """A new path in the shared scratch folder. What nobody deletes before (results that are read lazily) goes when the
    driver's Python ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = tempfile.mkdtemp(prefix="atlasq-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    _left.append((spark, f"{base.rstrip('/')}/atlasq-{uuid.uuid4().hex}"))
    return _left[-1][1]


@atexit.register
def _clear() -> None:
    for spark, path in _left:
        if spark.sparkContext._jsc is not None:
            forget(spark, path)


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the rows to the shared scratch folder and reads them back: lineage ends here, lost executors included."""
    spark = df.sparkSession
    path = path or scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plain_names(docs: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    """docs with its columns renamed in_0, in_1 and so on, so that no added column clashes; and the text's new name."""
    return docs.select([F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(docs.columns)]), f"in_{docs.columns.index(text_col)}"


def own_names(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return rows.select([F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)])


def besides(columns: list[str], added: Iterable[str]) -> list[str]:
    """The columns that no added one replaces; names differ by more than case."""
    taken = {a.lower() for a in added}
    return [c for c in columns if c.lower() not in taken]


def forget(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables that no later step reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    _left[:] = [x for x in _left if x[1] not in paths]
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def crc_bucket(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % F.lit(n)


def scale(spark: SparkSession) -> int:
    """How many shuffle partitions the session is set for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: What gives up the memory that operators keep in this Python process from task to task.
_kept: list[Callable[[], None]] = []


def keeps(forget: Callable[[], None]) -> None:
    """Tells how to give up what an operator remembers here."""
    _kept.append(forget)


def release() -> None:
    """Gives up what other operators remember here: a Python worker is used for one stage after another."""
    for forget_own in _kept:
        forget_own()
    pa.default_memory_pool().release_unused()


#: Seconds after a task that keeps memory at which an idle Python worker gives it up. A worker lives on while later stages run
#: without Python, and its executor has to hold both.
IDLE_S = 10
_idle: list[threading.Timer] = []


def _awake() -> None:
    while _idle:
        _idle.pop().cancel()


def _asleep(seconds: float) -> None:
    _idle.append(threading.Timer(seconds, release))
    _idle[-1].daemon = True
    _idle[-1].start()


def idles(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], seconds: float = IDLE_S) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The step of mapInArrow, of an operator that keeps memory from task to task: if no other such task follows in this
    process within some seconds, all goes."""

    def watched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _awake()
        try:
            yield from step(batches)
        finally:
            _asleep(seconds)

    return watched


def splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_places = np.zeros(0, np.uint64)


def places(n: int) -> np.ndarray:
    """An odd random multiplier for each of the first n byte places of a word."""
    global _places
    if len(_places) < n:
        m = max(256, 1 << int(n - 1).bit_length())
        _places = splitmix(np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _places


class Alphabet:
    """Which bytes belong to words, and what each counts as. Bytes from 0x80 up are parts of non-ASCII characters."""

    def __init__(self, separators: str) -> None:
        """separators: the ASCII part of a character class, say ``\\x20\\x09-\\x0D``."""
        out = re.compile(f"[{separators}]".encode())
        self.inside = np.array([out.match(bytes([b])) is None for b in range(256)])
        self.inside[65:91] = self.inside[97:123]  # the class holds for the lowered text
        self.value = np.arange(256, dtype=np.uint8)
        self.value[65:91] += 32


#: Fixed value: words of the language model, the quality rules and the near-duplicate join.
SPACED = Alphabet(r"\x20\x09-\x0D")
#: Fixed value: words of the contamination rule.
ALNUM = Alphabet(r"\x00-\x2F\x3A-\x60\x7B-\x7F")


class Words:
    """The words of some texts: text number, start and end byte in ``data``, and a 64-bit hash of the lowered bytes."""

    __slots__ = ("data", "doc", "end", "hash", "n", "start")

    def __init__(self, texts: pa.Array, alphabet: Alphabet, hashed: bool = True) -> None:
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1]
        self.n = len(texts)
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and self.n else np.zeros(0, np.uint8)
        offsets = (offsets - offsets[0]).astype(np.int64) if self.n else np.zeros(1, np.int64)
        inside = np.zeros(len(self.data) + 2, bool)
        inside[1:-1] = alphabet.inside[self.data]
        here, before, after = inside[1:-1], inside[:-2].copy(), inside[2:].copy()
        cuts = offsets[1:-1]
        before[cuts[cuts < len(self.data)]] = False
        after[cuts[cuts > 0] - 1] = False
        self.start = np.flatnonzero(here & ~before)
        self.end = np.flatnonzero(here & ~after) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.hash = np.zeros(0, np.uint64)
        if hashed and len(self.start):
            size = self.end - self.start
            first = np.cumsum(size) - size
            at = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
            value = alphabet.value[self.data[here]].astype(np.uint64) + np.uint64(1)
            value *= places(int(size.max()))[at]
            self.hash = splitmix(np.add.reduceat(value, first) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def bounds(self) -> np.ndarray:
        """Word numbers at which each text begins, and the number of words."""
        return np.searchsorted(self.doc, np.arange(self.n + 1))


def slices(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, pa.Array]]:
    """The texts in order, in runs of about SLICE_BYTES, nulls as empty: the first text's number, and the run."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts) else np.zeros(0, np.int64)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE_BYTES, side="right")))
        yield i, texts.slice(i, j - i)
        i = j
