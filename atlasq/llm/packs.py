"""Rows that pack the keys of many documents, and rounds that look up what the whole corpus knows of them.

A task packs its documents into a few rows (packs), each with its distinct 64-bit keys. In a round every pack asks for its
keys; these go to ranges of the hash space, where what all packs say of a key is combined, and one value for each
key asked returns. A pack asks for a key once, however often it has it, so no range is hot, and a range is a row of compressed
arrays for each pack. The packs themselves lie in a table bucketed by pack, in the shared scratch folder, and don't move; a
round's answers move to them once and lie beside them for all later rounds. There are as many ranges as keep one below a few million keys, whatever the session is set for.

Defined results: packs without keys ask for nothing and get empty answers; without packs there are no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import forget, materialise, scale, scratch

ASKED = "part int, pack bigint, keys binary, a binary, b binary"
TOLD = "part int, pack bigint, told binary, keys binary, stats array<double>"


def pack(values: np.ndarray) -> bytes:
    """Compressed by byte places."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unpack(blob: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences."""
    steps = keys.copy()
    steps[1:] -= keys[:-1]
    return pack(steps)


def unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)


def batch_of(schema: str, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=[x.strip().split(" ")[0] for x in schema.split(", ")])


def asked(number: int, keys: np.ndarray, a: np.ndarray, b: np.ndarray | None, parts: int) -> Iterator[pa.RecordBatch]:
    """Ascending keys of a pack and what it says of them, dealt out by ranges of the hash space."""
    part = (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
    ends = np.searchsorted(part, np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(ends)).tolist():
        s = slice(ends[p], ends[p + 1])
        yield batch_of(ASKED, [pa.array([p], pa.int32()), pa.array([number], pa.int64()), pa.array([pack_keys(keys[s])], pa.binary()), pa.array([pack(a[s])], pa.binary()), pa.array([None if b is None else pack(b[s])], pa.binary())])


def gathered(table: pa.Table) -> tuple[list[dict], list[np.ndarray], np.ndarray, np.ndarray]:
    """What arrived for one range: the rows by pack, their keys, the distinct keys, and which one each is."""
    rows = sorted(table.to_pylist(), key=lambda r: r["pack"])
    keys = [unpack_keys(r["keys"]) for r in rows]
    unique, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_inverse=True)
    return rows, keys, unique, at


def told_table(part: int, rows: list[dict], keys: list[np.ndarray], answer: np.ndarray, stats: list[float] | None = None, unique: np.ndarray | None = None, totals: np.ndarray | None = None) -> pa.Table:
    """The answers to the rows, in their order; and as pack -1 the range's statistics, and its part of the table of all keys."""
    ends = np.cumsum([0, *map(len, keys)])
    out = [{"part": part, "pack": r["pack"], "told": pack(answer[i:j]), "keys": None, "stats": None} for r, i, j in zip(rows, ends, ends[1:])]
    if stats is not None:
        out.append({"part": part, "pack": -1, "told": None if unique is None else pack(totals), "keys": None if unique is None else pack_keys(unique), "stats": stats})
    return pa.Table.from_pylist(out, pa.schema([("part", pa.int32()), ("pack", pa.int64()), ("told", pa.binary()), ("keys", pa.binary()), ("stats", pa.list_(pa.float64()))]))


def answer_of(row: dict, kind: int, dtype: type) -> np.ndarray:
    """The values that round ``kind`` returned to a pack, in the order of its keys."""
    rows = sorted(row[f"told_{kind}"] or [], key=lambda r: r["part"])
    return np.concatenate([unpack(r["told"], dtype) for r in rows]) if rows else np.zeros(0, dtype)


#: Keys that one Python call looks up, on average; so the number of ranges follows the corpus.
RANGE_KEYS = 3_000_000


class Rounds:
    """The packs of one corpus, and its rounds. A context manager: its tables go in the end, after errors too."""

    def __init__(self, spark: SparkSession, packed: DataFrame, tables: str | None = None) -> None:
        """packed has the columns pack and n_keys, the keys that it asks for in its largest round. tables: a folder in which
        the tables of all keys stay."""
        self.spark, self.tables, self.paths = spark, tables, [scratch(spark)]
        self.names = [f"atlasq_packs_{uuid.uuid4().hex}"]
        try:
            packed.write.option("path", self.paths[0]).bucketBy(scale(spark), "pack").sortBy("pack").saveAsTable(self.names[0])
            self.packs = spark.table(self.names[0])
            n_keys = self.packs.agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0]
        except BaseException:
            self.close()
            raise
        self.parts = max(2 * scale(spark), -(-n_keys // RANGE_KEYS))

    def __enter__(self) -> Rounds:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        forget(self.spark, *self.paths)

    def told(self, questions: DataFrame, answer: Callable[[pa.Table], pa.Table], title: str) -> DataFrame:
        """The answers of a round: dealt by pack like the packs themselves, so that they move once."""
        found = questions.groupBy("part").applyInArrow(answer, TOLD)
        if self.tables:
            return materialise(found, f"{self.tables}/{title}")
        self.paths.append(scratch(self.spark))
        self.names.append(f"atlasq_told_{uuid.uuid4().hex}")
        n = scale(self.spark)
        found.repartition(n, "pack").write.option("path", self.paths[-1]).bucketBy(n, "pack").sortBy("pack").saveAsTable(self.names[-1])
        return self.spark.table(self.names[-1])

    def with_answers(self, columns: list[str], told: dict[int, DataFrame], body: Callable[[dict], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
        """body(row) for each pack; the answers of round k are its field told_k."""
        rows = self.packs.select("pack", *columns)
        for k, df in told.items():
            own = df.where("pack >= 0").groupBy("pack").agg(F.collect_list(F.struct("part", "told")).alias(f"told_{k}"))
            rows = rows.join(own, "pack", "left")

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield from body(batch.slice(i, 1).to_pylist()[0])

        return rows.mapInArrow(step, schema)
