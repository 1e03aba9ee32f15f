"""N-gram Jaccard self join with Bayesian candidate pruning.

1. Every text becomes its set of 64-bit shingle hashes; texts of equal sets are one node (exact copies end here).
2. MinHash bands propose: nodes that share a band's bucket are tied to the bucket's lowest node, and the components of
   these ties bound where similar pairs can be.
3. A component is dealt into blocks of nodes that hang together: the parts that the search for components found in its
   rounds, as far as they have at most BLOCK nodes; the parts of the first larger one are dealt to blocks by hash. A task
   gets two blocks, but only those that some bucket has nodes of both. There the pairs that share a bucket compare their MinHash values a few at a time
   and are dropped as soon as the posterior probability (uniform prior) of reaching the threshold falls below the
   tolerance; what is left is verified exactly on the shingle sets.
4. A task returns, for each node, how many documents it links to and a spanning root, never pairs; the components of
   those are the classes.

With BANDS bands of ROWS values a pair of similarity 0.8 shares no bucket with probability 5e-6. Pairs of one per cent
similarity share one with probability 4e-11, so components stay local in very large corpora.

Defined results: a text of one to four words has one shingle of all its words; a text without words (or null) links to
nothing and is a class of its own; repeated rows and repeated ids are documents each; a class is named by its lowest id
(null only if all are null); an empty table gives an empty table; only the id and text columns are read, so others don't
clash, and filtering returns the input's columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import SPACED, Words, forget, materialise, own_names, plain_names, release, scratch, slices, splitmix

#: Words in a shingle, and the least similarity of a link.
SHINGLE, THRESHOLD = 5, Fraction(4, 5)
#: MinHash bands, values in a band, values compared at a step, and the posterior probability below which a pair goes.
BANDS, ROWS, STEP, TOLERANCE = 40, 6, 24, 1e-6
#: Nodes in a block.
BLOCK = 128

_FACTORS = splitmix(np.arange(7, 7 + BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of the texts, one text after another in ascending order, and where each text begins."""
    words = Words(texts, SPACED)
    bounds = words.bounds()
    counts = np.diff(bounds)
    factors = splitmix(np.arange(size, dtype=np.uint64) + np.uint64(31)) | np.uint64(1)
    total = len(words.hash)
    full = np.zeros(max(0, total - size + 1), np.uint64)
    for k in range(size):
        full += words.hash[k : k + len(full)] * factors[k]
    full = splitmix(full)
    at = np.flatnonzero(words.doc[: len(full)] == words.doc[size - 1 :]) if len(full) else np.zeros(0, np.int64)
    docs, values = [words.doc[at]], [full[at]]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            value = np.full(len(short), n, np.uint64)
            for k in range(n):
                value += words.hash[bounds[short] + k] * factors[k]
            docs.append(short)
            values.append(splitmix(value))
    doc, value = np.concatenate(docs), np.concatenate(values)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(len(texts) + 1))


def signatures(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash values, a row for each text with shingles."""
    filled = np.flatnonzero(np.diff(starts))
    out = np.zeros((len(starts) - 1, len(_FACTORS)), np.uint32)
    if len(filled):
        for k, factor in enumerate(_FACTORS):
            out[filled, k] = np.minimum.reduceat(((values * factor) >> np.uint64(32)).astype(np.uint32), starts[filled])
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """The bucket of each band, a row for each text."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    factors = splitmix(np.arange(50, 50 + ROWS, dtype=np.uint64)) | np.uint64(1)
    return splitmix((parts * factors).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest equal values among n at which the posterior probability of reaching the threshold is the tolerance:
    with a uniform prior it is the probability that n + 1 throws of the threshold give at most as many."""
    below = 0.0
    for m in range(n + 1):
        below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n


def _keys(values: np.ndarray, starts: np.ndarray) -> list[bytes | None]:
    return [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]


def keyed(docs: DataFrame, with_bands: bool) -> DataFrame:
    """docs(id, text) as (id, key, text_hash, bands): key is the digest of the shingle set."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for i, texts in slices(batch.column(1)):
                values, starts = shingle_sets(texts)
                columns = [batch.column(0).slice(i, len(texts)), pa.array(_keys(values, starts), pa.binary()), batch.column(2).slice(i, len(texts))]
                if with_bands:
                    bands = band_keys(signatures(values, starts)).astype(np.int64)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.ravel())))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "text_hash", "bands"][: len(columns)])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(step, f"id {kind}, key binary, text_hash bigint" + ", bands array<bigint>" * with_bands)


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, key, block, copies): the sets and MinHash values of those whose text has that key."""
    release()
    for batch in batches:
        for i, texts in slices(batch.column(0)):
            part = batch.slice(i, len(texts))
            values, starts = shingle_sets(texts)
            right = [k for k, (found, key) in enumerate(zip(_keys(values, starts), part.column(1).to_pylist())) if found == key]
            signature = signatures(values, starts)
            sets = pa.array([values[starts[k] : starts[k + 1]].tobytes() for k in right], pa.binary())
            own = part.take(pa.array(right, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns[1:], sets, pa.array([signature[k].tobytes() for k in right], pa.binary())], names=["key", "block", "copies", "shingles", "signature"])


def _verified(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs a, b reach the threshold, exactly. Many pairs are counted by products of 0/1 matrices over the
    shingles that several sets have, a few thousand shingles at a time."""
    sizes = np.array([len(s) for s in sets], np.int64)
    n = len(sets)
    if len(a) > 8 * n:
        shingles, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(n), sizes)
        shared = np.bincount(column, minlength=len(shingles)) > 1
        number = np.cumsum(shared) - 1
        keep = shared[column]
        row, column = row[keep], number[column[keep]]
        both = np.zeros((n, n), np.float32)
        for first in range(0, int(shared.sum()), 4096):
            here = (column >= first) & (column < first + 4096)
            m = np.zeros((n, min(4096, int(shared.sum()) - first)), np.float32)
            m[row[here], column[here] - first] = 1
            both += m @ m.T
        common = both[a, b].astype(np.int64)
    else:
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist())], np.int64)
    return common * THRESHOLD.denominator >= THRESHOLD.numerator * (sizes[a] + sizes[b] - common)


def candidate_pairs(signature: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that share a bucket and survive the incremental comparison; own marks the first block where there are two."""
    n = len(signature)
    keys = band_keys(signature)
    near = np.zeros((n, n), bool)
    for band in range(BANDS):
        near |= keys[:, band][:, None] == keys[:, band][None, :]
    near &= np.triu(np.ones((n, n), bool), 1) if own.all() else own[:, None] & ~own[None, :]
    a, b = np.nonzero(near)
    matches = np.zeros(len(a), np.int64)
    for at in range(0, signature.shape[1], STEP):
        stop = min(at + STEP, signature.shape[1])
        matches += (signature[a, at:stop] == signature[b, at:stop]).sum(axis=1)
        alive = matches >= least_matches(stop, float(THRESHOLD), TOLERANCE)
        a, b, matches = a[alive], b[alive], matches[alive]
    return a, b


def _linked(table: pa.Table) -> pa.Table:
    """One pair of blocks: (key, root, links) for the nodes that have links here."""
    keys = np.array(table.column("key").to_pylist(), dtype=object)
    order = np.argsort(keys)
    table, keys = table.take(pa.array(order)), keys[order]
    own = np.ones(len(keys), bool) if table.column("low")[0].as_py() == table.column("high")[0].as_py() else (table.column("block").to_numpy() == table.column("low").to_numpy())
    signature = np.stack([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("signature")])
    a, b = candidate_pairs(signature, own)
    if len(a):
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        good = _verified(sets, a, b)
        a, b = a[good], b[good]
    copies = table.column("copies").to_numpy()
    n = len(keys)
    links = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    has = np.flatnonzero(links)
    return pa.table({"key": pa.array(keys[has].tolist(), pa.binary()), "root": pa.array(keys[root[has]].tolist(), pa.binary()), "links": pa.array(links[has].astype(np.int64))})


def blocks(near: DataFrame) -> DataFrame:
    """(key, block) of nodes with their components and the levels below: at most about BLOCK nodes in a block."""
    each = near.select("node", F.posexplode("levels").alias("pos", "part"))
    large = each.groupBy("pos", "part").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    first = each.join(large, ["pos", "part"]).groupBy("node").agg(F.min(F.struct("pos", "part", "n")).alias("p"))
    inner = F.when(F.col("p.pos") > 0, F.get("levels", F.col("p.pos") - 1)).otherwise(F.col("node"))
    dealt = F.xxhash64("p.part", "p.pos", F.pmod(F.xxhash64(inner), F.ceil(F.col("p.n") / F.lit(BLOCK))))
    return near.join(first, "node", "left").select(F.col("node").alias("key"), F.when(F.col("p").isNull(), F.xxhash64("label")).otherwise(dealt).alias("block"))


def block_pairs(shared: DataFrame, placed: DataFrame) -> DataFrame:
    """(low, high), once each: blocks that have nodes of one bucket, and each block with itself. What a bucket gives are the
    pairs of its blocks, not of its nodes."""
    of = shared.select("key", "bucket").join(placed, "key").select("bucket", "block").distinct()
    several = of.groupBy("bucket").agg(F.sort_array(F.collect_list("block")).alias("blocks")).where(F.size("blocks") > 1).select("blocks").distinct()
    each = several.withColumn("low", F.explode("blocks")).withColumn("high", F.explode(F.filter("blocks", lambda b: b > F.col("low"))))
    return each.select("low", "high").union(placed.select(F.col("block").alias("low"), F.col("block").alias("high"))).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, class_id, n_links), one row for each document: its class's lowest id, and to how many documents it links."""
    spark, paths = docs.sparkSession, []

    def kept(df: DataFrame) -> DataFrame:
        paths.append(scratch(spark))
        return materialise(df, paths[-1])

    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    all_docs = kept(keyed(docs, with_bands=True))
    one = F.min(F.struct("id", "text_hash"))
    nodes = kept(all_docs.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("bands").alias("bands"), one.alias("one")))
    banded = nodes.select("key", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("key").alias("hub"), F.count("*").alias("n")).where("n > 1").select("bucket", "hub")
    shared = kept(banded.join(buckets, "bucket"))
    near = components(shared.select(F.col("key").alias("a"), F.col("hub").alias("b")), paths)
    placed = kept(blocks(near))
    twice = kept(block_pairs(shared, placed))
    wanted = kept(placed.select("key", "block").join(nodes.select("key", "one", "copies"), "key"))
    found = (docs["id"].eqNullSafe(wanted["one"]["id"])) & (F.xxhash64(docs["text"]) == wanted["one"]["text_hash"])
    texts = docs.join(wanted.hint("shuffle_hash"), found).select("text", "key", "block", "copies").dropDuplicates(["key"])
    sets = texts.mapInArrow(_with_sets, "key binary, block bigint, copies bigint, shingles binary, signature binary")
    dealt = sets.join(twice.select(F.col("low").alias("block"), "low", "high").union(twice.where("low <> high").select("high", "low", "high")), "block")
    linked = kept(dealt.groupBy("low", "high").applyInArrow(_linked, "key binary, root binary, links bigint"))
    label = components(linked.select(F.col("key").alias("a"), F.col("root").alias("b")), paths)
    counts = linked.groupBy("key").agg(F.sum("links").alias("links"))
    of = nodes.select("key", "id", "copies").join(label.select(F.col("node").alias("key"), "label"), "key", "left").join(counts, "key", "left")
    of = kept(of.select("key", "id", F.coalesce("label", "key").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    names = of.groupBy("label").agg(F.min("id").alias("class_id"))
    of = of.join(names, "label").select("key", "class_id", "n_links")
    out = all_docs.select("id", "key").join(of, "key", "left")
    out = materialise(out.select("id", "key", F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))
    forget(spark, *paths)
    return out


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document of the lowest id in each class, and those without words, with the columns of docs."""
    found = classes(docs, id_col, text_col).where(F.col("id").eqNullSafe(F.col("class_id")))
    staying = found.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"))
    plain, text = plain_names(docs, text_col)
    key = f"in_{docs.columns.index(id_col)}"
    once = staying.where("n = 1").select("id")
    out = plain.join(once.hint("shuffle_hash"), plain[key].eqNullSafe(once["id"]), "left_semi")
    if not staying.where("n > 1").isEmpty():
        again = _repeated_ids(plain, found, key, text)
        out = out.union(again)
    return own_names(out, docs)


def _repeated_ids(plain: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """Of ids that several staying rows have: one row for each node, and every one without words."""
    ids = found.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    rows = plain.join(ids, plain[key].eqNullSafe(ids["id"]), "left_semi")
    shape, at = rows.schema, rows.columns.index(text)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, texts in slices(batch.column(at)):
                part = batch.slice(i, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_keys(*shingle_sets(texts)), pa.binary())], names=[*part.schema.names, "own_key"])

    marked = rows.mapInArrow(step, T.StructType([*shape.fields, T.StructField("own_key", T.BinaryType())]))
    good = found.where("key IS NOT NULL").select(F.col("id").alias("good_id"), F.col("key").alias("own_key")).distinct()
    whole = marked.where("own_key IS NOT NULL").join(good, "own_key").where(F.col(key).eqNullSafe(F.col("good_id"))).dropDuplicates(["own_key"])
    return whole.select(*plain.columns).union(marked.where("own_key IS NULL").select(*plain.columns))


def op3_near_duplicates(docs: DataFrame) -> DataFrame:
    """The result of query op3 over documents."""
    return classes(docs).select(F.col("id").alias("doc_id"), "class_id", "n_links")
