"""Connected components by randomised contraction, over DataFrames.

In each round every node turns into the one of lowest random rank among itself and its neighbours; edges follow, loops
and repeats go, and the maps of the rounds are composed in the end. The ranks are new in each round, so long chains shrink
by a constant share too. All joins are equi joins that AQE can split where one node has very many edges, and none is a
broadcast one, as the driver would gather a table for each; every round ends in a table in the shared scratch folder. The maps
are composed from the last one, each in a query of its own, so that plans stay small however many rounds there are. As soon as at
most LOCAL edges are left, one task makes the remaining rounds.

Defined results: edges with a null end are left out; repeated edges and loops count once, and a loop alone makes its node a
component; a component is named by one of its nodes; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, materialise, scratch, splitmix

#: Edges that one task holds, and rows in a batch that it gives back.
LOCAL, BATCH = 250_000, 10_000


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label, levels) of all edges that are left, by the same rounds."""
    found = [batch for batch in batches if batch.num_rows]
    if not found:
        return
    table = pa.Table.from_batches(found)
    both = pa.chunked_array([*table.column(0).chunks, *table.column(1).chunks])
    names = pc.unique(both)
    names = names.take(pc.sort_indices(names))
    ends = pc.index_in(both, names).to_numpy().astype(np.int64)
    a, b = ends[: len(table)], ends[len(table) :]
    n, label = len(names), np.arange(len(names))
    steps, present = [], np.ones(n, bool)
    while not steps or len(a):
        rank = splitmix(np.arange(n, dtype=np.uint64) + np.uint64(len(steps) * 2**40))
        order, least = np.argsort(rank), rank.copy()
        np.minimum.at(least, a, rank[b])
        np.minimum.at(least, b, rank[a])
        to = order[np.searchsorted(rank[order], least)]
        inside = present[label]
        label = to[label]
        steps.append((inside, label))
        a, b = to[a], to[b]
        a, b = np.divmod(np.unique((a * n + b)[a != b]), n)
        present = np.zeros(n, bool)
        present[a] = present[b] = True
    inside, levels = (np.stack(x, axis=1) for x in zip(*steps))
    for i in range(0, n, BATCH):
        own = inside[i : i + BATCH]
        at = pa.array(np.append(0, np.cumsum(own.sum(axis=1))), pa.int32())
        yield pa.RecordBatch.from_arrays([names.slice(i, len(own)), names.take(pa.array(label[i : i + BATCH])), pa.ListArray.from_arrays(at, names.take(pa.array(levels[i : i + BATCH][own])))], names=["node", "label", "levels"])


def components(edges: DataFrame, results: list[str] | None = None) -> DataFrame:
    """edges(a, b) of any one comparable type, nulls left out. Returns (node, label, levels), one row for each node of an edge;
    levels are the nodes that it turned into by round, until its component is one node: those with the same one hang together, in
    ever larger parts of the component. results: gets the path of the result's table, for a caller that deletes it."""
    spark, paths, maps = edges.sparkSession, [], []

    def kept(df: DataFrame) -> DataFrame:
        paths.append(scratch(spark))
        return materialise(df, paths[-1])

    edges = kept(edges.where("a IS NOT NULL AND b IS NOT NULL").distinct())
    kind, turn = edges.schema["a"].dataType.simpleString(), 0
    while edges.count() > LOCAL:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).union(edges.select("a", F.col("a").alias("b")))
        rank = F.xxhash64("b", F.lit(turn))
        chosen = kept(both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(rank.alias("r"), F.col("b").alias("to")))["to"].alias("to")))
        maps.append(chosen)
        left = chosen.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        right = chosen.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        moved = edges.where("a <> b").join(left.hint("merge"), "a").join(right.hint("merge"), "b")
        edges = kept(moved.select(F.col("a2").alias("a"), F.col("b2").alias("b")).where("a <> b").distinct())
        turn += 1
    out = edges.repartition(1).mapInArrow(_finished, f"node {kind}, label {kind}, levels array<{kind}>")
    out = kept(out) if maps else out
    for i in range(len(maps) - 1, -1, -1):
        later = out.select(F.col("node").alias("to"), "label", "levels")
        out = maps[i].join(later.hint("merge"), "to", "left").select("node", F.coalesce("label", "to").alias("label"), F.concat(F.array("to"), F.coalesce("levels", F.array())).alias("levels"))
        out = kept(out) if i else out
    place = scratch(spark)
    if results is not None:
        results.append(place)
    out = materialise(out, place)
    forget(spark, *paths)
    return out
