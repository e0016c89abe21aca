"""Connected components by contraction to neighbours of the smallest hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.stage import discard, settle

#: Edges (of 16 bytes) that one task joins at most.
EDGES = 250_000


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and root (the smallest node of its component) of the nodes of all edges (a, b) of a partition."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    nodes, ends = np.unique(np.concatenate([np.zeros(0, np.int64), *(x for pair in held for x in pair)]), return_inverse=True)
    at, left, right = 0, [], []
    for a, b in held:
        left.append(ends[at : at + len(a)])
        right.append(ends[at + len(a) : at + len(a) + len(b)])
        at += len(a) + len(b)
    # Labels go to the smallest of both ends, and from a node to its label's label, until none changes.
    label = np.arange(len(nodes))
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "root"])


def components(edges: DataFrame, most: int = EDGES, clean: bool = False) -> DataFrame:
    """node, component (the smallest node that links reach), of every node in an edge (a, b) of whole numbers.

    In each round every node moves to the one of itself and its neighbours whose hash is smallest, and edges move with
    their ends.  Hashes have nothing to do with the order of the nodes, so about half of the nodes of a chain are left
    after a round, in whichever order they stand in it; two rounds share their hashes, so that all leaves of a hub follow
    once the hub has moved.  As soon as `most` edges are left at most, one task of that size joins them.  A component
    loses a node a round at least, so rounds end without a limit.  The moves are composed from last to first, and a
    component is named by its smallest node in the end.  Smallest hashes combine before the shuffle, and the joins that
    move edges are plain equality joins, which Spark may split at a hub.  `clean`: the edges are a settled table, without
    nulls, and hardly any is there twice.
    """
    a, b = F.col("a"), F.col("b")
    left = edges if clean else settle(edges.select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b")).filter("a is not null and b is not null and a <> b").distinct())
    tables, moves = [] if clean else [left], []
    while left.count() > most:
        rank = lambda c, salt=len(moves) // 2: F.struct(F.xxhash64(c, F.lit(salt)).alias("h"), c.alias("c"))
        both = left.union(left.select("b", "a"))
        move = settle(both.groupBy("a").agg(F.least(F.min(rank(b)), rank(a))["c"].alias("to")).withColumnRenamed("a", "node"))
        moves.append(move)
        ends = move.select(F.col("node").alias("n"), "to")
        moved = (
            left.join(ends, a == F.col("n")).select(F.col("to").alias("x"), "b")
            .join(ends, b == F.col("n")).select(F.least("x", "to").alias("a"), F.greatest("x", "to").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        left = settle(moved)
        tables.append(left)
    found = left.repartition(1).mapInArrow(joined, "node long, root long")
    if not moves:
        out = settle(found.select("node", F.col("root").alias("component")))
        discard(*tables)
        return out
    for move in reversed(moves):
        later = found.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
        found = move.join(later, F.col("to") == F.col("__n"), "left").select("node", F.coalesce("__r", "to").alias("root"))
    found = settle(found)
    names = found.groupBy(F.col("root").alias("__root")).agg(F.min("node").alias("component"))
    out = settle(found.join(names, F.col("root") == F.col("__root")).select("node", "component"))
    discard(found, *tables, *moves)
    return out
