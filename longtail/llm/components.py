"""Connected components of an edge table.

Edges are first reduced to spanning forests in tasks of at most `block` edges. Where one
task holds them all, that is the answer. Beyond, the forests' edges go through alternating
large-star and small-star steps: every step is a groupBy/join with a partial minimum, so a
node with very many edges costs no single task more than its share; each round is written
to the shared folder, which cuts the lineage. Nothing is collected but counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

BLOCK = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, smallest node that this task's edges connect it with)."""
    got = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if not got:
        return
    names, ends = np.unique(np.concatenate(got, axis=1), return_inverse=True)
    parent = list(range(len(names)))
    for a, b in ends.reshape(2, -1).T.tolist():
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[max(a, b)] = min(a, b)
    for i, p in enumerate(parent):
        parent[i] = parent[p]
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[parent])], names=["node", "root"])


def components(edges: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(node, root) for every node of edges(a, b), both bigint; root is the smallest node of its component.

    Self-loops keep a node in the result. Null ends are ignored.
    """
    given = scratch.put(edges.where("a is not null and b is not null").select("a", "b"), "edges")
    tasks = max(1, -(-given.count() // block))
    forest = scratch.put(given.coalesce(tasks).mapInArrow(_forest, "node bigint, root bigint"), "forest")
    scratch.drop(given)
    if tasks == 1:
        return forest
    start = now = scratch.put(forest.select(F.col("node").alias("a"), F.col("root").alias("b")).distinct(), "start")
    while True:
        # large star: neighbours above a node go to the smallest node around it
        both = now.union(now.select("b", "a")).where("a != b")
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.put(large.distinct(), "large")
        # small star: neighbours below a node, and the node, go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(low.select("a", F.col("m").alias("b")))
        new = scratch.put(small.distinct(), "small")
        scratch.drop(large)
        tops = new.select(F.col("a").alias("top")).distinct()
        # done when it is a star: no node is both above and below, and each has one root
        again = new.join(tops, F.col("b") == F.col("top"), "left_semi").limit(1).count() or new.groupBy("a").count().where("count > 1").limit(1).count()
        if not again:
            break
        if now is not start:
            scratch.drop(now)
        now = new
    roots = new.select(F.col("a").alias("node"), F.col("b").alias("root"))
    every = start.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return every.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
