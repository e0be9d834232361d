"""Closed itemsets and the k best of each item, as Spark plans around the group kernel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bounds import kth_bounds, pair_support
from .encode import decode, dictionary, encode, group_of, hinted
from .kernel import Rows, explore
from .rank import top_k
from .shared import put

#: Groups of starters; raised to the session's shuffle partitions.
GROUPS = 64
#: Items and rows that one task holds; cores of more are split by their next item.
TASK_CELLS = 2_000_000

FOUND = "support bigint, x bigint, y bigint, ranks array<int>"


def _combined(rows: DataFrame, key: str) -> DataFrame:
    """Equal rows of a key as one: their baskets' number and the XOR of two hashes of each. Map tasks combine first."""
    return rows.groupBy(key, "ranks").agg(F.sum("weight").alias("weight"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))


def _cells() -> Column:
    return F.sum(F.size("ranks") + F.lit(1)).alias("cells")


def _read(batches: Iterator[pa.RecordBatch], minsup: int) -> tuple[Rows, list]:
    """The rows of a group, and the value of the key column in one of them."""
    t = pa.Table.from_batches(list(batches)).combine_chunks()
    ranks = t.column("ranks").combine_chunks()
    ranks = ranks if isinstance(ranks, pa.ListArray) else pa.concat_arrays(ranks.chunks)
    sizes = ranks.value_lengths().to_numpy(zero_copy_only=False)
    number = [t.column(c).to_numpy() for c in ("weight", "x", "y")]
    return Rows(ranks.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes), *number, minsup), t.column(0)[0].as_py()


def _batches(found, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list = []
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
    make = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held) if held else ([],) * 4, kinds)], names=["support", "x", "y", "ranks"])
    for support, mark, members in found:
        held.append((support, *mark, members))
        if len(held) == rows:
            yield make()
            held = []
    yield make()


def _sets(encoded: DataFrame, minsup: int, groups: int | None, k: int | None, bounds: DataFrame | None, cells: int) -> DataFrame:
    """(support, ranks) of the closed sets.

    A basket goes to the groups whose starters it holds, cut after the last of these, so an item that a third of all
    baskets hold comes with the few items that are more frequent still. Groups of more than `cells` are dealt by
    starter, starters of more by pairs, and so on: ranks of a core fall, and below rank r there are 2**r rows at most.
    """
    spark = encoded.sparkSession
    groups = groups or max(GROUPS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = spark.sparkContext.broadcast({int(r["rank"]): int(r["bound"]) for r in bounds.collect()} if bounds is not None else None)

    def of_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, g = _read(batches, minsup)
        yield from _batches(explore(rows, [((s,), b) for s, b in sorted(rows.bits.items()) if s % groups == g], minsup, k, sent.value))

    def of_core(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, core = _read(batches, minsup)
        yield from _batches(explore(rows, [(tuple(core), rows.everything)], minsup, k, sent.value))

    one = encoded.select("ranks", F.transform("ranks", lambda r: group_of(r, groups)).alias("of"), F.lit(1).cast("bigint").alias("weight"), F.xxhash64("tid").alias("x"), F.xxhash64("tid", F.lit(1)).alias("y"))
    each = one.select("*", F.posexplode("of").alias("i", "g"))
    last = each.where(~F.array_contains(F.slice("of", F.col("i") + 2, F.size("of")), F.col("g")))
    dealt = put(_combined(last.select("g", F.slice("ranks", F.lit(1), F.col("i") + 1).alias("ranks"), "weight", "x", "y"), "g"))
    wide = [r["g"] for r in dealt.groupBy("g").agg(_cells()).where(F.col("cells") > cells).collect()]
    found = [dealt.where(~F.col("g").isin(wide)).groupBy("g").applyInArrow(of_group, FOUND)]
    if wide:
        each = dealt.where(F.col("g").isin(wide)).select("g", "ranks", "weight", "x", "y", F.posexplode("ranks").alias("i", "r")).where(group_of(F.col("r"), groups) == F.col("g"))
        found += _split(each.select(F.array("r").alias("core"), F.slice("ranks", F.lit(1), F.col("i")).alias("ranks"), "weight", "x", "y"), minsup, cells, of_core)
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.groupBy("support", "x", "y").agg(F.max_by("ranks", F.size("ranks")).alias("ranks")).select("support", "ranks")


def _split(rows: DataFrame, minsup: int, cells: int, of_core) -> list[DataFrame]:
    """Sets of cores; of those that are too large, their own set here and the others from their extensions by one item."""
    found = []
    while True:
        rows = put(_combined(rows, "core"))
        wide = put(rows.groupBy("core").agg(_cells()).where(F.col("cells") > cells).select("core"))
        found.append(rows.join(hinted(wide), "core", "left_anti").groupBy("core").applyInArrow(of_core, FOUND))
        if not wide.limit(1).count():
            return found
        large = rows.join(hinted(wide), "core", "left_semi")
        marks = [F.sum("weight").alias("support"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")]
        whole = large.groupBy("core").agg(*marks)
        each = large.select("core", "ranks", "weight", "x", "y", F.posexplode("ranks").alias("i", "r"))
        items = put(each.groupBy("core", "r").agg(F.sum("weight").alias("s")).where(F.col("s") >= minsup))
        always = items.join(whole.select("core", "support"), "core").where("s = support").groupBy("core").agg(F.collect_list("r").alias("always"))
        own = whole.join(always, "core", "left").select("support", "x", "y", F.array_sort(F.concat("core", F.coalesce("always", F.array().cast("array<int>")))).alias("ranks"))
        found.append(own)
        next_ = each.join(hinted(items.select("core", "r")), ["core", "r"], "left_semi")
        rows = next_.select(F.concat("core", F.array("r")).alias("core"), F.slice("ranks", F.lit(1), F.col("i")).alias("ranks"), "weight", "x", "y")


def closed_itemsets(tx: DataFrame, minsup: int, groups: int | None = None, cells: int = TASK_CELLS) -> DataFrame:
    """(support, items) of every closed itemset in at least minsup baskets."""
    items = put(dictionary(tx, minsup))
    return decode(_sets(encode(tx, items), minsup, groups, None, None, cells), items)


#: Bounds are broadcast for dictionaries of at most this many items; beyond, the kernel uses those that it finds itself.
BOUND_ITEMS = 1_000_000
#: The pairs that give bounds are made only where baskets have at most this many for each of their items, on the whole.
PAIRS_AN_ITEM = 256


def _few_pairs(encoded: DataFrame) -> bool:
    size = F.size("ranks").cast("bigint")
    pairs, items = encoded.agg(F.sum(size * (size - 1) / 2), F.sum(size)).first()
    return (pairs or 0) <= PAIRS_AN_ITEM * (items or 0)


def topk_closed(tx: DataFrame, k: int, minsup: int, groups: int | None = None, prune: bool = True, include_universal_items: bool = True, cells: int = TASK_CELLS) -> DataFrame:
    """(item, rank, support, items): of each item, the k most frequent closed sets that hold it.

    Order: support descending, then fewer items, then items ascending. Without include_universal_items, items of
    every basket have no rows of their own.
    """
    items = put(dictionary(tx, minsup))
    encoded = put(encode(tx, items))
    prune = prune and items.limit(BOUND_ITEMS + 1).count() <= BOUND_ITEMS and _few_pairs(encoded)
    bounds = kth_bounds(items, pair_support(encoded, minsup), k, minsup) if prune else None
    found = decode(_sets(encoded, minsup, groups, k, bounds, cells), items)
    out = top_k(found, k, repeats=False)
    if not include_universal_items:
        n = tx.count()
        out = out.join(items.where(F.col("support") == n).select("item"), "item", "left_anti")
    return out
