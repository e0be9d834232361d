"""Item supports, the frequency dictionary and encoding by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dictionaries of at most this many items are broadcast; larger ones join by shuffle.
BROADCAST_ITEMS = 2_000_000


def item_support(tx: DataFrame, minsup: int = 1, weight: str | None = None) -> DataFrame:
    """(item, support) of the items in at least minsup baskets, or of that weight."""
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    cols = [F.explode("items").alias("item"), *([F.col(weight)] if weight else [])]
    return tx.select(*cols).groupBy("item").agg(amount.cast("bigint").alias("support")).where(F.col("support") >= minsup)


def dictionary(tx: DataFrame, minsup: int) -> DataFrame:
    """(item, support, rank): ranks from 0 by support, most frequent first, then by item.

    The rank is the number of items before: those of larger support from a running sum over the distinct
    supports, which are few, and those of equal support from a window within it. No window holds all items.
    """
    supports = item_support(tx, minsup)
    sizes = supports.groupBy("support").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.selectExpr("support", "sum(n) over (order by support desc) - n as before")
    within = F.expr("row_number() over (partition by support order by item)")
    return supports.withColumn("within", within).join(before, "support").select("item", "support", (F.col("before") + F.col("within") - 1).cast("int").alias("rank"))


def over_filter(items: DataFrame, minsup: int) -> DataFrame:
    """The dictionary at a higher minimum support; ranks stay as they were, since infrequent items have the last ones."""
    return items.where(F.col("support") >= minsup)


def hinted(df: DataFrame, rows: int = BROADCAST_ITEMS) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def encode(tx: DataFrame, items: DataFrame) -> DataFrame:
    """(tid, ranks): baskets as sorted ranks; items that the dictionary lacks are dropped, and baskets without others."""
    pairs = tx.select("tid", F.explode("items").alias("item")).join(hinted(items.select("item", "rank")), "item")
    return pairs.groupBy("tid").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))


def decode(patterns: DataFrame, items: DataFrame, column: str = "ranks") -> DataFrame:
    """patterns with `items` in place of its rank column, sorted by item."""
    rest = [c for c in patterns.columns if c != column]
    numbered = patterns.withColumn("__id", F.monotonically_increasing_id())
    names = numbered.select("*", F.explode(column).alias("rank__")).join(hinted(items.select(F.col("item").alias("item__"), F.col("rank").alias("rank__"))), "rank__")
    return names.groupBy("__id", *rest).agg(F.array_sort(F.collect_list("item__")).alias("items")).drop("__id")


def group_of(rank: Column, groups: int) -> Column:
    return F.pmod(rank, F.lit(groups))


def in_group(rank: Column, group: int, groups: int) -> Column:
    return group_of(rank, groups) == group


def group_members(items: DataFrame, group: int, groups: int, inside: bool = True) -> DataFrame:
    """The dictionary's items that are, or are not, in a group; any number of groups from 1 on."""
    member = in_group(F.col("rank"), group, groups)
    return items.where(member if inside else ~member)


def n_transactions(tx: DataFrame) -> int:
    return tx.count()
