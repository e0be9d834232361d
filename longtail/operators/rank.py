"""The k best patterns of each item, and reports on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = "support desc, size(items) asc, items asc"


def top_k(patterns: DataFrame, k: int, repeats: bool = True) -> DataFrame:
    """(item, rank, support, items) from patterns(support, items): each is offered to every item that it holds; repeats, if any, count once."""
    known = patterns.select("support", "items")
    offered = (known.distinct() if repeats else known).select(F.explode("items").alias("item"), "support", "items")
    ranked = offered.withColumn("rank", F.expr(f"cast(row_number() over (partition by item order by {ORDER}) as int)"))
    return ranked.where(F.col("rank") <= k).select("item", "rank", "support", "items")


def merge_top_k(parts: list[DataFrame], k: int) -> DataFrame:
    """The top k over the (item, support, items) results of several passes."""
    every = parts[0].select("item", "support", "items")
    for p in parts[1:]:
        every = every.unionByName(p.select("item", "support", "items"))
    ranked = every.dropDuplicates(["item", "items"]).withColumn("rank", F.expr(f"cast(row_number() over (partition by item order by {ORDER}) as int)"))
    return ranked.where(F.col("rank") <= k).select("item", "rank", "support", "items")


def restrict_k(ranked: DataFrame, item_k: DataFrame, k: int) -> DataFrame:
    """At most item_k(item, k) patterns of the items it names, k of the others; names that do not occur change nothing."""
    limit = item_k.groupBy("item").agg(F.min("k").alias("__k"))
    return ranked.join(limit, "item", "left").where(F.col("rank") <= F.coalesce("__k", F.lit(k))).drop("__k")


def unique_patterns(ranked: DataFrame) -> DataFrame:
    return ranked.select("support", "items").distinct()


def item_stats(ranked: DataFrame) -> DataFrame:
    """(item, support, patterns, sum_support, lowest_support); items without patterns have no row."""
    return ranked.groupBy("item").agg(F.max("support").alias("support"), F.count(F.lit(1)).alias("patterns"), F.sum("support").alias("sum_support"), F.min("support").alias("lowest_support"))
