"""Lower bounds on each item's k-th best closed support, from the supports of items and pairs.

Sets of different supports have different closures, so the k-th largest distinct value among an item's
support and those of its pairs is reached by k different closed sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_support(encoded: DataFrame, minsup: int = 1) -> DataFrame:
    """(a, b, support) for ranks a < b that meet in at least minsup baskets; encoded(ranks) with an optional weight."""
    weight = F.col("weight") if "weight" in encoded.columns else F.lit(1).cast("bigint")
    one = encoded.select("ranks", weight.alias("w")).select("ranks", "w", F.posexplode("ranks").alias("i", "a"))
    two = one.select("a", "w", F.explode(F.slice("ranks", F.col("i") + 2, F.greatest(F.size("ranks") - F.col("i") - 1, F.lit(0)))).alias("b"))
    return two.groupBy("a", "b").agg(F.sum("w").alias("support")).where(F.col("support") >= minsup)


def kth_bounds(items: DataFrame, pairs: DataFrame, k: int, minsup: int) -> DataFrame:
    """(rank, bound): no closed set below `bound` is among the item's k best."""
    seen = items.select("rank", "support").union(pairs.select(F.col("a"), "support")).union(pairs.select(F.col("b"), "support")).distinct()
    kth = seen.withColumn("nth", F.expr("row_number() over (partition by rank order by support desc)")).where(F.col("nth") == k)
    return items.select("rank").join(kth.select("rank", F.col("support").alias("bound")), "rank", "left").select("rank", F.greatest(F.coalesce("bound", F.lit(minsup)), F.lit(minsup)).cast("bigint").alias("bound"))


def kth_support(ranked: DataFrame, k: int) -> DataFrame:
    """(item, bound) of the items whose top-k list is full: the support of its last pattern."""
    return ranked.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("support").alias("bound")).where(F.col("n") == k).select("item", "bound")


def starter_eps(pairs: DataFrame, bounds: DataFrame) -> DataFrame:
    """(rank, eps): the least bound among an item and the more frequent items that it meets."""
    reach = pairs.select(F.col("b").alias("rank"), F.col("a").alias("other")).union(bounds.select("rank", F.col("rank").alias("other")))
    return reach.join(bounds.withColumnRenamed("rank", "other"), "other").groupBy("rank").agg(F.min("bound").alias("eps"))
