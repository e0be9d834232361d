"""Item supports of a stream of baskets, as a running count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def item_support(baskets: DataFrame) -> DataFrame:
    """(item, support) of a streaming DataFrame[tid, items]; write it in complete or update mode."""
    return baskets.select(F.explode(F.array_distinct("items")).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("support"))
