"""Reading baskets into DataFrame[tid bigint, items array]: distinct, sorted, non-empty items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _clean(df: DataFrame) -> DataFrame:
    return df.where(F.size("items") > 0).select("tid", F.array_sort(F.array_distinct("items")).alias("items"))


def read_transactions(spark: SparkSession, path: str, ids: str = "int", invalid: str = "raise") -> DataFrame:
    """One basket a line, items between blanks. ids: "int" or "string"; invalid: "raise" or "drop" tokens that are no integers.

    Blank lines are no baskets. An item that a line repeats counts once.
    """
    if ids not in ("int", "string") or invalid not in ("raise", "drop"):
        raise ValueError("ids is 'int' or 'string', invalid is 'raise' or 'drop'")
    tokens = F.filter(F.split(F.trim("value"), r"\s+"), lambda t: t != "")
    if ids == "int":
        cast = (lambda t: t.cast("bigint")) if invalid == "raise" else (lambda t: t.try_cast("bigint"))
        tokens = F.filter(F.transform(tokens, cast), lambda t: t.isNotNull())
    return _clean(spark.read.text(path).select(F.monotonically_increasing_id().alias("tid"), tokens.alias("items")))


def from_array(df: DataFrame, items: str, tid: str | None = None) -> DataFrame:
    """Baskets from an array column; null items are dropped."""
    key = F.col(tid).cast("bigint") if tid else F.monotonically_increasing_id()
    return _clean(df.where(F.col(items).isNotNull()).select(key.alias("tid"), F.filter(F.col(items), lambda x: x.isNotNull()).alias("items")))


def from_long(df: DataFrame, tid: str, item: str) -> DataFrame:
    """Baskets from (tid, item) rows."""
    pairs = df.select(F.col(tid).cast("bigint").alias("tid"), F.col(item).alias("item")).where("tid is not null and item is not null")
    return _clean(pairs.groupBy("tid").agg(F.collect_set("item").alias("items")))


def read_group(spark: SparkSession, path: str, dictionary: DataFrame, group: int, groups: int) -> DataFrame:
    """The baskets of a file, renamed by dictionary(item, rank), that hold an item of one group; infrequent items are dropped."""
    return _of_group(read_transactions(spark, path), dictionary, group, groups)


def read_group_parquet(spark: SparkSession, path: str, dictionary: DataFrame, group: int, groups: int) -> DataFrame:
    """The same from baskets that text_to_parquet wrote."""
    return _of_group(spark.read.parquet(path), dictionary, group, groups)


def _of_group(tx: DataFrame, dictionary: DataFrame, group: int, groups: int) -> DataFrame:
    from ..operators.encode import encode, in_group

    return encode(tx, dictionary).where(F.exists("ranks", lambda r: in_group(r, group, groups)))


def read_item_k(spark: SparkSession, path: str) -> DataFrame:
    """(item, k) from lines `ITEM_ID NB_PATTERNS_TO_KEEP`."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].cast("bigint").alias("item"), parts[1].cast("int").alias("k"))


def read_contingency(spark: SparkSession, path: str) -> DataFrame:
    """(line, support, support_with) from tab-separated lines whose further columns are kept in `line`."""
    parts = F.split("value", "\t")
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("line"), parts[0].cast("bigint").alias("support"), parts[1].cast("bigint").alias("support_with"))


def text_to_parquet(spark: SparkSession, source: str, target: str, ids: str = "int", overwrite: bool = False) -> None:
    """The baskets of a text file as parquet; an existing target is an error unless overwrite is set."""
    read_transactions(spark, source, ids).write.mode("overwrite" if overwrite else "errorifexists").parquet(target)


def items_text(items: Column | str) -> Column:
    """Items joined by blanks."""
    return F.array_join(F.transform(items, lambda x: x.cast("string")), " ")
