"""Writing patterns: text lines, JSON lines, parquet, nothing, and correlated patterns as tab-separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .transactions import items_text


def text_lines(patterns: DataFrame) -> DataFrame:
    """`support \\t item item ...` of each pattern, without its key item."""
    return patterns.select(F.concat_ws("\t", F.col("support").cast("string"), items_text("items")).alias("value"))


def json_lines(patterns: DataFrame) -> DataFrame:
    """One JSON object an item: {"item": [{"sup": n, "set": [...]}, ...]} in rank order."""
    entry = F.struct(F.col("support").alias("sup"), F.transform("items", lambda x: x.cast("string")).alias("set"))
    ranked = patterns.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))).alias("all"))
    return ranked.select(F.to_json(F.create_map(F.col("item").cast("string"), F.transform("all", lambda x: x["e"]))).alias("value"))


def correlated_lines(patterns: DataFrame) -> DataFrame:
    """`support \\t support_with \\t a \\t r \\t items` of each correlated pattern."""
    return patterns.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in ("support", "support_with", "a", "r")), items_text("items")).alias("value"))


def write(patterns: DataFrame, path: str | None, form: str = "parquet") -> None:
    """form: text, json, correlated, parquet or noop; an existing target is replaced."""
    lines = {"text": text_lines, "json": json_lines, "correlated": correlated_lines}
    if form == "noop":
        patterns.write.format("noop").mode("overwrite").save()
    elif form in lines:
        lines[form](patterns).write.mode("overwrite").text(path)
    elif form == "parquet":
        patterns.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"no such form: {form}")


def sizes(patterns: DataFrame) -> DataFrame:
    """(patterns, total_length, average_length): how many, their items together, and the whole part of the mean."""
    return patterns.agg(F.count(F.lit(1)).alias("patterns"), F.coalesce(F.sum(F.size("items")), F.lit(0)).cast("bigint").alias("total_length"), F.coalesce(F.floor(F.avg(F.size("items"))), F.lit(0)).cast("bigint").alias("average_length"))
