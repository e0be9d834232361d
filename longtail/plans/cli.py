"""Command line: python -m longtail.plans.cli -k K [options] INPUT MINSUP [OUTPUT]; a JSON summary of the run goes to stderr."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import correlate, mine, rank
from ..sources import sinks
from ..sources.transactions import read_item_k, read_transactions


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="longtail", description="The k most frequent closed itemsets of each item")
    p.add_argument("input")
    p.add_argument("minsup", type=int, help="baskets that a pattern must be in")
    p.add_argument("output", nargs="?", help="standard output if absent")
    p.add_argument("-k", type=int, required=True, help="patterns for each item")
    p.add_argument("-c", type=int, help="of these, the c most associated with the item")
    p.add_argument("-b", action="store_true", help="benchmark: mine, and drop the patterns")
    p.add_argument("-g", type=int, help="groups of starters (64, or the shuffle partitions if more)")
    p.add_argument("-i", action="store_true", help="a line of statistics for each item")
    p.add_argument("-u", action="store_true", help="each pattern once")
    p.add_argument("-r", help="file of `ITEM K` lines: patterns to keep for these items")
    p.add_argument("-S", action="store_true", help="items are strings")
    p.add_argument("-J", action="store_true", help="items are strings; write JSON lines")
    p.add_argument("-s", action="store_true", help="items sorted; always so here")
    return p


def result(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, str]:
    """The rows that the options ask for, and the form to write them in."""
    tx = read_transactions(spark, a.input, "string" if a.S or a.J else "int")
    if a.c:
        return correlate.top_c(tx, a.c, a.k, a.minsup, groups=a.g), "correlated"
    best = mine.topk_closed(tx, a.k, a.minsup, groups=a.g)
    if a.r:
        limits = read_item_k(spark, a.r)
        best = rank.restrict_k(best, limits.withColumn("item", F.col("item").cast(best.schema["item"].dataType)), a.k)
    if a.i:
        return rank.item_stats(best), "parquet"
    if a.u:
        return rank.unique_patterns(best), "text"
    return best, "json" if a.J else "text"


def summary(rows: DataFrame, a: argparse.Namespace) -> dict:
    """The options of the run, and the lengths of its patterns where the rows have any."""
    lengths = sinks.sizes(rows).first().asDict() if "items" in rows.columns else {}
    return {"input": a.input, "k": a.k, "c": a.c, "minsup": a.minsup, "groups": a.g, **{x: lengths[x] for x in ("total_length", "average_length") if lengths}}


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("longtail").getOrCreate()
    start = time.time()
    rows, form = result(spark, a)
    rows = rows.cache()
    n, mined = rows.count(), time.time()
    if a.b:
        sinks.write(rows, None, "noop")
    elif a.output:
        sinks.write(rows, a.output, form)
    elif form == "parquet":
        rows.show(n, False)
    else:
        lines = {"text": sinks.text_lines, "json": sinks.json_lines, "correlated": sinks.correlated_lines}[form]
        for r in lines(rows).toLocalIterator():
            print(r["value"])
    print(json.dumps(summary(rows, a) | {"patterns": n, "mining_seconds": round(mined - start, 3), "seconds": round(time.time() - start, 3)}), file=sys.stderr)


if __name__ == "__main__":
    main()
