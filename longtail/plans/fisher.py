"""Command line: python -m longtail.plans.fisher FILE N ITEM_SUPPORT; the file's contingency lines, the most associated first."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..operators.correlate import score_contingency, scored_lines
from ..sources.transactions import read_contingency


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="longtail.fisher", description="Fisher's exact test, right tail, of `support TAB support_with ...` lines")
    p.add_argument("file")
    p.add_argument("n", type=int, help="baskets in all")
    p.add_argument("item_support", type=int, help="baskets of the item")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("longtail-fisher").getOrCreate()
    for row in scored_lines(score_contingency(read_contingency(spark, a.file), a.n, a.item_support)).toLocalIterator():
        print(row["value"])


if __name__ == "__main__":
    main()
