"""Patterns by their association with an item: Fisher's exact test, right tail."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import udf
from .encode import dictionary, hinted, item_support
from .mine import topk_closed

#: Scores are kept as exp(RANGE * a + ln p) with a whole a, so that tiny tails can still be compared.
RANGE = 1000
#: Terms of a tail that are summed at once.
TERMS = 4096


def pattern_supports(patterns: DataFrame, tx: DataFrame) -> DataFrame:
    """patterns(items) distinct, with the support of each in the baskets.

    A pattern is looked for only in the baskets that hold its rarest item; an empty one has support 0.
    """
    named = patterns.select(F.col("items").alias("pattern")).distinct().withColumn("__id", F.xxhash64(F.to_json(F.struct("pattern"))))
    each = named.select("__id", F.explode("pattern").alias("item")).join(hinted(item_support(tx)), "item")
    rarest = each.groupBy("__id").agg(F.min(F.struct("support", "item"))["item"].alias("item"))
    wanted = named.join(rarest, "__id")
    held = tx.select("items", F.explode("items").alias("item")).join(hinted(wanted), "item").where(F.size(F.array_except("pattern", "items")) == 0)
    found = held.groupBy("__id").agg(F.count(F.lit(1)).alias("full_support"))
    return named.join(found, "__id", "left").select(F.col("pattern").alias("items"), F.coalesce("full_support", F.lit(0)).alias("full_support"))


def contingency(support_with: Column, support: Column, item_support: Column, n: Column) -> list[Column]:
    """The table of a pattern X and an item i: a = s(X and i), b = s(X) - a, c = s(i) - a, d = the rest."""
    return [support_with.alias("ca"), (support - support_with).alias("cb"), (item_support - support_with).alias("cc"), (n - item_support - support + support_with).alias("cd")]


def _tail(a: int, b: int, c: int, d: int) -> tuple[int, float, float]:
    """(whole factor, scaled right tail, ln of the tail) of a 2 x 2 table."""
    r, s, m = a + b, c + d, a + c
    n = r + s
    lf = math.lgamma
    fixed = lf(r + 1) + lf(s + 1) + lf(m + 1) + lf(n - m + 1) - lf(n + 1)
    ln = lambda x: fixed - lf(x + 1) - lf(r - x + 1) - lf(m - x + 1) - lf(s - m + x + 1)
    top = min(m, r)
    log_p, x = -math.inf, a
    while x <= top:
        last = min(top, x + TERMS - 1)
        if x == a and last == top:
            terms = np.array([ln(y) for y in range(x, last + 1)])
        else:
            y = np.arange(x, last, dtype=np.float64)
            terms = ln(x) + np.concatenate([[0.0], np.cumsum(np.log((r - y) * (m - y)) - np.log((y + 1) * (s - m + y + 1)))])
        peak = terms.max()
        log_p = float(np.logaddexp(log_p, peak + np.log(np.exp(terms - peak).sum())))
        # each further term is a smaller share of its predecessor: once a geometric series of them adds nothing, stop
        share = (r - last) * (m - last) / ((last + 1) * (s - m + last + 1))
        if 0 < share < 1 and terms[-1] + math.log(share / (1 - share)) < log_p - 40:
            break
        x = last + 1
    factor = 0 if n == 0 or a < r * m // n else round(-ln(a) / RANGE)
    return factor, float(np.exp(np.minimum(RANGE * factor + log_p, 700.0))), min(log_p, 0.0)


def fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    """struct<a, r, log_p>: larger a first, then smaller r, orders tables from the most to the least associated."""

    @F.pandas_udf("a bigint, r double, log_p double")
    def score(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        known: dict[tuple, tuple] = {}
        rows = []
        for t in zip(a, b, c, d):
            if t not in known:
                known[t] = _tail(*map(int, t))
            rows.append(known[t])
        return pd.DataFrame(rows, columns=["a", "r", "log_p"])

    return score(a, b, c, d)


def log_combination(n: Column, k: Column) -> Column:
    """ln of n over k."""
    lf = udf("log_factorial")
    return lf(n.cast("double")) - lf(k.cast("double")) - lf((n - k).cast("double"))


def hypergeometric(support_with: Column, support: Column, item_support: Column, n: Column, factor: Column | None = None) -> Column:
    """exp(RANGE * factor) times the chance that exactly support_with of a pattern's `support` baskets hold the item; without a factor that chance."""
    point = log_combination(item_support, support_with) + log_combination(n - item_support, support - support_with) - log_combination(n, support)
    return F.exp(point if factor is None else RANGE * factor + point)


def least_log_p(support: Column, item_support: Column, n: Column) -> Column:
    """ln of the smallest tail that a pattern of this support can reach with the item: all baskets of the rarer one hold the other.

    A pattern whose least tail is above an item's c-th best one can't be among the c, whatever its support with the item.
    """
    few, many = F.least(support, item_support), F.greatest(support, item_support)
    return log_combination(many, few) - log_combination(n, few)


def scored_lines(scored: DataFrame) -> DataFrame:
    """`a^^r \\t line` of scored contingency lines."""
    return scored.select(F.concat(F.col("a").cast("string"), F.lit("^^"), F.col("r").cast("string"), F.lit("\t"), F.col("line")).alias("value"))


def score_contingency(lines: DataFrame, n: int, item_support: int) -> DataFrame:
    """lines(support, support_with) with a, r and log_p of their tables against an item, best first."""
    table = contingency(F.col("support_with"), F.col("support"), F.lit(item_support), F.lit(n))
    scored = lines.select("*", fisher(*table).alias("__f")).select("*", "__f.a", "__f.r", "__f.log_p").drop("__f")
    return scored.orderBy(F.desc("a"), F.asc("r"))


def top_c(tx: DataFrame, c: int, k: int, minsup: int, **options) -> DataFrame:
    """(item, rank, support, support_with, a, r, log_p, items): of each item's k best closed sets, the c most associated with it.

    The item itself is taken out of its patterns, and a pattern of nothing else is dropped; `support` is that of
    the rest, `support_with` that of the whole.
    """
    ranked = topk_closed(tx, k, minsup, **options)
    rest = ranked.select("item", F.col("support").alias("support_with"), F.array_remove("items", F.col("item")).alias("items")).where(F.size("items") > 0)
    items = dictionary(tx, minsup).select("item", F.col("support").alias("item_support"))
    full = pattern_supports(rest, tx).withColumnRenamed("full_support", "support")
    joined = rest.join(full, "items").join(hinted(items), "item")
    table = contingency(F.col("support_with"), F.col("support"), F.col("item_support"), F.lit(tx.count()))
    scored = joined.select("*", fisher(*table).alias("f")).select("item", "support", "support_with", "f.a", "f.r", "f.log_p", "items")
    best = scored.withColumn("rank", F.expr("cast(row_number() over (partition by item order by a desc, r asc, size(items) asc, items asc) as int)"))
    return best.where(F.col("rank") <= c).select("item", "rank", "support", "support_with", "a", "r", "log_p", "items")
