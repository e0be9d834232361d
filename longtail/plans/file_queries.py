"""Registered queries that write baskets, patterns or side files to the shared folder and read them back, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bounds, correlate, encode, mine
from ..operators.shared import folder
from ..sources import sinks
from ..sources.transactions import items_text, read_contingency, read_group, read_group_parquet, read_item_k, read_transactions, text_to_parquet
from . import queries as mining

GROUP, GROUPS = 1, 4


def _lines(df: DataFrame) -> str:
    """The folder that the rows' `value` was written to as text."""
    path = folder(df.sparkSession)
    df.select("value").write.text(path)
    return path


def _baskets(tx: DataFrame) -> str:
    return _lines(tx.select(items_text("items").alias("value")))


def file_scan_part(spark, d):
    return encode.item_support(read_transactions(spark, _baskets(mining.parts(spark, d))), 2)


def string_file_scan_brand(spark, d):
    return encode.item_support(read_transactions(spark, _baskets(mining.brands(spark, d)), "string"))


def _group_supports(baskets: DataFrame) -> DataFrame:
    return encode.item_support(baskets.select("tid", F.col("ranks").alias("items"))).withColumnRenamed("item", "rank")


def group_file_part(spark, d):
    """Supports, by rank, in the baskets that hold an item of one group."""
    tx = mining.parts(spark, d)
    return _group_supports(read_group(spark, _baskets(tx), encode.dictionary(tx, 5), GROUP, GROUPS))


def group_parquet_part(spark, d):
    tx, path = mining.parts(spark, d), folder(spark)
    text_to_parquet(spark, _baskets(tx), path)
    return _group_supports(read_group_parquet(spark, path, encode.dictionary(tx, 5), GROUP, GROUPS))


def item_k_file_part(spark, d):
    return read_item_k(spark, _lines(spark.read.parquet(f"{d}/part.parquet").select(F.concat_ws(" ", "p_partkey", "p_size").alias("value"))))


def contingency_file_nation(spark, d):
    """Nations as patterns, the segment BUILDING as the item: a line of supports for each, scored."""
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_nationkey", (F.col("c_mktsegment") == "BUILDING").cast("int").alias("hit"))
    n, item = c.agg(F.count(F.lit(1)), F.sum("hit")).first()
    lines = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("s"), F.sum("hit").alias("w")).select(F.concat_ws("\t", "s", "w", "c_nationkey").alias("value"))
    scored = correlate.score_contingency(read_contingency(spark, _lines(lines)), n, item)
    x = [F.col("support_with"), F.col("support"), F.lit(item), F.lit(n)]
    return scored.select("line", "support", "support_with", "a", F.round("log_p", 6).alias("log_p"), F.round(correlate.hypergeometric(*x), 6).alias("point"), F.round(correlate.least_log_p(*x[1:]), 6).alias("least_log_p"))


def _written(patterns: DataFrame, form: str) -> DataFrame:
    path = folder(patterns.sparkSession)
    sinks.write(patterns, path, form)
    return patterns.sparkSession.read.text(path) if form != "parquet" else patterns.sparkSession.read.parquet(path)


def text_sink_attributes(spark, d):
    return _written(mine.topk_closed(mining.attributes(spark, d), mining.K, 2), "text")


def json_sink_events(spark, d):
    return _written(mine.topk_closed(mining.event_types(spark, d), mining.K, 1), "json")


def parquet_sink_attributes(spark, d):
    return _written(mine.topk_closed(mining.attributes(spark, d), mining.K, 2), "parquet").withColumn("items", items_text("items"))


def correlated_sink_attributes(spark, d):
    """The fields of the lines; r rounded."""
    parts = F.split("value", "\t")
    lines = _written(correlate.top_c(mining.attributes(spark, d), mining.C, mining.K, 2), "correlated")
    return lines.select(*(parts[i].cast("bigint").alias(c) for i, c in enumerate(("support", "support_with", "a"))), F.round(parts[3].cast("double"), 6).alias("r"), parts[4].alias("items"))


def over_filtered_part(spark, d):
    return encode.over_filter(encode.dictionary(mining.parts(spark, d), 5), 25)


def starter_eps_brand(spark, d):
    tx = mining.brands(spark, d)
    m = mining._minsup(tx)
    items = encode.dictionary(tx, m)
    pairs = bounds.pair_support(encode.encode(tx, items), m)
    return bounds.starter_eps(pairs, bounds.kth_bounds(items, pairs, mining.K, m))


QUERIES = (
    file_scan_part, string_file_scan_brand, group_file_part, group_parquet_part, item_k_file_part, contingency_file_nation, text_sink_attributes, json_sink_events, parquet_sink_attributes,
    correlated_sink_attributes, over_filtered_part, starter_eps_brand,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    known = mining.oracle_sql()
    ranked = "with t as (select distinct l_orderkey as tid, l_partkey as item from lineitem where l_orderkey is not null and l_partkey is not null), d as (select item, count(*)::bigint as support, (row_number() over (order by count(*) desc, item) - 1)::int as rank from t group by item having count(*) >= 5)"
    group = ranked + f", e as (select tid, rank from t join d using (item)) select rank, count(*)::bigint as support from e where tid in (select tid from e where rank % {GROUPS} = {GROUP}) group by rank"
    ln_choose = lambda n, k: f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"
    point = f"{ln_choose('i', 'x')} + {ln_choose('(n - i)', '(s - x)')} - {ln_choose('n', 's')}"
    bounds_sql = known["kth_bounds_brand"]
    cut = bounds_sql.index(" select d.item, d.rank,")
    return {
        "file_scan_part": known["item_support_part"],
        "string_file_scan_brand": f"select item, count(*)::bigint as support from ({mining._BASKETS['brand']}) group by item",
        "group_file_part": group,
        "group_parquet_part": group,
        "item_k_file_part": "select p_partkey::bigint as item, p_size::int as k from part",
        "contingency_file_nation": f"""with c as (select c_nationkey, case when c_mktsegment = 'BUILDING' then 1 else 0 end as hit from customer), q as (select c_nationkey, count(*)::bigint as s, sum(hit)::bigint as w from c group by c_nationkey),
z as (select *, (select count(*) from c) as n, (select sum(hit) from c)::bigint as i from q), y as (select *, [{point} for x in range(w, least(s, i) + 1)] as ln from z)
select s || chr(9) || w || chr(9) || c_nationkey as line, s as support, w as support_with, case when w < s * i // n then 0 else round(-ln[1] / 1000) end::bigint as a,
round(least(list_max(ln) + ln(list_sum([exp(v - list_max(ln)) for v in ln])), 0), 6) as log_p, round(exp(ln[1]), 6) as point, round({ln_choose('greatest(s, i)', 'least(s, i)')} - {ln_choose('n', 'least(s, i)')}, 6) as least_log_p from y""",
        "text_sink_attributes": known["text_lines_attributes"],
        "json_sink_events": known["json_lines_events"],
        "parquet_sink_attributes": known["topk_attributes"],
        "correlated_sink_attributes": f"select support, support_with, a, r, items from ({known['top_c_attributes']})",
        "over_filtered_part": ranked + " select item, support, rank from d where support >= 25",
        "starter_eps_brand": bounds_sql[:cut] + f""", b as ({bounds_sql[cut:]}), o as (select b as rank, a as other from p where support >= (select {mining.minsup_sql()} from n) union select rank, rank from b)
select o.rank, min(b.bound)::bigint as eps from o join b on b.rank = o.other group by o.rank""",
    }
