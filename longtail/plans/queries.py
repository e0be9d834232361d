"""The registered mining queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bounds, correlate, encode, mine, rank
from ..sources import sinks
from ..sources.transactions import from_long, items_text

#: Minimum support as a share of all baskets, and patterns for each item.
SHARE, K, C = 0.02, 5, 3


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def brands(spark: SparkSession, d: str) -> DataFrame:
    """Baskets are orders, items the brands of their parts."""
    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(_t(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return from_long(lines, "l_orderkey", "p_brand")


def attributes(spark: SparkSession, d: str) -> DataFrame:
    """Baskets are customers, items their nation, region and market segment."""
    nation = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    c = _t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return from_long(c.select("c_custkey", F.explode(F.array(F.concat(F.lit("n:"), "n_name"), F.concat(F.lit("r:"), "r_name"), F.concat(F.lit("s:"), "c_mktsegment"))).alias("item")), "c_custkey", "item")


def event_types(spark: SparkSession, d: str) -> DataFrame:
    return from_long(_t(spark, d, "events"), "user_id", "event_type")


def parts(spark: SparkSession, d: str) -> DataFrame:
    return from_long(_t(spark, d, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey")


def _minsup(tx: DataFrame, share: float = SHARE) -> int:
    return max(1, int(tx.count() * share))


def _flat(df: DataFrame) -> DataFrame:
    """Items as one string, for comparison."""
    return df.withColumn("items", items_text("items"))


def item_support_part(spark, d):
    return encode.item_support(parts(spark, d), 2)


def renaming_brand(spark, d):
    tx = brands(spark, d)
    return encode.dictionary(tx, _minsup(tx))


def renaming_part(spark, d):
    return encode.dictionary(parts(spark, d), 5)


def encoded_attributes(spark, d):
    tx = attributes(spark, d)
    return encode.encode(tx, encode.dictionary(tx, 2)).withColumn("ranks", items_text("ranks"))


def pair_support_brand(spark, d):
    tx = brands(spark, d)
    return bounds.pair_support(encode.encode(tx, encode.dictionary(tx, 1)), 1)


def kth_bounds_brand(spark, d):
    tx = brands(spark, d)
    m = _minsup(tx)
    items = encode.dictionary(tx, m)
    found = bounds.kth_bounds(items, bounds.pair_support(encode.encode(tx, items), m), K, m)
    return found.join(items.select("rank", "item"), "rank").select("item", "rank", "bound")


def closed_attributes(spark, d):
    return _flat(mine.closed_itemsets(attributes(spark, d), 2))


def closed_brand(spark, d):
    tx = brands(spark, d)
    return _flat(mine.closed_itemsets(tx, _minsup(tx)))


def topk_brand(spark, d):
    tx = brands(spark, d)
    return _flat(mine.topk_closed(tx, K, _minsup(tx)))


def topk_attributes(spark, d):
    return _flat(mine.topk_closed(attributes(spark, d), K, 2))


def topk_events(spark, d):
    return _flat(mine.topk_closed(event_types(spark, d), K, 1))


def topk_events_no_universal(spark, d):
    return _flat(mine.topk_closed(event_types(spark, d), K, 1, include_universal_items=False))


def topk_passes_attributes(spark, d):
    """Two passes, over the patterns of odd and of even support, merged."""
    found = mine.closed_itemsets(attributes(spark, d), 2)
    passes = [rank.top_k(found.where(F.col("support") % 2 == x), K) for x in (0, 1)]
    return _flat(rank.merge_top_k(passes, K))


def unique_patterns_attributes(spark, d):
    return _flat(rank.unique_patterns(mine.topk_closed(attributes(spark, d), K, 2)))


def item_stats_attributes(spark, d):
    return rank.item_stats(mine.topk_closed(attributes(spark, d), K, 2))


def restrict_k_attributes(spark, d):
    """One pattern of each region, K of the other items."""
    tx = attributes(spark, d)
    only = encode.item_support(tx).where(F.col("item").startswith("r:")).select("item", F.lit(1).alias("k"))
    return _flat(rank.restrict_k(mine.topk_closed(tx, K, 2), only, K))


def sizes_attributes(spark, d):
    return sinks.sizes(mine.topk_closed(attributes(spark, d), K, 2))


def text_lines_attributes(spark, d):
    return sinks.text_lines(mine.topk_closed(attributes(spark, d), K, 2))


def json_lines_events(spark, d):
    return sinks.json_lines(mine.topk_closed(event_types(spark, d), K, 1))


def pattern_support_attributes(spark, d):
    tx = attributes(spark, d)
    return _flat(correlate.pattern_supports(mine.topk_closed(tx, K, 2), tx))


def top_c_attributes(spark, d):
    return _flat(correlate.top_c(attributes(spark, d), C, K, 2).withColumns({"r": F.round("r", 6), "log_p": F.round("log_p", 6)}))


QUERIES = (
    item_support_part, renaming_brand, renaming_part, encoded_attributes, pair_support_brand, kth_bounds_brand, closed_attributes, closed_brand, topk_brand, topk_attributes, topk_events,
    topk_events_no_universal, topk_passes_attributes, unique_patterns_attributes, item_stats_attributes, restrict_k_attributes, sizes_attributes, text_lines_attributes, json_lines_events,
    pattern_support_attributes, top_c_attributes,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


_BASKETS = {
    "brand": "select distinct l_orderkey as tid, p_brand as item from lineitem join part on l_partkey = p_partkey where l_orderkey is not null and p_brand is not null",
    "attributes": "select c_custkey as tid, unnest(['n:' || n_name, 'r:' || r_name, 's:' || c_mktsegment]) as item from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
    "events": "select distinct user_id as tid, event_type as item from events where user_id is not null and event_type is not null",
}


def _closed(baskets: str, minsup: str) -> str:
    """WITH clauses up to c(items, support): the closed sets, found by growing tid lists."""
    return f"""with recursive t as (select distinct tid, item from ({_BASKETS[baskets]})), n as (select count(distinct tid) as n from t),
i as materialized (select item, list_sort(list(tid)) as tids from t group by item having count(*) >= (select {minsup} from n)),
f as (select [item] as items, item as last, tids from i union all
  select list_append(f.items, i.item), i.item, list_intersect(f.tids, i.tids) from f join i on i.item > f.last where len(list_intersect(f.tids, i.tids)) >= (select {minsup} from n)),
g as materialized (select items, len(tids)::bigint as support from f),
c as materialized (select items, support from g where not exists (select 1 from g h where h.support = g.support and len(h.items) > len(g.items) and list_has_all(h.items, g.items)))"""


def _ranked(baskets: str, minsup: str) -> str:
    return _closed(baskets, minsup) + f""",
o as (select unnest(items) as item, items, support from c), r as (select *, row_number() over (partition by item order by support desc, len(items), items)::int as rank from o),
k as (select item, rank, support, items from r where rank <= {K})"""


def minsup_sql() -> str:
    """What _minsup gives for n baskets."""
    return f"greatest(1, floor(n * {SHARE}::double)::bigint)"


def oracle_sql() -> dict[str, str]:
    m = minsup_sql()
    joined = "array_to_string(items, ' ') as items"
    renamed = "with t as ({b}), n as (select count(distinct tid) as n from t), s as (select item, count(*)::bigint as support from t group by item having count(*) >= (select {m} from n)) select item, support, (row_number() over (order by support desc, item) - 1)::int as rank from s"
    part_baskets = "select distinct l_orderkey as tid, l_partkey as item from lineitem where l_orderkey is not null and l_partkey is not null"
    ranks = "d as (select item, support, (row_number() over (order by support desc, item) - 1)::int as rank from (select item, count(*)::bigint as support from t group by item having count(*) >= (select {m} from n)))"
    tn = "with t as ({b}), n as (select count(distinct tid) as n from t), "
    brand = tn.format(b=_BASKETS["brand"])
    pairs = "e as (select tid, rank from t join d using (item)), p as (select x.rank as a, y.rank as b, count(*)::bigint as support from e x join e y on x.tid = y.tid and x.rank < y.rank group by x.rank, y.rank)"
    top = _ranked("attributes", "2")
    fisher = f"""{top}, rest as (select item, support as sw, list_filter(items, lambda x: x <> item) as items from k where len(items) > 1),
u as (select distinct items from rest), fs as (select u.items, count(*)::bigint as s from u join (select tid, list(item) as basket from t group by tid) b on list_has_all(b.basket, u.items) group by u.items),
q as (select rest.item, fs.s as support, rest.sw as support_with, rest.items, len(i.tids)::bigint as si, (select n from n) as n from rest join fs on rest.items = fs.items join i on i.item = rest.item),
q2 as (select *, [lgamma(support + 1) + lgamma(n - support + 1) + lgamma(si + 1) + lgamma(n - si + 1) - lgamma(n + 1) - lgamma(x + 1) - lgamma(support - x + 1) - lgamma(si - x + 1) - lgamma(n - support - si + x + 1) for x in range(support_with, least(support, si) + 1)] as ln from q),
q3 as (select *, case when support_with < support * si // n then 0 else round(-ln[1] / 1000) end::bigint as a, list_max(ln) as peak from q2),
q4 as (select *, least(peak + ln(list_sum([exp(x - peak) for x in ln])), 0) as log_p from q3),
q5 as (select *, exp(least(1000 * a + log_p, 700)) as r from q4),
q6 as (select *, row_number() over (partition by item order by a desc, r, len(items), items)::int as rank from q5)
select item, rank, support, support_with, a, round(r, 6) as r, round(log_p, 6) as log_p, {joined} from q6 where rank <= {C}"""
    return {
        "item_support_part": f"select item, count(*)::bigint as support from ({part_baskets}) group by item having count(*) >= 2",
        "renaming_brand": renamed.format(b=_BASKETS["brand"], m=m),
        "renaming_part": renamed.format(b=part_baskets, m="5"),
        "encoded_attributes": tn.format(b=_BASKETS["attributes"]) + ranks.format(m=2) + " select tid, array_to_string(list_sort(list(rank)), ' ') as ranks from t join d using (item) group by tid",
        "pair_support_brand": brand + ranks.format(m=1) + ", " + pairs + " select a, b, support from p",
        "kth_bounds_brand": brand + ranks.format(m=m) + ", " + pairs + f", v as (select rank, support from d union select a, support from p where support >= (select {m} from n) union select b, support from p where support >= (select {m} from n)), w as (select rank, support, row_number() over (partition by rank order by support desc) as nth from v) select d.item, d.rank, coalesce(w.support, (select {m} from n))::bigint as bound from d left join w on w.rank = d.rank and w.nth = {K}",
        "closed_attributes": _closed("attributes", "2") + f" select support, {joined} from c",
        "closed_brand": _closed("brand", m) + f" select support, {joined} from c",
        "topk_brand": _ranked("brand", m) + f" select item, rank, support, {joined} from k",
        "topk_attributes": top + f" select item, rank, support, {joined} from k",
        "topk_events": _ranked("events", "1") + f" select item, rank, support, {joined} from k",
        "topk_events_no_universal": _ranked("events", "1") + f" select item, rank, support, {joined} from k where item not in (select item from i where len(tids) = (select n from n))",
        "topk_passes_attributes": top + f" select item, rank, support, {joined} from k",
        "unique_patterns_attributes": top + f" select distinct support, {joined} from k",
        "item_stats_attributes": top + " select item, max(support) as support, count(*)::bigint as patterns, sum(support)::bigint as sum_support, min(support) as lowest_support from k group by item",
        "restrict_k_attributes": top + f" select item, rank, support, {joined} from k where rank <= case when starts_with(item, 'r:') then 1 else {K} end",
        "sizes_attributes": top + " select count(*)::bigint as patterns, sum(len(items))::bigint as total_length, floor(avg(len(items)))::bigint as average_length from k",
        "text_lines_attributes": top + " select support || chr(9) || array_to_string(items, ' ') as value from k",
        "json_lines_events": _ranked("events", "1") + """ select '{"' || item || '":[' || string_agg('{"sup":' || support || ',"set":["' || array_to_string(items, '","') || '"]}', ',' order by rank) || ']}' as value from k group by item""",
        "pattern_support_attributes": top + f" select {joined}, max(support) as full_support from k group by items",
        "top_c_attributes": fisher,
    }
