import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from longtail.operators import bounds, correlate, encode, mine, rank
from longtail.operators.kernel import mine as kernel
from longtail.plans import cli
from longtail.sources import sinks
from longtail.sources.transactions import from_array, from_long, read_contingency, read_group, read_transactions

BASKETS = [[1, 3, 5, 6, 7], [1, 3, 5, 6], [1, 3, 5, 6, 2], [2, 3, 7], [5, 7], [7]]


def closed_sets(rows, minsup):
    """{closed set: support}: all intersections of weighted rows."""
    sets = [frozenset(r) for r, _ in rows]
    found = set(sets)
    while new := {a & b for a in found for b in sets} - found:
        found |= new
    out = {s: sum(w for r, w in rows if s <= set(r)) for s in found if s}
    return {s: n for s, n in out.items() if n >= minsup}


def best(found, k):
    items = sorted({i for s in found for i in s})
    order = lambda x: (-x[0], len(x[1]), x[1])
    return {i: sorted(((n, sorted(s)) for s, n in found.items() if i in s), key=order)[:k] for i in items}


def frame(spark, baskets):
    return from_array(spark.createDataFrame([(i, b) for i, b in enumerate(baskets)], "tid bigint, items array<bigint>"), "items", "tid")


rows_of = st.lists(st.tuples(st.sets(st.integers(0, 7), min_size=1).map(sorted), st.integers(1, 3)), min_size=1, max_size=10)


@settings(max_examples=200, deadline=None)
@given(rows_of, st.integers(1, 4), st.integers(1, 3))
def test_kernel_against_intersections(rows, minsup, k):
    want = closed_sets(rows, minsup)
    got = list(kernel(rows, range(8), minsup))
    assert {frozenset(p): n for n, p in got} == want and len(got) == len(want)
    pruned = {frozenset(p): n for n, p in kernel(rows, range(8), minsup, k)}
    assert best(pruned, k) == best(want, k)


@pytest.mark.parametrize("groups,prune", [(1, True), (3, False), (64, True)])
def test_topk_is_the_definition(spark, groups, prune):
    got = mine.topk_closed(frame(spark, BASKETS), 2, 2, groups=groups, prune=prune).collect()
    want = best(closed_sets([(b, 1) for b in BASKETS], 2), 2)
    assert {i: [(r.support, list(r["items"])) for r in sorted((r for r in got if r.item == i), key=lambda r: r["rank"])] for i in want} == want
    assert {r.item for r in got} == set(want)


@pytest.mark.parametrize("cells", [1, 4, 12])
def test_split_cores_give_the_same(spark, cells):
    """Groups over the limit are split, down to cores of many items."""
    want = closed_sets([(b, 1) for b in BASKETS], 2)
    found = mine.closed_itemsets(frame(spark, BASKETS), 2, groups=2, cells=cells).collect()
    assert {frozenset(r["items"]): r.support for r in found} == want and len(found) == len(want)
    got = mine.topk_closed(frame(spark, BASKETS), 2, 2, groups=2, cells=cells).collect()
    top = best(want, 2)
    assert {i: [(r.support, list(r["items"])) for r in sorted((r for r in got if r.item == i), key=lambda r: r["rank"])] for i in top} == top


def test_closed_and_reports(spark):
    found = mine.closed_itemsets(frame(spark, BASKETS), 2)
    want = closed_sets([(b, 1) for b in BASKETS], 2)
    assert {frozenset(r["items"]): r.support for r in found.collect()} == want
    ranked = rank.top_k(found, 2).cache()
    stats = {r.item: r for r in rank.item_stats(ranked).collect()}
    assert stats[7].support == 4 and stats[7].patterns == 2
    limited = rank.restrict_k(ranked, spark.createDataFrame([(7, 1), (99, 5)], "item bigint, k int"), 2)
    assert limited.where("item = 7").count() == 1 and limited.where("item = 3").count() == 2
    assert rank.unique_patterns(ranked).count() == len({tuple(r["items"]) for r in ranked.collect()})
    assert sinks.sizes(ranked).first().patterns == ranked.count()
    line = sinks.json_lines(ranked.where("item = 5")).first().value
    assert line.startswith('{"5":[{"sup":4,"set":["5"]}')
    kth = {r.item: r.bound for r in bounds.kth_support(ranked, 2).collect()}
    assert all(kth[i] == min(r.support for r in ranked.collect() if r.item == i) for i in kth)


def test_universal_items_and_empty(spark):
    tx = frame(spark, [[1, 2], [1], [1, 2, 3]])
    assert mine.topk_closed(tx, 3, 1).where("item = 1").count() == 3
    assert mine.topk_closed(tx, 3, 1, include_universal_items=False).where("item = 1").count() == 0
    assert mine.topk_closed(frame(spark, BASKETS).limit(0), 3, 1).count() == 0


def test_dictionary_ranks(spark):
    got = sorted(encode.dictionary(frame(spark, BASKETS), 2).collect(), key=lambda r: r["rank"])
    assert [(r.item, r.support) for r in got] == [(3, 4), (5, 4), (7, 4), (1, 3), (6, 3), (2, 2)] and [r["rank"] for r in got] == list(range(6))
    items = encode.dictionary(frame(spark, BASKETS), 2)
    assert encode.group_members(items, 0, 1, inside=False).count() == 0


def test_sources(spark, tmp_path):
    f = tmp_path / "tx.txt"
    f.write_text("1 3 3 \n\n2\t7\r\n x 5")  # repeats, a blank line, a tab, no final newline
    got = sorted(list(r["items"]) for r in read_transactions(spark, str(f), invalid="drop").collect())
    assert got == [[1, 3], [2, 7], [5]]
    assert sorted(list(r["items"]) for r in read_transactions(spark, str(f), "string").collect()) == [["1", "3"], ["2", "7"], ["5", "x"]]
    with pytest.raises(Exception):
        read_transactions(spark, str(f)).collect()
    long = spark.createDataFrame([(1, 5), (1, 5), (1, 4), (2, None), (None, 3)], "t bigint, i bigint")
    assert [(r.tid, list(r["items"])) for r in from_long(long, "t", "i").collect()] == [(1, [4, 5])]
    dictionary = spark.createDataFrame([(1, 1, 0), (3, 1, 1)], "item bigint, support bigint, rank int")
    f.write_text("1 3\n3\n2\n")
    assert read_group(spark, str(f), dictionary, 0, 2).count() == 1


def test_fisher_against_combinations(spark):
    n, m = 40, 15
    rows = [(a, r) for r in (3, 10, 20) for a in range(max(0, r + m - n), min(r, m) + 1)]
    df = spark.createDataFrame([(r, a) for a, r in rows], "support bigint, support_with bigint")
    exact = {(r, a): sum(math.comb(r, x) * math.comb(n - r, m - x) for x in range(a, min(r, m) + 1)) / math.comb(n, m) for a, r in rows}
    for row in correlate.score_contingency(df, n, m).collect():
        assert math.isclose(math.exp(row.log_p), exact[row.support, row.support_with], rel_tol=1e-9)


def test_top_c(spark):
    got = correlate.top_c(frame(spark, BASKETS), 1, 3, 2).collect()
    assert all(r.item not in r["items"] and r.support >= r.support_with for r in got)
    sup = correlate.pattern_supports(spark.createDataFrame([([3, 5],), ([9],)], "items array<bigint>"), frame(spark, BASKETS))
    assert {tuple(r["items"]): r.full_support for r in sup.collect()} == {(3, 5): 3, (9,): 0}


def test_cli_and_contingency(spark, tmp_path, capsys):
    f = tmp_path / "t.txt"
    f.write_text("".join(" ".join(map(str, b)) + "\n" for b in BASKETS))
    cli.main(["-k", "1", str(f), "2"])
    assert "4\t7" in capsys.readouterr().out.splitlines()
    g = tmp_path / "c.txt"
    g.write_text("10\t4\tx\n")
    assert read_contingency(spark, str(g)).first().support_with == 4


def test_tail_stops_where_terms_add_nothing():


    def whole(a, b, c, d):
        r, s, m = a + b, c + d, a + c
        lf = math.lgamma
        fixed = lf(r + 1) + lf(s + 1) + lf(m + 1) + lf(r + s - m + 1) - lf(r + s + 1)
        t = np.array([fixed - lf(x + 1) - lf(r - x + 1) - lf(m - x + 1) - lf(s - m + x + 1) for x in range(a, min(m, r) + 1)])
        return t.max() + math.log(np.exp(t - t.max()).sum())

    for table in ((3, 4, 5, 60), (5000, 20_000, 25_000, 900_000), (20_000, 30_000, 40_000, 50_000), (0, 30_000, 20_000, 60_000), (9000, 0, 0, 9000)):
        assert abs(correlate._tail(*table)[2] - min(0.0, whole(*table))) <= 1e-7 * max(1.0, abs(whole(*table)))


def test_pattern_supports_by_the_rarest_item(spark):
    rng = np.random.default_rng(4)
    baskets = [sorted({"all", *rng.choice(list("abcdefgh"), int(rng.integers(1, 6)))}) for _ in range(200)]
    tx = spark.createDataFrame(list(enumerate(baskets)), "tid bigint, items array<string>")
    patterns = [["all"], ["a", "b"], ["all", "c", "h"], ["a", "zz"], ["zz"], list("abcdefgh"), ["d"]]
    got = {tuple(r["items"]): r.full_support for r in correlate.pattern_supports(spark.createDataFrame([(p,) for p in patterns], "items array<string>"), tx).collect()}
    assert got == {tuple(p): sum(set(p) <= set(b) for b in baskets) for p in patterns}


def test_a_basket_of_ten_thousand_items(spark):
    """Its pairs are not made; the sets are those of the baskets without it, each with it."""
    rows = [(0, [f"i{n:05}" for n in range(10_000)]), (1, ["i00001", "i00002"]), (2, ["i00001", "i00002", "i00003"])]
    tx = spark.createDataFrame(rows, "tid bigint, items array<string>")
    got = {(r.item, r["rank"]): (r.support, r["items"]) for r in mine.topk_closed(tx, 2, 2).collect()}
    assert got == {("i00001", 1): (3, ["i00001", "i00002"]), ("i00002", 1): (3, ["i00001", "i00002"]), ("i00003", 1): (2, ["i00001", "i00002", "i00003"]),
                   ("i00001", 2): (2, ["i00001", "i00002", "i00003"]), ("i00002", 2): (2, ["i00001", "i00002", "i00003"])}
    few = spark.createDataFrame([(list(range(600)),)], "ranks array<int>")
    assert not mine._few_pairs(few) and mine._few_pairs(spark.createDataFrame([(list(range(500)),)], "ranks array<int>"))
