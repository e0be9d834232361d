import json
import math

import pytest

from longtail.operators import bounds, correlate, encode, mine
from longtail.plans import cli, fisher
from longtail.sources import sinks
from longtail.sources.transactions import read_group, read_group_parquet, read_item_k, read_transactions, text_to_parquet
from longtail.streaming import supports

# Baskets of the survey's cases, their minimum support, and all closed sets with their supports.
GOLDENS = {
    "blank lines": ("\n\n5 3 1 6 7\n5 3 1 2 6\n5 7\n\n3 2 7\n5 3 1 6 7\n\n", 2, "3: 1 3 5 6; 2: 1 3 5 6 7; 2: 2 3; 4: 3; 3: 3 7; 4: 5; 3: 5 7; 4: 7"),
    "an item of all": ("1\n1\n1 2\n1 2 3 5 6\n1 2 4\n", 2, "5: 1; 3: 1 2"),
    "no final newline": ("7\n1\n1 2\n1 2 3 5 6\n1 2 4", 2, "4: 1; 3: 1 2"),
    "items named by support": ("5 4 3 2 1\n5 4\n4\n5 3 2\n5 3\n5 4\n", 2, "5: 5; 4: 4; 3: 4 5; 3: 3 5; 2: 2 3 5"),
    "sixteen": ("0 1 2\n" * 6 + "0 2\n" * 2 + "0\n" * 3 + "1\n" * 4 + "3\n", 2, "11: 0; 10: 1; 8: 0 2; 6: 0 1 2"),
}


def parsed(golden):
    return {(int(s), tuple(map(int, items.split()))) for s, items in (x.split(":") for x in golden.split(";"))}


def found(df):
    return {(r.support, tuple(r["items"])) for r in df.collect()}


@pytest.mark.parametrize("case", GOLDENS)
def test_closed_sets_of_files(spark, tmp_path, case):
    text, minsup, want = GOLDENS[case]
    (tmp_path / "tx").write_text(text)
    assert found(mine.closed_itemsets(read_transactions(spark, str(tmp_path / "tx")), minsup)) == parsed(want)


def test_top_two_of_a_file(spark, tmp_path):
    (tmp_path / "tx").write_text("1\n1\n1\n1 2\n1 2 3\n2 3\n1 2\n2\n1 3\n1 3\n")
    assert found(mine.topk_closed(read_transactions(spark, str(tmp_path / "tx")), 2, 1)) == parsed("8: 1; 5: 2; 3: 1 2; 4: 3; 3: 1 3")


def test_groups_of_text_and_parquet(spark, tmp_path):
    source, target = str(tmp_path / "tx"), str(tmp_path / "pq")
    (tmp_path / "tx").write_text(GOLDENS["blank lines"][0])
    names = spark.createDataFrame([(1, 3), (3, 2), (5, 1), (6, 4), (7, 0)], "item bigint, rank int")
    text_to_parquet(spark, source, target)
    with pytest.raises(Exception):
        text_to_parquet(spark, source, target)
    text_to_parquet(spark, source, target, overwrite=True)
    one, two = read_group(spark, source, names, 1, 2), read_group_parquet(spark, target, names, 1, 2)
    assert one.count() == 4 and sorted(tuple(r.ranks) for r in one.collect()) == sorted(tuple(r.ranks) for r in two.collect())


def test_sinks_replace_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, 3, ["a", "b"]), ("b", 2, 2, ["b"])], "item string, rank int, support bigint, items array<string>")
    path = str(tmp_path / "out")
    for _ in range(2):
        sinks.write(df, path, "text")
    assert sorted(r.value for r in spark.read.text(path).collect()) == ["2\tb", "3\ta b"]
    sinks.write(df, path, "json")
    assert json.loads(spark.read.text(path).first().value) == {"b": [{"sup": 3, "set": ["a", "b"]}, {"sup": 2, "set": ["b"]}]}
    sinks.write(df, path)
    assert spark.read.parquet(path).count() == 2
    sinks.write(df, None, "noop")
    scored = spark.createDataFrame([(4, 3, 0, 0.5, ["a", "c"])], "support bigint, support_with bigint, a bigint, r double, items array<string>")
    sinks.write(scored, path, "correlated")
    assert spark.read.text(path).first().value == "4\t3\t0\t0.5\ta c"
    with pytest.raises(ValueError):
        sinks.write(df, path, "xml")


def test_chances_of_tables(spark):
    n, m = 40, 15
    rows = [(r, a) for r in (0, 3, 10, 20, 40) for a in range(max(0, r + m - n), min(r, m) + 1)]
    df = spark.createDataFrame(rows, "s bigint, w bigint").selectExpr("*", f"{m}L as i", f"{n}L as n")
    c = [df[x] for x in "wsin"]
    point = lambda r, a: math.comb(m, a) * math.comb(n - m, r - a) / math.comb(n, r)
    got = df.select("s", "w", correlate.hypergeometric(*c).alias("p"), correlate.least_log_p(*c[1:]).alias("least")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert math.isclose(r.p, point(r.s, r.w), rel_tol=1e-9) and math.isclose(math.exp(r.least), point(r.s, min(r.s, m)), rel_tol=1e-9)
        assert r.least <= correlate._tail(r.w, r.s - r.w, m - r.w, n - m - r.s + r.w)[2] + 1e-9


def test_bounds_of_starters_and_over_filter(spark):
    items = spark.createDataFrame([("a", 9, 0), ("b", 5, 1), ("c", 2, 2)], "item string, support bigint, rank int")
    assert {r["rank"] for r in encode.over_filter(items, 5).collect()} == {0, 1}
    pairs = spark.createDataFrame([(0, 2, 2), (0, 1, 3)], "a int, b int, support bigint")
    limits = spark.createDataFrame([(0, 4), (1, 3), (2, 7)], "rank int, bound bigint")
    assert {r["rank"]: r.eps for r in bounds.starter_eps(pairs, limits).collect()} == {0: 4, 1: 3, 2: 4}


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "tx").write_text(GOLDENS["blank lines"][0])
    (tmp_path / "k").write_text("7 1\n\n99 5\n")
    (tmp_path / "c").write_text("10\t1\tfew\n10\t9\tmany\n")
    assert [tuple(r) for r in read_item_k(spark, str(tmp_path / "k")).collect()] == [(7, 1), (99, 5)]
    run = lambda *a: (cli.main([*a, str(tmp_path / "tx"), "2"]), capsys.readouterr())[1]
    every, limited = run("-k", "3"), run("-k", "3", "-r", str(tmp_path / "k"))
    assert every.out.splitlines().count("3\t3 7") == 2 and limited.out.splitlines().count("3\t3 7") == 1
    summary = json.loads(every.err.strip().splitlines()[-1])
    assert summary["patterns"] == len(every.out.splitlines()) and summary["total_length"] == sum(len(x.split("\t")[1].split()) for x in every.out.splitlines())
    assert "|7 " in run("-k", "3", "-i").out and len(run("-k", "3", "-u").out.splitlines()) == 8
    assert run("-k", "3", "-b").out == "" and all(len(x.split("\t")) == 5 for x in run("-k", "3", "-c", "1").out.splitlines())
    fisher.main([str(tmp_path / "c"), "100", "20"])
    lines = capsys.readouterr().out.splitlines()
    assert [x.split("\t")[-1] for x in lines] == ["many", "few"] and all("^^" in x.split("\t")[0] for x in lines)


def test_streamed_supports(spark, tmp_path):
    spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, []), (4, None)], "tid bigint, items array<string>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("tid bigint, items array<string>").parquet(str(tmp_path / "in"))
    query = supports.item_support(stream).writeStream.outputMode("complete").format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("streamed").collect()} == {("a", 1), ("b", 2)}
