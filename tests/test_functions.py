import math

from pyspark.sql import functions as F

from longtail.functions import scalars, special, statistics
from longtail.plans import function_queries


def test_special():
    assert math.isclose(special.chisquare(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(special.t(2.2281388519649385, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(special.f(4.964602743730711, 1, 10), 0.05, rel_tol=1e-9)
    for p in (0.01, 0.3, 0.9):
        assert math.isclose(special.chisquare(special.chisquare_inverse(p, 4), 4), p, rel_tol=1e-9)
        assert math.isclose(special.t(special.t_inverse(p, 5), 5), p, rel_tol=1e-9)
        assert math.isclose(special.incomplete_beta(special.incomplete_beta_inverse(p, 2, 3), 2, 3), p, rel_tol=1e-9)
        assert math.isclose(special.normal(special.normal_inverse(p)), p, rel_tol=1e-9)
    two, left, right = special.fisher_exact(3, 1, 1, 3)
    assert math.isclose(two, 34 / 70) and math.isclose(right, 17 / 70) and math.isclose(left, 69 / 70)


def test_scalars(spark):
    row = spark.sql("select '(a)b(c)' as s, -2.7D as x, 'The cat' as t").select(
        scalars.delete_parenthesized(F.col("s")).alias("d"), scalars.only_parenthesized(F.col("s")).alias("o"), scalars.trunc(F.col("x")).alias("x"), scalars.contains_whole_word(F.col("t"), "CAT").alias("w"),
        scalars.index_of_whole_word(F.col("t"), "cat").alias("i"), scalars.duration(F.lit(3725)).alias("h"), scalars.chebyshev(F.array(F.lit(2.0), F.lit(1.0)), F.lit(0.5)).alias("c"), scalars.safe_log(F.lit(0.0)).alias("l"),
    ).first()
    assert tuple(row) == ("b", "ac", -2, True, 4, "1:02:05", 1.5, 0.0)


def test_ordered_statistics(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([5, 1, 4, 1, 9])], "k string, t int, x double")
    assert statistics.trimmed_mean(df, ["k"], "x", 1, 1).first().trimmed_mean == 10 / 3
    assert statistics.winsorized_mean(df, ["k"], "x", 1, 1).first().winsorized_mean == (1 + 1 + 4 + 5 + 5) / 5
    assert sorted(r.mid_rank for r in statistics.rank_order(df, ["k"], "x").collect()) == [1.5, 1.5, 3.0, 4.0, 5.0]
    assert statistics.durbin_watson(df, ["k"], "t", "x").first().durbin_watson == (16 + 9 + 9 + 64) / (25 + 1 + 16 + 1 + 81)
    assert {r.a + r.b: r.correlation for r in statistics.covariance_matrix(df, ["x", "t"]).collect()}["xx"] == 1.0


def test_no_spread_gives_null(spark):
    """One value, a constant column, weights of 0: null, no division by zero."""
    df = spark.createDataFrame([("one", 0, 3.0, 0.0), ("same", 0, 2.0, 1.0), ("same", 1, 2.0, 4.0), ("gap", 0, 1.0, None), ("gap", 1, 2.0, 1.0), ("gap", 2, 4.0, 3.0)], "k string, t int, x double, w double")
    rows = {r.k: r for r in df.groupBy("k").agg(statistics.sample_skew("x").alias("skew"), statistics.sample_kurtosis("x").alias("kurtosis"), statistics.weighted_mean("x", "w").alias("mean"), statistics.harmonic_mean("w").alias("harmonic"), statistics.sample_standard_deviation("x").alias("sd")).collect()}
    assert rows["one"][1:] == (None,) * 5 and rows["same"]["mean"] == 2.0 and rows["same"].sd == 0.0
    assert {r.k: r.auto_correlation for r in statistics.auto_correlation(df, ["k"], "t", "x", 1).collect()}["same"] is None
    spearman = {r.k: r.spearman for r in statistics.spearman(df, ["k"], "x", "w").collect()}
    assert spearman["same"] is None and math.isclose(spearman["gap"], 1.0)
    cells = {(r.a, r.b): r for r in statistics.covariance_matrix(df.where("k = 'same'"), ["x", "w"]).collect()}
    assert cells["x", "w"].correlation == 0.0 and math.isclose(cells["w", "w"].correlation, 1.0)
    gap = {(r.a, r.b): r.correlation for r in statistics.covariance_matrix(df.where("k = 'gap'"), ["x", "w"]).collect()}
    assert math.isclose(gap["x", "w"], 1.0)
    assert {r.z for r in statistics.standardize(df.where("k = 'same'"), ["k"], "x").collect()} == {None}


def test_udf_of_nulls_and_repeats(spark):
    df = spark.createDataFrame([(4.0, 2.0), (4.0, 2.0), (None, 2.0), (5.0, None), (5.0, 2.0)], "n double, k double")
    assert [r[0] for r in df.select(special.udf("binomial")(F.col("n"), F.col("k"))).collect()] == [6.0, 6.0, None, None, 10.0]
    assert df.limit(0).select(special.udf("erf")("n")).count() == 0


def test_products_of_large_counts(spark):
    """Counts and sums whose products exceed a long."""
    sizes = (4, 54_000, 60_000, 12_000_000, 6_000_000_000)
    df = spark.createDataFrame([(n,) for n in sizes], "n bigint")
    for n, skew, kurtosis in df.select("n", statistics.sample_skew_standard_error(F.col("n")), statistics.sample_kurtosis_standard_error(F.col("n"))).collect():
        assert math.isclose(skew, math.sqrt(6 * n * (n - 1) / ((n - 2) * (n + 1) * (n + 3))), rel_tol=1e-14)
        assert math.isclose(kurtosis, math.sqrt(24 * n * (n - 1) ** 2 / ((n - 3) * (n - 2) * (n + 3) * (n + 5))), rel_tol=1e-14)
    cells = spark.createDataFrame([("a", "x", 6 * 10**9), ("a", "y", 2 * 10**9), ("b", "x", 2 * 10**9), ("b", "y", 6 * 10**9)], "r string, c string, n bigint")
    assert statistics.chi_square(cells, "r", "c", "n").first().chi_square == 4e9
    weighted = spark.createDataFrame([(60_000, 50_000), (70_000, 50_000)], "x int, w int")
    assert math.isclose(weighted.agg(statistics.sample_weighted_variance("x", "w")).first()[0], 2 * 5000**2 * 50_000 / 99_999, rel_tol=1e-9)


def test_stats_more_of_large_groups(spark, tmp_path):
    """One group of 60,000 rows."""
    n = 60_000
    spark.range(n).selectExpr("id as l_orderkey", "1 as l_linenumber", "'A' as l_returnflag", "'F' as l_linestatus", "id % 50 + 1D as l_quantity", "1D as l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    (row,) = function_queries.stats_more(spark, str(tmp_path)).collect()
    assert row.kurtosis_error == round(math.sqrt(24 * n * (n - 1) ** 2 / ((n - 3) * (n - 2) * (n + 3) * (n + 5))), 6) and row.skew_error == round(math.sqrt(6 * n * (n - 1) / ((n - 2) * (n + 1) * (n + 3))), 6)
    assert row.squares == n * (50**2 - 1) / 12 and row.upper_quartile == 38.0 and row.bins == n * (10 + 2 * 10 + 3 * 21) // 50
