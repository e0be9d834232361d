"""Descriptive statistics: aggregate columns, and DataFrame functions where an order or a second pass is needed.

A statistic that would divide by 0 (too few values, no spread, no weight) is null, in ANSI mode too.
Counts and sums are multiplied as doubles: a product of four counts exceeds a long from 55,109 rows on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a, b) -> Column:
    return F.try_divide(a, b)


def _count(x: str) -> Column:
    return F.count(x).cast("double")


def _corr(x: str, y: str) -> Column:
    """Of the rows where both are known; null where one of them is constant."""
    of = lambda c, other: F.stddev_samp(F.when(F.col(other).isNotNull(), F.col(c)))
    return _ratio(F.covar_samp(x, y), of(x, y) * of(y, x))


def geometric_mean(x: str) -> Column:
    return F.exp(F.avg(F.ln(x)))


def harmonic_mean(x: str) -> Column:
    return _ratio(F.count(x), sum_of_inversions(x))


def rms(x: str) -> Column:
    return F.sqrt(F.avg(F.col(x) * F.col(x)))


def sum_of_powers(x: str, k: int) -> Column:
    return F.sum(F.pow(F.col(x), k))


def moment(x: str, k: int, centre: float = 0.0) -> Column:
    return F.avg(F.pow(F.col(x) - centre, k))


def sum_of_power_deviations(x: str, k: int, centre: float) -> Column:
    return F.sum(F.pow(F.col(x) - centre, k))


def sum_of_squared_deviations(x: str) -> Column:
    return F.var_pop(x) * F.count(x)


def sum_of_inversions(x: str) -> Column:
    """A value of 0 has none and is left out."""
    return F.sum(_ratio(F.lit(1.0), F.col(x)))


def sum_of_logarithms(x: str) -> Column:
    return F.sum(F.ln(x))


def product(x: str) -> Column:
    """Through logarithms of absolute values, so that nothing is collected; 0 if any value is."""
    sign = F.when(F.count_if(F.col(x) < 0) % 2 == 1, -1.0).otherwise(1.0)
    return F.when(F.count_if(F.col(x) == 0) > 0, 0.0).otherwise(sign * F.exp(F.sum(F.ln(F.abs(F.when(F.col(x) != 0, F.col(x)))))))


def quantile(x: str, phi: float) -> Column:
    """Linear interpolation at phi * (n - 1)."""
    return F.percentile(x, phi)


def quantiles(x: str, phis: list[float]) -> Column:
    return F.percentile(x, F.array(*map(F.lit, phis)))


def standard_error(x: str) -> Column:
    return F.sqrt(_ratio(F.var_samp(x), F.count(x)))


def excess_kurtosis(x: str) -> Column:
    return F.kurtosis(x)


def sample_skew(x: str) -> Column:
    """Bias-corrected."""
    n = _count(x)
    return _ratio(F.skewness(x) * F.sqrt(n * (n - 1)), n - 2)


def sample_skew_standard_error(n: Column) -> Column:
    n = n.cast("double")
    return F.sqrt(_ratio(6.0 * n * (n - 1), (n - 2) * (n + 1) * (n + 3)))


def sample_kurtosis(x: str) -> Column:
    """Bias-corrected, excess."""
    n = _count(x)
    return _ratio((n - 1) * ((n + 1) * F.kurtosis(x) + 6), (n - 2) * (n - 3))


def sample_kurtosis_standard_error(n: Column) -> Column:
    n = n.cast("double")
    return F.sqrt(_ratio(24.0 * n * (n - 1) * (n - 1), (n - 3) * (n - 2) * (n + 3) * (n + 5)))


def sample_standard_deviation(x: str) -> Column:
    """The sample deviation times 1 + 1 / (4 (n - 1)), the usual approximation to the unbiased factor."""
    return F.stddev_samp(x) * (1 + _ratio(F.lit(1.0), 4.0 * (F.count(x) - 1)))


def weighted_mean(x: str, w: str) -> Column:
    return _ratio(F.sum(F.col(x) * F.col(w)), F.sum(w))


def sample_weighted_variance(x: str, w: str) -> Column:
    wx = F.col(w).cast("double") * F.col(x)
    sw, swx, swxx = F.sum(w), F.sum(wx), F.sum(wx * F.col(x))
    return _ratio(swxx - _ratio(swx * swx, sw), sw - 1)


def pooled_mean(n1: Column, m1: Column, n2: Column, m2: Column) -> Column:
    return _ratio(n1 * m1 + n2 * m2, n1 + n2)


def pooled_variance(n1: Column, v1: Column, n2: Column, v2: Column) -> Column:
    return _ratio(n1 * v1 + n2 * v2, n1 + n2)


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """One row a key from partial rows (n, low, high, total, squares): the incremental update."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))


def frequencies(df: DataFrame, x: str) -> DataFrame:
    return df.groupBy(x).agg(F.count(F.lit(1)).alias("n"))


def mean_deviation(df: DataFrame, by: list[str], x: str) -> DataFrame:
    means = df.groupBy(*by).agg(F.avg(x).alias("__m"))
    return df.join(F.broadcast(means) if not by else means, by or None).groupBy(*by).agg(F.avg(F.abs(F.col(x) - F.col("__m"))).alias("mean_deviation"))


def _ranked(df: DataFrame, by: list[str], x: str) -> DataFrame:
    part = ", ".join(f"`{b}`" for b in by) or "1"
    return df.where(F.col(x).isNotNull()).selectExpr("*", f"row_number() over (partition by {part} order by `{x}`) as __r", f"count(*) over (partition by {part}) as __n")


def trimmed_mean(df: DataFrame, by: list[str], x: str, left: int, right: int) -> DataFrame:
    """The mean without the `left` smallest and `right` largest values."""
    kept = _ranked(df, by, x).where((F.col("__r") > left) & (F.col("__r") <= F.col("__n") - right))
    return kept.groupBy(*by).agg(F.avg(x).alias("trimmed_mean"))


def winsorized_mean(df: DataFrame, by: list[str], x: str, left: int, right: int) -> DataFrame:
    """The mean with the `left` smallest and `right` largest values replaced by their inner neighbours."""
    ranked = _ranked(df, by, x)
    ends = ranked.groupBy(*by).agg(F.min(F.when(F.col("__r") == left + 1, F.col(x))).alias("__lo"), F.max(F.when(F.col("__r") == F.col("__n") - right, F.col(x))).alias("__hi"))
    return ranked.join(ends, by).groupBy(*by).agg(F.avg(F.least(F.greatest(F.col(x), "__lo"), "__hi")).alias("winsorized_mean"))


def rank_order(df: DataFrame, by: list[str], x: str, out: str = "mid_rank") -> DataFrame:
    """df with the rank of x within `by`, ties sharing their mean rank."""
    part = ", ".join(f"`{b}`" for b in by) or "1"
    return df.selectExpr("*", f"rank() over (partition by {part} order by `{x}`) + (count(*) over (partition by {part}, `{x}`) - 1) / 2D as `{out}`")


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    both = rank_order(rank_order(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), by, x, "__x"), by, y, "__y")
    return both.groupBy(*by).agg(_corr("__x", "__y").alias("spearman"))


def auto_correlation(df: DataFrame, by: list[str], order: str, x: str, lag: int) -> DataFrame:
    """Mean of the lagged products of deviations over n - lag, by the variance."""
    part = ", ".join(f"`{b}`" for b in by)
    moved = df.selectExpr("*", f"lag(`{x}`, {lag}) over (partition by {part} order by `{order}`) as __l", f"avg(`{x}`) over (partition by {part}) as __m")
    return moved.groupBy(*by).agg(_ratio(F.avg((F.col(x) - F.col("__m")) * (F.col("__l") - F.col("__m"))), F.var_pop(x)).alias("auto_correlation"))


def durbin_watson(df: DataFrame, by: list[str], order: str, x: str) -> DataFrame:
    part = ", ".join(f"`{b}`" for b in by)
    moved = df.selectExpr("*", f"lag(`{x}`) over (partition by {part} order by `{order}`) as __l")
    return moved.groupBy(*by).agg(_ratio(F.sum(F.pow(F.col(x) - F.col("__l"), 2)), F.sum(F.pow(F.col(x), 2))).alias("durbin_watson"))


def standardize(df: DataFrame, by: list[str], x: str, out: str = "z") -> DataFrame:
    """df with (x - mean) / (sqrt(n) * population deviation) within `by`."""
    s = df.groupBy(*by).agg(F.avg(x).alias("__m"), (F.sqrt(F.count(x)) * F.stddev_pop(x)).alias("__s"))
    return df.join(s, by).withColumn(out, _ratio(F.col(x) - F.col("__m"), F.col("__s"))).drop("__m", "__s")


def split(x: str, splitters: list[float]) -> Column:
    """The number of splitters at or below x."""
    return sum((F.when(F.col(x) >= s, 1).otherwise(0) for s in splitters), F.lit(0))


def _expected(df: DataFrame, row: str, column: str, n: str) -> DataFrame:
    """The table's cells, absent ones at 0, with the count that independence expects."""
    rows, columns = df.groupBy(row).agg(F.sum(n).alias("__a")), df.groupBy(column).agg(F.sum(n).alias("__b"))
    total = df.agg(F.sum(n).alias("__t"))
    # a cell for each row and column of the table itself
    full = rows.join(columns).join(F.broadcast(total))
    return full.join(df.groupBy(row, column).agg(F.sum(n).alias("__o")), [row, column], "left").select(F.coalesce("__o", F.lit(0)).alias("o"), (F.col("__a").cast("double") * F.col("__b") / F.col("__t")).alias("e"))


def chi_square(df: DataFrame, row: str, column: str, n: str) -> DataFrame:
    """Pearson's statistic of a table in long form."""
    return _expected(df, row, column, n).agg(F.sum(F.pow(F.col("o") - F.col("e"), 2) / F.col("e")).alias("chi_square"))


def likelihood_ratio(df: DataFrame, row: str, column: str, n: str) -> DataFrame:
    return _expected(df, row, column, n).agg((2 * F.sum(F.when(F.col("o") > 0, F.col("o") * F.ln(F.col("o") / F.col("e"))).otherwise(0))).alias("likelihood_ratio"))


def one_way(df: DataFrame, n: str) -> DataFrame:
    """(chi_square, log_likelihood, df) of counts against equal expectation."""
    total = df.agg((F.sum(n) / F.count(n)).alias("e"))
    cells = df.select(F.col(n).alias("o")).join(F.broadcast(total))
    return cells.agg(F.sum(F.pow(F.col("o") - F.col("e"), 2) / F.col("e")).alias("chi_square"), (2 * F.sum(F.when(F.col("o") > 0, F.col("o") * F.ln(F.col("o") / F.col("e"))).otherwise(0))).alias("log_likelihood"), (F.count("o") - 1).alias("df"))


def covariance_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, covariance, correlation) of all pairs; a correlation with a constant column is 0."""
    one = df.agg(*(f(x, y).alias(f"{k}|{x}|{y}") for x in columns for y in columns for k, f in (("v", F.covar_samp), ("r", _corr))))
    cells = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"v|{x}|{y}").alias("covariance"), F.coalesce(F.nanvl(F.col(f"r|{x}|{y}"), F.lit(0.0)), F.lit(0.0)).alias("correlation")) for x in columns for y in columns]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
