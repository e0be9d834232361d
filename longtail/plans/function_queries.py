"""Registered queries of the function library, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions import special, statistics as st

DIGITS = 6


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("p"))


def _round(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c, t in df.dtypes if t == "double"})


def stats_descriptive(spark, d):
    x = "q"
    return _round(_lines(spark, d).groupBy("l_returnflag").agg(
        st.geometric_mean(x).alias("geometric_mean"), st.harmonic_mean(x).alias("harmonic_mean"), st.rms(x).alias("rms"), st.sum_of_powers(x, 3).alias("cubes"), st.moment(x, 2, 25.0).alias("moment"),
        st.quantile(x, 0.3).alias("quantile"), st.standard_error(x).alias("standard_error"), st.sum_of_inversions(x).alias("inversions"), st.sample_skew(x).alias("sample_skew"), st.excess_kurtosis(x).alias("kurtosis"),
        st.weighted_mean(x, "p").alias("weighted_mean"), st.sample_standard_deviation(x).alias("sample_sd"), F.covar_samp("q", "p").alias("covariance"), F.corr("q", "p").alias("correlation"),
    ))


def stats_ordered(spark, d):
    x = _lines(spark, d)
    by = ["l_returnflag"]
    return _round(st.trimmed_mean(x, by, "q", 50, 80).join(st.winsorized_mean(x, by, "q", 50, 80), by).join(st.mean_deviation(x, by, "q"), by).join(st.spearman(x, by, "q", "p"), by))


def stats_tests(spark, d):
    cells = _lines(spark, d).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    chi = st.chi_square(cells, "l_returnflag", "l_linestatus", "n").join(st.likelihood_ratio(cells, "l_returnflag", "l_linestatus", "n"))
    flags = cells.groupBy("l_returnflag").agg(F.sum("n").alias("n"))
    return _round(chi.join(st.one_way(flags, "n").select(F.col("chi_square").alias("one_way"), "log_likelihood", "df")))


def special_functions(spark, d):
    x = _lines(spark, d).select("q").distinct()
    return _round(x.select("q", special.udf("log_gamma")(F.col("q")).alias("log_gamma"), special.udf("log_factorial")(F.col("q")).alias("log_factorial"), special.udf("chisquare")(F.col("q"), F.lit(2.0)).alias("chisquare"), special.udf("t")(F.col("q") / 10, F.lit(2.0)).alias("t")))


def scalar_functions(spark, d):
    s = F.col("p_name")
    return spark.read.parquet(f"{d}/part.parquet").select(
        "p_partkey", sc.count_char(s, "a").alias("n_a"), sc.upper_first(s).alias("upper"), sc.truncate(s, 5).alias("short"), sc.zero_pad(F.col("p_partkey"), 8).alias("padded"), sc.duration(F.col("p_partkey") * 37).alias("duration"),
        F.array_join(sc.intersect(sc.int_range(F.lit(1), F.col("p_size")), sc.int_range(F.lit(5), F.lit(9))), ",").alias("meet"), F.round(sc.horner(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.col("p_size") / 10), DIGITS).alias("polynomial"), sc.yes_no(F.col("p_size") > 20).alias("large"),
    )


def stats_more(spark, d):
    x = "q"
    n = F.count(x)
    return _round(_lines(spark, d).groupBy("l_returnflag").agg(
        st.sample_kurtosis(x).alias("sample_kurtosis"), st.sample_weighted_variance(x, "l_linenumber").alias("weighted_variance"), st.sum_of_power_deviations(x, 3, 25.0).alias("deviations"), st.sum_of_squared_deviations(x).alias("squares"),
        st.sum_of_logarithms(x).alias("logarithms"), F.element_at(st.quantiles(x, [0.25, 0.75]), 2).alias("upper_quartile"), st.sample_skew_standard_error(n).alias("skew_error"), st.sample_kurtosis_standard_error(n).alias("kurtosis_error"),
        F.sum(st.split(x, [10.0, 20.0, 30.0])).cast("bigint").alias("bins"), st.pooled_mean(n, F.avg(x), F.lit(100), F.lit(7.0)).alias("pooled_mean"), st.pooled_variance(n, F.var_pop(x), F.lit(100), F.lit(7.0)).alias("pooled_variance"),
    ))


def stats_series(spark, d):
    """Of each order's lines, in their order; l_linenumber may repeat, so quantities are summed by it first."""
    x = _lines(spark, d).where("l_orderkey % 10 = 3").groupBy("l_orderkey", "l_linenumber").agg(F.sum("q").alias("q"))
    by = ["l_orderkey"]
    z = st.standardize(x, by, "q").groupBy(*by).agg(F.sum(F.pow("z", 2)).alias("z_squares"))
    return _round(st.auto_correlation(x, by, "l_linenumber", "q", 1).join(st.durbin_watson(x, by, "l_linenumber", "q"), by).join(z, by))


def stats_merged(spark, d):
    """Partial rows by flag and status, merged by flag; and how often each quantity occurs, as the largest count."""
    x = _lines(spark, d)
    part = x.groupBy("l_returnflag", "l_linestatus").agg(F.count("q").alias("n"), F.min("q").alias("low"), F.max("q").alias("high"), F.sum("q").alias("total"), F.sum(F.col("q") * F.col("q")).alias("squares"))
    most = st.frequencies(x, "q").agg(F.max("n").alias("most"))
    return _round(st.merged(part, ["l_returnflag"]).join(F.broadcast(most)))


def stats_matrix(spark, d):
    return _round(st.covariance_matrix(_lines(spark, d).select("q", "p", F.lit(1.0).alias("one")), ["q", "p", "one"]))


def special_more(spark, d):
    """Functions where a closed form exists, and inverses after their functions; v lies in (0, 1)."""
    u = lambda name, *c: special.udf(name)(*c)
    q, v, two = F.col("q"), F.col("v"), F.lit(2.0)
    x = _lines(spark, d).select("q", (F.col("q") / 51).alias("v")).distinct()
    return _round(x.select(
        "q", u("gamma", v + 1).alias("gamma"), u("incomplete_gamma", F.lit(1.0), v).alias("incomplete_gamma"), u("incomplete_beta", v, two, F.lit(1.0)).alias("incomplete_beta"), u("incomplete_beta_inverse", v, two, F.lit(1.0)).alias("incomplete_beta_inverse"),
        u("log_beta", q, F.lit(1.0)).alias("log_beta"), u("beta", q, two).alias("beta"), u("factorial", q % 15).alias("factorial"), u("binomial", q, two).alias("binomial"), u("erf", u("erf_inverse", v)).alias("erf"), u("erfc", u("erf_inverse", v)).alias("erfc"),
        u("normal", u("normal_inverse", v)).alias("normal"), u("chisquare_inverse", v, two).alias("chisquare_inverse"), u("f", v, two, two).alias("f"), u("f_inverse", v, two, two).alias("f_inverse"), u("t_inverse", v, two).alias("t_inverse"),
        u("spearman_significance", v, F.lit(4.0)).alias("spearman"), special.sidak(v, q).alias("sidak"), special.bonferroni(v, q).alias("bonferroni"),
    ))


def scalar_more(spark, d):
    s, k, n, u = F.col("p_name"), F.col("p_partkey"), F.col("p_size"), (F.col("p_size") / 51)
    one, nine = F.lit(5), F.lit(9)
    marked = F.concat(F.lit("("), s, F.lit(")"), F.lit("\n"), k.cast("string"))
    sets = lambda a: F.array_join(a, ",")
    return _round(spark.read.parquet(f"{d}/part.parquet").select(
        "p_partkey", sc.are_equal(u * 51, n.cast("double"), 1e-9).alias("equal"), sc.safe_log(n.cast("double")).alias("log"), sc.trunc(-u * 10).alias("trunc"), sc.fuzzy_compare(n.cast("double"), F.lit(25.0), 0.05).alias("compared"),
        sc.chebyshev(F.array(two := F.lit(2.0), two, two), u).alias("chebyshev"), sc.exponential(u, 2.0).alias("exponential"), sc.cauchy(u).alias("cauchy"), sc.weibull(u, 2.0, 3.0).alias("weibull"), sc.geometric(u, 0.25).cast("bigint").alias("geometric"),
        sc.triangular(u, 0.0, 1.0, 4.0).alias("triangular"), sc.count_occurrences(s, "in").alias("occurrences"), sc.contains_whole_word(s, "RING").alias("whole"), sc.index_of_whole_word(s, "ring").alias("place"), sc.first_number(F.concat(s, n.cast("string"))).alias("number"),
        sc.first_line(marked).alias("first_line"), sc.with_commas(k * 1000).alias("commas"), sc.from_commas(sc.with_commas(k * 1000)).alias("plain"), sc.delete_parenthesized(F.concat(marked, s)).alias("outside"), sc.only_parenthesized(marked).alias("inside"),
        sc.compress_repeats(F.concat(F.lit("--"), s), "-").alias("compressed"), sc.without_brackets(sc.first_line(marked)).alias("bare"), sc.pluralize(n, "part", "parts").alias("plural"), sets(sc.union(sc.int_range(F.lit(1), n), sc.int_range(one, nine))).alias("either"),
        sets(sc.difference(sc.int_range(one, nine), sc.int_range(F.lit(1), n))).alias("rest"), sets(sc.complement(sc.int_range(one, n), F.lit(1), nine)).alias("lacking"),
        F.date_format(sc.clear_time(F.timestamp_seconds(k * 86_461)), "yyyy-MM-dd HH:mm:ss").alias("day"), sc.http_date(F.timestamp_seconds(k * 86_461)).alias("http"),
    ))


QUERIES = (stats_descriptive, stats_ordered, stats_tests, special_functions, scalar_functions, stats_more, stats_series, stats_merged, stats_matrix, special_more, scalar_more)


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    lines = "with x as (select l_returnflag, l_linestatus, l_quantity::double as q, l_extendedprice::double as p from lineitem)"
    ranked = "r as (select *, row_number() over (partition by l_returnflag order by q) as r, count(*) over (partition by l_returnflag) as n, avg(q) over (partition by l_returnflag) as m, rank() over (partition by l_returnflag order by q) + (count(*) over (partition by l_returnflag, q) - 1) / 2.0 as rq, rank() over (partition by l_returnflag order by p) + (count(*) over (partition by l_returnflag, p) - 1) / 2.0 as rp from x)"
    return {
        "stats_descriptive": lines + """ select l_returnflag, round(exp(avg(ln(q))), 6) as geometric_mean, round(count(q) / sum(1 / q), 6) as harmonic_mean, round(sqrt(avg(q * q)), 6) as rms, round(sum(q * q * q), 6) as cubes, round(avg((q - 25) * (q - 25)), 6) as moment,
round(quantile_cont(q, 0.3), 6) as quantile, round(sqrt(var_samp(q) / count(q)), 6) as standard_error, round(sum(1 / q), 6) as inversions, round(skewness(q), 6) as sample_skew, round(kurtosis_pop(q), 6) as kurtosis, round(sum(q * p) / sum(p), 6) as weighted_mean,
round(stddev_samp(q) * (1 + 1 / (4.0 * (count(q) - 1))), 6) as sample_sd, round(covar_samp(q, p), 6) as covariance, round(corr(q, p), 6) as correlation from x group by l_returnflag""",
        "stats_ordered": lines + ", " + ranked + """, e as (select l_returnflag, min(case when r = 51 then q end) as lo, max(case when r = n - 80 then q end) as hi from r group by l_returnflag)
select l_returnflag, round(avg(case when r > 50 and r <= n - 80 then q end), 6) as trimmed_mean, round(avg(least(greatest(q, lo), hi)), 6) as winsorized_mean, round(avg(abs(q - m)), 6) as mean_deviation, round(corr(rq, rp), 6) as spearman from r join e using (l_returnflag) group by l_returnflag""",
        "stats_tests": lines + """, c as (select l_returnflag as a, l_linestatus as b, count(*) as n from x group by 1, 2), ra as (select a, sum(n) as na from c group by a), rb as (select b, sum(n) as nb from c group by b), t as (select sum(n) as nt from c),
f as (select coalesce(c.n, 0) as o, na * nb / nt::double as e from ra cross join rb cross join t left join c on c.a = ra.a and c.b = rb.b), w as (select na as o, nt / (select count(*) from ra)::double as e from ra cross join t)
select (select round(sum((o - e) * (o - e) / e), 6) from f) as chi_square, (select round(2 * sum(case when o > 0 then o * ln(o / e) else 0 end), 6) from f) as likelihood_ratio, (select round(sum((o - e) * (o - e) / e), 6) from w) as one_way, (select round(2 * sum(o * ln(o / e)), 6) from w) as log_likelihood, (select count(*) - 1 from ra)::bigint as df""",
        "stats_more": """with x as (select l_returnflag, l_linenumber::double as w, l_quantity::double as q from lineitem), a as (select l_returnflag, count(q)::double as n, avg(q) as m, var_pop(q) as v, kurtosis_pop(q) as k, sum(w) as sw, sum(w * q) as swx, sum(w * q * q) as swxx,
sum(pow(q - 25, 3)) as cubes, sum(ln(q)) as ln, quantile_cont(q, 0.75) as up, sum(case when q >= 30 then 3 when q >= 20 then 2 when q >= 10 then 1 else 0 end)::bigint as bins from x group by l_returnflag)
select l_returnflag, round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6), 6) as sample_kurtosis, round((swxx - swx * swx / sw) / (sw - 1), 6) as weighted_variance, round(cubes, 6) as deviations, round(v * n, 6) as squares, round(ln, 6) as logarithms, round(up, 6) as upper_quartile,
round(sqrt(6 * n * (n - 1) / ((n - 2) * (n + 1) * (n + 3))), 6) as skew_error, round(sqrt(24 * n * (n - 1) * (n - 1) / ((n - 3) * (n - 2) * (n + 3) * (n + 5))), 6) as kurtosis_error, bins, round((n * m + 700) / (n + 100), 6) as pooled_mean, round((n * v + 700) / (n + 100), 6) as pooled_variance from a""",
        "stats_series": """with x as (select l_orderkey, l_linenumber, sum(l_quantity::double) as q from lineitem where l_orderkey % 10 = 3 group by 1, 2), y as (select *, lag(q) over w as l, avg(q) over (partition by l_orderkey) as m from x window w as (partition by l_orderkey order by l_linenumber))
select l_orderkey, round(avg((q - m) * (l - m)) / nullif(var_pop(q), 0), 6) as auto_correlation, round(sum((q - l) * (q - l)) / sum(q * q), 6) as durbin_watson, case when var_pop(q) = 0 then null else 1.0::double end as z_squares from y group by l_orderkey""",
        "stats_merged": lines + " select l_returnflag, count(q) as n, min(q) as low, max(q) as high, sum(q) as total, sum(q * q) as squares, (select max(n) from (select count(*) as n from x group by q)) as most from x group by l_returnflag",
        "stats_matrix": lines + """, c as (select unnest(['q', 'p', 'one']) as a), v as (select *, 1.0::double as one from x), m as (select covar_samp(q, q) as qq, covar_samp(q, p) as qp, covar_samp(p, p) as pp, corr(q, p) as r from v)
select c.a, e.a as b, case when 'one' in (c.a, e.a) then 0 when c.a != e.a then round(qp, 6) when c.a = 'q' then round(qq, 6) else round(pp, 6) end as covariance, case when 'one' in (c.a, e.a) then 0 when c.a = e.a then 1 else round(r, 6) end as correlation from c cross join c e cross join m""",
        "special_more": """with x as (select distinct l_quantity::double as q, l_quantity::double / 51 as v from lineitem) select q, round(gamma(v + 1), 6) as gamma, round(1 - exp(-v), 6) as incomplete_gamma, round(v * v, 6) as incomplete_beta, round(sqrt(v), 6) as incomplete_beta_inverse, round(0 - ln(q), 6) as log_beta,
round(1 / (q * (q + 1)), 6) as beta, round(factorial((q % 15)::int)::double, 6) as factorial, q * (q - 1) / 2 as binomial, round(v, 6) as erf, round(1 - v, 6) as erfc, round(v, 6) as normal, round(-2 * ln(v), 6) as chisquare_inverse, round(1 / (1 + v), 6) as f, round((1 - v) / v, 6) as f_inverse,
round(sqrt(2 * (1 - v) * (1 - v) / (1 - (1 - v) * (1 - v))), 6) as t_inverse, round(1 - v, 6) as spearman, round(1 - pow(1 - v, 1 / q), 6) as sidak, round(v / q, 6) as bonferroni from x""",
        "scalar_more": r"""with x as (select *, p_size / 51.0::double as u from part) select p_partkey, true as equal, round(ln(p_size), 6) as log, trunc(-u * 10)::bigint as trunc, case when abs(p_size - 25) <= 0.05 * greatest(p_size, 25) then 0 when p_size < 25 then -1 else 1 end::int as compared,
round(1 + 2 * u + 2 * (2 * u * u - 1), 6) as chebyshev, round(-ln(u) / 2, 6) as exponential, round(tan(pi() * (u - 0.5)), 6) as cauchy, round(3 * sqrt(-ln(u)), 6) as weibull, ceil(ln(u) / ln(0.75))::bigint as geometric, round(case when u < 0.25 then sqrt(u * 4) else 4 - sqrt((1 - u) * 12) end, 6) as triangular,
((len(p_name) - len(replace(p_name, 'in', ''))) // 2)::int as occurrences, regexp_matches(p_name, '\bring\b') as whole, case when regexp_matches(p_name, '\bring\b') then strpos(p_name, 'ring') - 1 else -1 end::int as place, p_size::double as number, '(' || p_name || ')' as first_line, format('{:,}', p_partkey * 1000) as commas, p_partkey * 1000 as plain,
chr(10) || p_partkey || p_name as outside, p_name as inside, '-' || p_name as compressed, p_name as bare, case when p_size = 1 then 'part' else 'parts' end as plural, array_to_string([i for i in range(1, 51) if i <= p_size or i between 5 and 9], ',') as either,
array_to_string([i for i in range(5, 10) if i > p_size], ',') as rest, array_to_string([i for i in range(1, 10) if i < 5 or i > p_size], ',') as lacking, strftime(make_timestamp(p_partkey * 86461 // 86400 * 86400000000), '%Y-%m-%d %H:%M:%S') as day, strftime(make_timestamp(p_partkey * 86461000000), '%a, %d %b %Y %H:%M:%S GMT') as http from x""",
        "special_functions": lines + " select distinct q, round(lgamma(q), 6) as log_gamma, round(lgamma(q + 1), 6) as log_factorial, round(exp(-q / 2), 6) as chisquare, round(1 - (q / 10) / sqrt(2 + q * q / 100), 6) as t from x",
        "scalar_functions": """select p_partkey, (len(p_name) - len(replace(p_name, 'a', '')))::int as n_a, upper(p_name[1]) || p_name[2:] as upper, case when len(p_name) > 5 then p_name[1:5] || '...' else p_name end as short, lpad(p_partkey::varchar, 8, '0') as padded,
(p_partkey * 37 // 3600) || ':' || lpad((p_partkey * 37 // 60 % 60)::varchar, 2, '0') || ':' || lpad((p_partkey * 37 % 60)::varchar, 2, '0') as duration, array_to_string([i for i in range(5, 10) if i <= p_size], ',') as meet,
round(1 + 2 * (p_size / 10) + 3 * (p_size / 10) * (p_size / 10), 6) as polynomial, case when p_size > 20 then 'yes' else 'no' end as large from part""",
    }
