"""Scalar, string, set and time helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# numbers
def are_equal(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return F.abs(a - b) <= eps


def safe_log(x: Column) -> Column:
    """ln x, and 0 at 0."""
    return F.when(x == 0, 0.0).otherwise(F.ln(x))


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("bigint")


def fuzzy_compare(a: Column, b: Column, eps: float) -> Column:
    """-1, 0 or 1, numbers within eps of the larger one's size being equal."""
    near = F.abs(a - b) <= eps * F.greatest(F.abs(a), F.abs(b))
    return F.when(near, 0).otherwise(F.signum(a - b).cast("int"))


def horner(coefficients: Column, x: Column) -> Column:
    """Value of the polynomial whose coefficients stand from the constant upwards."""
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda a, c: a * x + c)


def chebyshev(coefficients: Column, x: Column) -> Column:
    """Clenshaw's sum of a Chebyshev series, its constant halved."""
    start = F.struct(F.lit(0.0).alias("b0"), F.lit(0.0).alias("b1"), F.lit(0.0).alias("b2"))
    step = lambda s, c: F.struct((2 * x * s["b0"] - s["b1"] + c).alias("b0"), s["b0"].alias("b1"), s["b1"].alias("b2"))
    return F.aggregate(F.reverse(coefficients), start, step, lambda s: (s["b0"] - s["b2"]) / 2)


# random draws: expressions of one uniform column
def exponential(u: Column, rate: float) -> Column:
    return -F.ln(u) / rate


def cauchy(u: Column) -> Column:
    return F.tan(F.pi() * (u - 0.5))


def weibull(u: Column, shape: float, scale: float) -> Column:
    return scale * F.pow(-F.ln(u), 1 / shape)


def geometric(u: Column, p: float) -> Column:
    return F.ceil(F.ln(u) / F.ln(F.lit(1 - p)))


def triangular(u: Column, low: float, mode: float, high: float) -> Column:
    cut = (mode - low) / (high - low)
    return F.when(u < cut, low + F.sqrt(u * (high - low) * (mode - low))).otherwise(high - F.sqrt((1 - u) * (high - low) * (high - mode)))


# strings
def count_char(s: Column, c: str) -> Column:
    return F.length(s) - F.length(F.translate(s, c, ""))


def count_occurrences(s: Column, part: str) -> Column:
    return ((F.length(s) - F.length(F.replace(s, F.lit(part), F.lit("")))) / len(part)).cast("int")


def contains_whole_word(s: Column, word: str) -> Column:
    """Whether the word occurs between word boundaries, in any case."""
    return s.rlike(rf"(?i)\b\Q{word}\E\b")


def index_of_whole_word(s: Column, word: str) -> Column:
    """Its first place from 0, or -1."""
    return F.regexp_instr(s, F.lit(rf"(?i)\b\Q{word}\E\b")) - 1


def first_number(s: Column) -> Column:
    return F.regexp_extract(s, r"[-+]?[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")


def first_line(s: Column) -> Column:
    return F.split(s, "\n")[0]


def with_commas(n: Column) -> Column:
    return F.format_number(n, 0)


def from_commas(s: Column) -> Column:
    return F.replace(s, F.lit(","), F.lit("")).try_cast("bigint")


def zero_pad(n: Column, width: int) -> Column:
    """Digits filled up with zeros; longer ones stay whole."""
    s = n.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def delete_parenthesized(s: Column) -> Column:
    return F.regexp_replace(s, r"\([^()]*\)", "")


def only_parenthesized(s: Column) -> Column:
    return F.array_join(F.regexp_extract_all(s, F.lit(r"\(([^()]*)\)"), F.lit(1)), "")


def compress_repeats(s: Column, c: str) -> Column:
    return F.regexp_replace(s, rf"(\Q{c}\E)+", c)


def truncate(s: Column, n: int) -> Column:
    return F.when(F.length(s) > n, F.concat(F.left(s, F.lit(n)), F.lit("..."))).otherwise(s)


def upper_first(s: Column) -> Column:
    return F.concat(F.upper(F.left(s, F.lit(1))), s.substr(F.lit(2), F.length(s)))


def without_brackets(s: Column) -> Column:
    return F.regexp_replace(s, r"^[(\[{](.*)[)\]}]$", "$1")


def yes_no(b: Column) -> Column:
    return F.when(b, "yes").otherwise("no")


def pluralize(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, one).otherwise(many)


# sets of whole numbers, as sorted arrays
def int_range(low: Column, high: Column) -> Column:
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def intersect(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def complement(a: Column, low: Column, high: Column) -> Column:
    """The numbers from low to high that `a` lacks."""
    return F.array_except(int_range(low, high), a)


# time
def duration(seconds: Column) -> Column:
    """h:mm:ss."""
    return F.concat((seconds / 3600).cast("bigint").cast("string"), F.lit(":"), zero_pad((seconds / 60).cast("bigint") % 60, 2), F.lit(":"), zero_pad(seconds.cast("bigint") % 60, 2))


def clear_time(ts: Column) -> Column:
    return F.date_trunc("day", ts)


def http_date(ts: Column) -> Column:
    """Of a timestamp read in UTC."""
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
