"""Column functions: dates, nulls, slugs and decay rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def month_start(d: Column | str) -> Column:
    return F.trunc(col(d), "MM")


def month_from_parts(year: Column | str, month: Column | str) -> Column:
    return F.make_date(col(year).cast("int"), col(month).cast("int"), F.lit(1))


def month_number(d: Column | str) -> Column:
    """12 * year + month, which differs by one between neighbouring months."""
    return 12 * F.year(col(d)) + F.month(col(d))


def excel_date(serial: Column | str) -> Column:
    return F.date_add(F.lit("1899-12-30").cast("date"), col(serial).cast("int"))


def null_if_nan(x: Column | str) -> Column:
    """NaN, which sources write for a missing value, as null; other values as doubles, text that is no number as null."""
    v = col(x).try_cast("double")
    return F.when(~F.isnan(v), v)


def plain_zero(x: Column | str) -> Column:
    """Minus zero as zero."""
    return col(x) + F.lit(0.0)


def log100(x: Column | str) -> Column:
    """100 times the natural logarithm; null where that isn't finite."""
    return F.when(col(x) > 0, 100 * F.log(col(x)))


def fallback(first: Column | str, second: Column | str) -> Column:
    return F.coalesce(col(first), col(second))


def half_life_decay(half_life: Column | str) -> Column:
    """0.5^(1/h); a null half-life never decays."""
    return F.when(col(half_life).isNull(), F.lit(1.0)).otherwise(F.pow(F.lit(0.5), 1.0 / col(half_life)))


def half_life_label(half_life: Column | str) -> Column:
    return F.when(col(half_life).isNull(), F.lit("inf")).otherwise(F.format_string("%g", col(half_life).cast("double")))


def slug(x: Column | str) -> Column:
    """Lower case, every run of other characters than letters and digits one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def rounded(x: Column | str, digits: int = 6) -> Column:
    return F.round(col(x), digits) + F.lit(0.0)
