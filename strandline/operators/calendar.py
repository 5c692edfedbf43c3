"""Dated tables: events by month, gap completion, shifts, month ends, quarters, ranges and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import month_start


def complete_months(df: DataFrame, date: str = "date", by: list[str] | None = None) -> DataFrame:
    """Every month from the first to the last of each group, with nulls where df has no row."""
    by = by or []
    span = df.groupBy(*by).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    months = span.select(*by, F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 month"))).alias(date))
    return months.join(df, [*by, date], "left")


def events_by_month(events: DataFrame, ts: str, primary: str, second: str) -> DataFrame:
    """Events with a fallback for a null measure, summed by month over the whole calendar; empty months are zeros."""
    e = events.select(month_start(ts).alias("date"), F.col(primary).alias("p"), F.col(second).alias("s"))
    by = e.groupBy("date").agg(
        F.coalesce(F.sum(F.coalesce("p", "s")), F.lit(0.0)).alias("used_sum"),
        F.coalesce(F.sum("p"), F.lit(0.0)).alias("primary_sum"),
        F.coalesce(F.sum("s"), F.lit(0.0)).alias("second_sum"),
        F.bool_or(F.col("p").isNull()).alias("fallback_event"),
        F.count("*").alias("n_events"),
        F.count("p").alias("nonmissing_events"),
        F.count_if(F.col("p").isNull()).alias("missing_events"),
    )
    full = complete_months(by)
    zero = ["used_sum", "primary_sum", "second_sum"], ["n_events", "nonmissing_events", "missing_events"]
    out = full.na.fill(0.0, zero[0]).na.fill(0, zero[1]).na.fill(False, ["fallback_event"])
    return out.withColumn("mixed_events", (F.col("nonmissing_events") > 0) & (F.col("missing_events") > 0))


def keep_last(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by `order` (ascending)."""
    w = Window.partitionBy(*key).orderBy(*[o.desc() for o in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def month_end_last(df: DataFrame, day: str, value: str) -> DataFrame:
    """The last non-null observation of each month and its first difference."""
    last = df.filter(F.col(value).isNotNull()).groupBy(month_start(day).alias("date")).agg(F.max_by(value, day).alias("eom"))
    return last.withColumn("diff", F.col("eom") - F.lag("eom").over(Window.partitionBy(F.lit(0)).orderBy("date")))


def quarter_to_months(df: DataFrame, year: str, quarter: str) -> DataFrame:
    """Three rows for each quarter, one for each of its months."""
    first = F.make_date(F.col(year).cast("int"), (F.col(quarter) * 3 - 2).cast("int"), F.lit(1))
    return df.withColumn("date", F.explode(F.sequence(first, F.add_months(first, 2), F.expr("interval 1 month"))))


def indexed(df: DataFrame, by: list[str], order: str = "date") -> DataFrame:
    """t: the place in each group from 0, and n: the group's rows."""
    w = Window.partitionBy(*by)
    return df.withColumn("t", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count("*").over(w))


def circular_shift(df: DataFrame, value: str, k: int, by: list[str]) -> DataFrame:
    """value moved k rows on, the last rows coming round to the first."""
    moved = df.select(*by, ((F.col("t") + k) % F.col("n")).alias("t"), F.col(value).alias(f"{value}_shifted"))
    return df.join(moved, [*by, "t"])


def permuted(df: DataFrame, value: str, seed: int, by: list[str]) -> DataFrame:
    """value in a fixed order of places, that of a digest of (seed, t), as `placebo`."""
    w = Window.partitionBy(*by).orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("t").cast("string"))))
    order = df.withColumn("_n", F.row_number().over(w) - 1)
    return order.join(df.select(*by, F.col("t").alias("_n"), F.col(value).alias("placebo")), [*by, "_n"]).drop("_n")


def in_range_zero(df: DataFrame, value: str, source: DataFrame, date: str = "date") -> DataFrame:
    """Nulls become zero inside the source's own range of dates and stay null outside."""
    span = source.filter(F.col(value).isNotNull()).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    inside = F.col(date).between(F.col("_lo"), F.col("_hi"))
    return df.crossJoin(F.broadcast(span)).withColumn(value, F.when(inside, F.coalesce(value, F.lit(0.0)))).drop("_lo", "_hi")


def preferred_column(df: DataFrame, candidates: list[str], least: int = 12) -> DataFrame:
    """One row: the first candidate with at least `least` finite values, and all counts."""
    counts = df.agg(*[F.count(c).alias(c) for c in candidates])
    chosen = F.coalesce(*[F.when(F.col(c) >= least, F.lit(c)) for c in candidates])
    return counts.select(chosen.alias("preferred"), *[F.col(c).alias(f"n_{c}") for c in candidates])


def coverage(df: DataFrame, columns: list[str], date: str = "date") -> DataFrame:
    """For each column: the finite range, finite and missing counts, and the missing months inside the range as text."""
    long = df.select(date, F.explode(F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("x")) for c in columns])).alias("s")).select(date, "s.series", "s.x")
    span = long.groupBy("series").agg(
        F.min(F.when(F.col("x").isNotNull(), F.col(date))).alias("first_date"),
        F.max(F.when(F.col("x").isNotNull(), F.col(date))).alias("last_date"),
        F.count("x").alias("n_finite"),
        F.count_if(F.col("x").isNull()).alias("n_missing"),
    )
    gaps = long.filter(F.col("x").isNull()).join(span, "series").filter(F.col(date).between(F.col("first_date"), F.col("last_date")))
    text = gaps.groupBy("series").agg(F.array_join(F.array_sort(F.collect_list(F.date_format(date, "yyyy-MM"))), ", ").alias("gap_months"))
    return span.join(text, "series", "left").withColumn("gap_months", F.coalesce("gap_months", F.lit("")))


def fold_left(base: DataFrame, others: list[DataFrame], on: str = "date") -> DataFrame:
    """base left-joined with each of others."""
    return reduce(lambda a, b: a.join(b, on, "left"), others, base)
