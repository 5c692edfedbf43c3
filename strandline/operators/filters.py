"""Ordered filters over long series (key.., t, x) and ranks, folds and episodes along a path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import average_rank
from .scans import decayed, ewma  # noqa: F401


def _w(key: list[str]):
    return Window.partitionBy(*key).orderBy("t")


def bartlett(df: DataFrame, value: str, key: list[str], lag: int, mode: str = "drop") -> DataFrame:
    """sum of the last lag + 1 values over sqrt(lag + 1). At the start: "drop" the first rows, "zero" scale as if
    complete, "available" scale by the root of what is there."""
    over = _w(key).rowsBetween(-lag, 0)
    n = F.count("*").over(over)
    scale = F.sqrt(n) if mode == "available" else F.lit(float((lag + 1) ** 0.5))
    out = df.withColumn("filtered", F.sum(value).over(over) / scale).withColumn("_n", n)
    return (out.filter(F.col("_n") == lag + 1) if mode == "drop" else out).drop("_n")


def exponential(df: DataFrame, value: str, key: list[str], half_life: float) -> DataFrame:
    """sum over s <= t of a^(t-s) x_s with a = 0.5^(1/half_life), as (key.., t, filtered)."""
    return decayed(df.select(*key, "t", value), value, key, half_life).drop(value)


def cumulative(df: DataFrame, value: str, key: list[str]) -> DataFrame:
    """Running sum and its share of the total."""
    running = F.sum(value).over(_w(key).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("running", running).withColumn("running_share", running / F.sum(value).over(Window.partitionBy(*key)))


def percentile_rank(df: DataFrame, value: str, key: list[str], name: str = "pct") -> DataFrame:
    """Average rank over the count."""
    n = df.groupBy(*key).agg(F.count("*").alias("_n"))
    return average_rank(df, value, key, "_r").join(n, key).withColumn(name, F.col("_r") / F.col("_n")).drop("_r", "_n")


def driver_labels(df: DataFrame, first: str, second: str, margin: float = 0.10, high: float = 0.75) -> DataFrame:
    """Which of two percentile ranks leads by more than `margin` (three labels), and the quadrant at `high` (four)."""
    d = F.col(first) - F.col(second)
    lead = F.when(d > margin, "first").when(d < -margin, "second").otherwise("balanced")
    a, b = F.col(first) >= high, F.col(second) >= high
    return df.withColumn("driver", lead).withColumn("quadrant", F.when(a & b, "both").when(a, "first_only").when(b, "second_only").otherwise("neither"))


def episodes(df: DataFrame, flag: str, key: list[str], value: str, label: str) -> DataFrame:
    """Runs of consecutive flagged places: first and last t, length, maximum, its place, median and dominant label: the
    label at the maximum if no other is more frequent, else the most frequent (smallest name on ties)."""
    on = df.filter(F.col(flag)).withColumn("island", F.col("t") - F.row_number().over(_w(key)))
    by = [*key, "island"]
    counts = on.groupBy(*by, label).agg(F.count("*").alias("n"))
    top = counts.groupBy(*by).agg(F.max("n").alias("most"), F.min(F.struct((-F.col("n")).alias("m"), F.col(label))).alias("first"))
    agg = on.groupBy(*by).agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("length"), F.max(value).alias("peak"), F.min_by("t", F.struct(-F.col(value), F.col("t"))).alias("peak_t"), F.percentile(value, F.lit(0.5)).alias("median"), F.min_by(label, F.struct(-F.col(value), F.col("t"))).alias("peak_label"))
    at_peak = counts.select(*by, F.col(label).alias("peak_label"), F.col("n").alias("peak_n"))
    out = agg.join(top, by).join(at_peak, [*by, "peak_label"], "left")
    dominant = F.when(F.col("peak_n") == F.col("most"), F.col("peak_label")).otherwise(F.col(f"first.{label}"))
    return out.select(*key, "start_t", "end_t", "length", "peak", "peak_t", "median", dominant.alias("dominant"))


def spaced_top(df: DataFrame, value: str, key: list[str], k: int, gap: int) -> DataFrame:
    """The k largest values at least `gap` places apart, chosen greedily from the largest down (ties: earlier first).

    Greedy choice looks back at what it has chosen, so it runs over the sorted values of each key as one fold.
    """
    rows = F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("m"), F.col("t"))))
    fold = f"aggregate(rows, CAST(array() AS ARRAY<STRUCT<m: DOUBLE, t: INT>>), (a, r) -> IF(size(a) < {k} AND forall(a, x -> abs(x.t - r.t) >= {gap}), array_append(a, named_struct('m', r.m, 't', r.t)), a))"
    return df.withColumn("t", F.col("t").cast("int")).groupBy(*key).agg(rows.alias("rows")).select(*key, F.posexplode(F.expr(fold))).select(*key, (F.col("pos") + 1).alias("rank"), F.col("col.t").alias("t"), (-F.col("col.m")).alias(value))


def time_folds(df: DataFrame, key: list[str], folds: int) -> DataFrame:
    """Contiguous folds of the places: edges at floor(i * n / folds)."""
    n = F.count("*").over(Window.partitionBy(*key))
    return df.withColumn("fold", F.floor(((F.row_number().over(_w(key))) * folds - 1) / n).cast("long"))


def volterra_level_one(df: DataFrame, value: str, key: list[str], half_lives: list[float]) -> DataFrame:
    """Level-1 features of a fading-memory signature: one exponential state for each half-life."""
    parts = [exponential(df, value, key, h).withColumn("half_life", F.lit(float(h))) for h in half_lives]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fold_moments(df: DataFrame, value: str, key: list[str], fold: str = "fold") -> DataFrame:
    """(key.., fold, n_test, mean_test, n_train, mean_train, var_train): of each fold and of everything else in its key. df is
    read once: what is not in a fold is the total less the fold, in sums about the key's mean."""
    centre = df.groupBy(*key).agg(F.avg(value).alias("_mean"))
    d = F.col(value) - F.col("_mean")
    own = df.join(centre, key).groupBy(*key, fold).agg(F.first("_mean").alias("_mean"), F.count(value).alias("n_test"), F.sum(d).alias("_s"), F.sum(d * d).alias("_q"))
    over = Window.partitionBy(*key)
    n, s, q = (F.sum(c).over(over) - F.col(c) for c in ("n_test", "_s", "_q"))
    out = own.withColumn("n_train", n).withColumn("_ts", s).withColumn("_tq", q)
    some = F.when(F.col("n_train") > 0, F.col("n_train"))
    mean = F.col("_ts") / some
    return out.select(*key, fold, "n_test", (F.col("_mean") + F.col("_s") / F.nullif(F.col("n_test"), F.lit(0))).alias("mean_test"), "n_train", (F.col("_mean") + mean).alias("mean_train"), (F.col("_tq") / some - mean * mean).alias("var_train"))
