"""Decaying recursions over long series, for series of any length.

The state of s_t = a^(t - t') s_t' + x_t, t' being the row before, is a scan of affine maps. It runs in two passes over
chunks of time: within a chunk, of 30 half-lives, a running sum of x scaled by 2^(age / half-life), which stays in a
double's range; then each chunk's total, one row, is carried to the two chunks after it. What is older than those has lost
60 halvings or more, which is below a double's resolution. So a series fills as many tasks as it has chunks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Half-lives in a chunk, and the chunks a total is carried over.
_SPAN, _CARRY = 30, 2


def _length(half_life: float) -> int:
    return max(1, math.ceil(_SPAN * half_life))


def decayed(df: DataFrame, value: str, key: list[str], half_life: float, name: str = "filtered") -> DataFrame:
    """df(key.., t, value) with the sum over s <= t of 0.5^((t - s) / half_life) x_s. t are whole numbers, gaps count with
    their length; rows that share key and t are summed up, a null adds nothing. An empty table gives no rows."""
    if half_life <= 0:
        raise ValueError("half-lives must be positive")
    n = _length(half_life)
    by = [*key, "_chunk"]
    rows = df.withColumn("_chunk", F.floor(F.col("t") / n)).withColumn("_age", F.col("t") - F.col("_chunk") * n)
    grown = F.col(value) * F.pow(F.lit(2.0), F.col("_age") / half_life)
    rows = rows.withColumn("_local", F.sum(grown).over(Window.partitionBy(*by).orderBy("t")))
    totals = df.withColumn("_chunk", F.floor(F.col("t") / n)).groupBy(*by).agg(F.sum(F.col(value) * F.pow(F.lit(2.0), (F.col("t") - F.col("_chunk") * n) / half_life)).alias("_total"))
    over = F.explode(F.array(*[F.lit(d) for d in range(1, _CARRY + 1)]))
    carried = totals.withColumn("_over", over).withColumn("_chunk", F.col("_chunk") + F.col("_over"))
    carried = carried.groupBy(*by).agg(F.sum(F.col("_total") * F.pow(F.lit(2.0), -F.col("_over") * n / half_life)).alias("_carried"))
    state = (F.coalesce("_local", F.lit(0.0)) + F.coalesce("_carried", F.lit(0.0))) * F.pow(F.lit(2.0), -F.col("_age") / half_life)
    return rows.join(carried, by, "left").select(*[F.col(c) for c in df.columns], state.alias(name))


def previous(df: DataFrame, value: str, key: list[str], name: str, length: int = 4096) -> DataFrame:
    """df with the value of the row before by t, null for the first: within chunks of time, and from the last row of the
    chunk before, of which there is one row for each chunk."""
    by = [*key, "_chunk"]
    rows = df.withColumn("_chunk", F.floor(F.col("t") / length))
    last = rows.groupBy(*by).agg(F.max_by(value, "t").alias("_last"))
    ends = last.withColumn("_last", F.lag("_last").over(Window.partitionBy(*key).orderBy("_chunk")))
    inside = Window.partitionBy(*by).orderBy("t")
    told = F.when(F.row_number().over(inside) > 1, F.lag(value).over(inside)).otherwise(F.col("_last"))
    return rows.join(ends, by).withColumn(name, told).drop("_chunk", "_last")


def ewma(df: DataFrame, value: str, key: list[str], half_life: float | None) -> DataFrame:
    """The causal mean m_t = a m_{t-1} + (1 - a) x_t from m = 0, before and after seeing x_t; without a half-life a = 1
    and the mean stays zero."""
    if half_life is None:
        return df.select(*key, "t", F.lit(0.0).alias("before"), F.lit(0.0).alias("after"))
    a = 0.5 ** (1.0 / half_life)
    after = decayed(df, value, key, half_life).select(*key, "t", ((1 - a) * F.col("filtered")).alias("after"))
    return previous(after, "after", key, "before").withColumn("before", F.coalesce("before", F.lit(0.0)))


def _pairs(x: DataFrame, y: DataFrame, key: list[str], left: Column, right: Column, condition: Column | None = None) -> DataFrame:
    both = x.alias("x").join(y.alias("y"), [*key, "t"])
    both = both.filter(condition) if condition is not None else both
    return both.select(*key, "t", F.col("x.k").alias("i"), F.col("y.k").alias("j"), (left * right).alias("x"))


def ewma_covariance(df: DataFrame, value: str, key: list[str], mean_half_life: float | None, cov_half_life: float, start: int) -> DataFrame:
    """(key.., t, i, j, before, after) for coordinates i <= j of df(key.., t, k, value) and t >= start: the covariance of
    e_t = x_t - m_{t-1}, K_t = a K_{t-1} + (1 - a) e_t e_t', before and after e_t is seen, from K = the mean of e e' over
    t < start. So `before` knows nothing of t or later. Every t has all coordinates, and t has no gaps."""
    mean = ewma(df, value, [*key, "k"], mean_half_life)
    e = df.join(mean, [*key, "k", "t"]).select(*key, "t", "k", (F.col(value) - F.col("before")).alias("e"))
    products = _pairs(e, e, key, F.col("x.e"), F.col("y.e"), F.col("x.k") <= F.col("y.k"))
    first = products.filter(F.col("t") < start).groupBy(*key, "i", "j").agg(F.avg("x").alias("first"))
    a = 0.5 ** (1.0 / cov_half_life)
    moved = decayed(products.filter(F.col("t") >= start), "x", [*key, "i", "j"], cov_half_life).join(first, [*key, "i", "j"])
    after = F.pow(F.lit(a), F.col("t") - start + 1) * F.col("first") + (1 - a) * F.col("filtered")
    return moved.select(*key, "t", "i", "j", ((after - (1 - a) * F.col("x")) / a).alias("before"), after.alias("after"))


def signature(df: DataFrame, value: str, key: list[str], half_lives: list[float], level: int = 3) -> DataFrame:
    """Fading-memory signature of the path df(key.., t, k, value) as long rows (key.., t, half_life, level, i, j, l,
    filtered), j and l null where the level has none.

    Level 1 is the decayed sum of x(i). The terms of level 2 are what level 1 holds from before times x(j), those of level
    3 what level 2 holds from before times x(l), and each level is the decayed sum of its terms: three scans, one after the
    other. What a sum holds from before is itself less its newest term. Every t has all coordinates.
    """
    if level not in (1, 2, 3):
        raise ValueError("levels 1 to 3")
    out, none = [], F.lit(None).cast(df.schema["k"].dataType)
    x = df.select(*key, "t", "k", F.col(value).alias("x"))
    for half_life in half_lives:
        tag = F.lit(float(half_life)).alias("half_life")
        h1 = decayed(x, "x", [*key, "k"], half_life)
        out.append(h1.select(*key, "t", tag, F.lit(1).alias("level"), F.col("k").alias("i"), none.alias("j"), none.alias("l"), "filtered"))
        if level >= 2:
            u2 = _pairs(h1.withColumn("held", F.col("filtered") - F.col("x")), x, key, F.col("x.held"), F.col("y.x"))
            h2 = decayed(u2, "x", [*key, "i", "j"], half_life)
            out.append(h2.select(*key, "t", tag, F.lit(2).alias("level"), "i", "j", none.alias("l"), "filtered"))
        if level >= 3:
            held = h2.select(*key, "t", "i", "j", (F.col("filtered") - F.col("x")).alias("held"))
            u3 = held.join(x.withColumnRenamed("k", "l"), [*key, "t"]).select(*key, "t", "i", "j", "l", (F.col("held") * F.col("x")).alias("x"))
            out.append(decayed(u3, "x", [*key, "i", "j", "l"], half_life).select(*key, "t", tag, F.lit(3).alias("level"), "i", "j", "l", "filtered"))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole
