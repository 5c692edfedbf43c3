"""Covariances of region-by-year cells, smoothed over years, as long rows (i, j).

A cell is its count and its cross products; everything after them is bounded by the regions, the years and the square of
the coordinates, whatever the number of observations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored


def pooled(cells: DataFrame) -> DataFrame:
    """(i, j, c): the covariance of all cells(region, year, n, i, j, cross) together."""
    return cells.groupBy("i", "j").agg((F.sum("cross") / F.sum("n")).alias("c"))


def smoothed_covariances(cells: DataFrame, width: float, ridge: float, least: float, most_ridge: float = 0.70, slope: float = 0.35) -> DataFrame:
    """(region, year, i, j, cov, weight_sum, effective, rho, status) for every region and every year from the first to the
    last: the cells' cross products weighted over years by a Gaussian of `width`, blended with the pooled covariance.

    cells(region, year, n, i, j, cross) hold all pairs of coordinates for each cell that has observations; a null region
    is named Unknown. The share of the pooled covariance is `ridge` and rises by `slope` times the shortfall of the
    effective observations below `least`, up to most_ridge (status sparse_blended, else smoothed); a region without
    weight gets the pooled covariance alone (identity_fallback). An empty table gives no rows.
    """
    cells = cells.withColumn("region", F.coalesce("region", F.lit("Unknown")))
    ends = cells.agg(F.min("year").alias("a"), F.max("year").alias("b")).first()
    years = F.explode(F.sequence(F.lit(ends.a), F.lit(ends.b))) if ends.a is not None else F.explode(F.array().cast("array<int>"))
    w = F.exp(-0.5 * F.pow((F.col("from") - F.col("year")) / F.lit(max(width, 1e-12)), F.lit(2)))
    spread = cells.withColumnRenamed("year", "from").withColumn("year", years).withColumn("w", w)
    cover = spread.groupBy("region", "year", "i", "j").agg(F.sum(F.col("w") * F.col("n")).alias("weight_sum"), F.sum(F.col("w") * F.col("w") * F.col("n")).alias("squares"), F.sum(F.col("w") * F.col("cross")).alias("cross"))
    effective = F.when(F.col("weight_sum") > 0, F.col("weight_sum") * F.col("weight_sum") / F.greatest("squares", F.lit(1e-12))).otherwise(0.0)
    out = cover.withColumn("effective", effective).join(pooled(cells), ["i", "j"])
    short = F.greatest(F.lit(0.0), F.lit(least) - F.col("effective")) / max(least, 1e-12)
    rho = F.when(F.col("weight_sum") > 0, F.least(F.lit(most_ridge), ridge + slope * short)).otherwise(1.0)
    status = F.when(F.col("weight_sum") <= 0, "identity_fallback").when(F.col("effective") < least, "sparse_blended").otherwise("smoothed")
    own = F.when(F.col("weight_sum") > 0, F.col("cross") / F.col("weight_sum")).otherwise(0.0)
    out = out.withColumn("rho", rho)
    return out.select("region", "year", "i", "j", ((1 - F.col("rho")) * own + F.col("rho") * F.col("c")).alias("cov"), "weight_sum", "effective", "rho", status.alias("status"))


def _root(m: np.ndarray, power: float) -> np.ndarray:
    values, v = np.linalg.eigh((m + m.T) / 2)
    keep = values > 1e-12 * max(values[-1], 0)
    return (v[:, keep] * values[keep] ** power) @ v[:, keep].T


def balanced(covs: DataFrame, pool: DataFrame) -> DataFrame:
    """covs with `cov` turned so that its mean over all cells is the pooled covariance: T K T' with
    T = C^(1/2) B^(-1/2) C^(-1/2), B being the mean of C^(-1/2) K C^(-1/2). The two p x p matrices that T needs meet in one
    task; its product with the cells' is by joins on the coordinates."""
    covs = stored(covs, "cells")
    mean = covs.groupBy("i", "j").agg(F.avg("cov").alias("m")).join(pool, ["i", "j"])

    def turn(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(pdf["i"])
        wide = lambda c: pdf.pivot(index="i", columns="j", values=c).loc[names, names].to_numpy()
        c = wide("c")
        half, less = _root(c, 0.5), _root(c, -0.5)
        t = half @ _root(less @ wide("m") @ less, -0.5) @ less
        return pd.DataFrame({"i": np.repeat(names, len(names)), "j": np.tile(names, len(names)), "t": t.ravel()})

    kind = covs.schema["i"].dataType.simpleString()
    one = mean.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda key, pdf: turn(pdf), f"i {kind}, j {kind}, t double")
    t = stored(one, "turn")
    left = covs.select("region", "year", F.col("i").alias("a"), "j", "cov").join(t.select("i", F.col("j").alias("a"), "t"), "a").groupBy("region", "year", "i", "j").agg(F.sum(F.col("t") * F.col("cov")).alias("cov"))
    both = left.withColumnRenamed("j", "b").join(t.select(F.col("i").alias("j"), F.col("j").alias("b"), "t"), "b").groupBy("region", "year", "i", "j").agg(F.sum(F.col("t") * F.col("cov")).alias("cov"))
    return covs.drop("cov").join(both, ["region", "year", "i", "j"])
