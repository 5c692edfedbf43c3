"""Time kernels, weighted second moments and the probes that need only their diagonals.

A path value at state s is a weighted sum over months, so traces, cells and blocks come from joins of w(s, t) with
per-month scalars. The full matrix path exists only where a caller asks for its entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def months(scores: DataFrame) -> DataFrame:
    return scores.select("variant", "t", "date").distinct()


def kernel(places: DataFrame, kind: str, width: float) -> DataFrame:
    """Row-normalised weights w(variant, s, t). gaussian: exp(-d^2 / (2 width^2)); bartlett: 1 - d / (width + 1) up to
    width; boxcar: 1 up to width; identity. A state without mass puts its weight on itself.

    Compactly supported kernels join on the places in reach; the Gaussian's support is all pairs of a variant.
    """
    a = places.select("variant", F.col("t").alias("s"))
    b = places.select("variant", "t")
    if kind == "identity":
        return places.select("variant", F.col("t").alias("s"), "t", F.lit(1.0).alias("w"))
    if kind in ("bartlett", "boxcar"):
        near = a.withColumn("t", F.explode(F.sequence(F.col("s") - int(width), F.col("s") + int(width)))).join(b, ["variant", "t"])
        d = F.abs(F.col("s") - F.col("t"))
        raw = near.withColumn("r", 1 - d / (width + 1) if kind == "bartlett" else F.lit(1.0))
    elif kind == "gaussian":
        d = F.col("s") - F.col("t")
        raw = a.join(b, "variant").withColumn("r", F.exp(-d * d / (2.0 * width * width)))
    else:
        raise ValueError(f"unknown kernel {kind}")
    total = F.sum("r").over(Window.partitionBy("variant", "s"))
    return raw.select("variant", "s", "t", F.when(total > 0, F.col("r") / total).otherwise((F.col("s") == F.col("t")).cast("double")).alias("w"))


def state_kernel(states: DataFrame, value: str, width: float) -> DataFrame:
    """Row-normalised Gaussian weights in the distance of a one-dimensional state(variant, t, value)."""
    a = states.select("variant", F.col("t").alias("s"), F.col(value).alias("_a"))
    d = (F.col("_a") - F.col(value)) / width
    raw = a.join(states.select("variant", "t", value), "variant").withColumn("r", F.exp(-d * d / 2))
    return raw.select("variant", "s", "t", (F.col("r") / F.sum("r").over(Window.partitionBy("variant", "s"))).alias("w"))


def weight_diagnostics(w: DataFrame) -> DataFrame:
    """For each variant: smallest and largest weight, largest error of row and column sums, mean effective size."""
    rows = w.groupBy("variant", "s").agg(F.sum("w").alias("r"), (1 / F.sum(F.col("w") * F.col("w"))).alias("ess"), F.min("w").alias("lo"), F.max("w").alias("hi"))
    cols = w.groupBy("variant", "t").agg(F.sum("w").alias("c")).groupBy("variant").agg(F.max(F.abs(F.col("c") - 1)).alias("col_error"))
    agg = rows.groupBy("variant").agg(F.min("lo").alias("min_w"), F.max("hi").alias("max_w"), F.max(F.abs(F.col("r") - 1)).alias("row_error"), F.avg("ess").alias("mean_ess"))
    return agg.join(cols, "variant")


def ess(w: DataFrame) -> DataFrame:
    """Effective sample size of each state's weights, plain and as a share of the months."""
    return w.groupBy("variant", "s").agg((1 / F.sum(F.col("w") * F.col("w"))).alias("ess"), F.count("*").alias("support"))


def second_moment(scores: DataFrame) -> DataFrame:
    """C in coordinate form: mean over months of psi_i psi_j."""
    a = scores.select("variant", "t", F.col("k").alias("i"), F.col("psi").alias("a"))
    b = scores.select("variant", "t", F.col("k").alias("j"), F.col("psi").alias("b"))
    return a.join(b, ["variant", "t"]).groupBy("variant", "i", "j").agg(F.avg(F.col("a") * F.col("b")).alias("c"))


def moment_path(scores: DataFrame, w: DataFrame) -> DataFrame:
    """K(s) in coordinate form: sum over t of w(s, t) psi_i psi_j."""
    a = scores.select("variant", "t", F.col("k").alias("i"), F.col("psi").alias("a"))
    b = scores.select("variant", "t", F.col("k").alias("j"), F.col("psi").alias("b"))
    products = a.join(b, ["variant", "t"]).withColumn("p", F.col("a") * F.col("b")).select("variant", "t", "i", "j", "p")
    return products.join(w, ["variant", "t"]).groupBy("variant", "s", "i", "j").agg(F.sum(F.col("w") * F.col("p")).alias("k_ij"))


def weighted_covariance(scores: DataFrame, w: DataFrame) -> DataFrame:
    """(variant, s, i, j, cov), i <= j: covariances of the scores about their weighted means at every state. A floor on
    the eigenvalues, where a caller needs one, is the dense kit's `regularised`."""
    a = scores.select("variant", "t", F.col("k").alias("i"), F.col("psi").alias("a"))
    b = scores.select("variant", "t", F.col("k").alias("j"), F.col("psi").alias("b"))
    pairs = a.join(b, ["variant", "t"]).filter("i <= j").join(w, ["variant", "t"])
    part = lambda x: F.sum(F.col("w") * x)
    return pairs.groupBy("variant", "s", "i", "j").agg((part(F.col("a") * F.col("b")) - part(F.col("a")) * part(F.col("b")) * (2 - F.sum("w"))).alias("cov"))


def diagonals(scores: DataFrame, w: DataFrame) -> DataFrame:
    """(variant, s, h, j, k, k_kk, c_kk): the diagonals of K(s) and C."""
    c = scores.groupBy("variant", "k").agg(F.avg(F.col("psi") * F.col("psi")).alias("c_kk"))
    d = scores.join(w, ["variant", "t"]).groupBy("variant", "s", "h", "j", "k").agg(F.sum(F.col("w") * F.col("psi") * F.col("psi")).alias("k_kk"))
    return d.join(c, ["variant", "k"])


def diag_tau(scores: DataFrame, w: DataFrame) -> DataFrame:
    """The amplification path with a diagonal reference: sum over t of w(s, t) q_t, q_t = mean over k of psi^2 / C_kk."""
    c = scores.groupBy("variant", "k").agg(F.avg(F.col("psi") * F.col("psi")).alias("c_kk"))
    q = scores.join(c, ["variant", "k"]).groupBy("variant", "t").agg(F.avg(F.col("psi") * F.col("psi") / F.col("c_kk")).alias("q"))
    return w.join(q, ["variant", "t"]).groupBy("variant", "s").agg(F.sum(F.col("w") * F.col("q")).alias("tau"))


def cell_probes(diag: DataFrame, tau: DataFrame, tol: float = 1e-12) -> DataFrame:
    """Amplitude K_kk / C_kk and log shape ln(amplitude / tau) of every cell; null where C_kk is too small to divide by."""
    floor = F.greatest(F.lit(tol), tol * F.greatest(F.avg("c_kk").over(Window.partitionBy("variant", "s")), F.lit(1.0)))
    amp = F.when(F.col("c_kk") > floor, F.col("k_kk") / F.col("c_kk"))
    return diag.join(tau, ["variant", "s"]).select("variant", "s", "h", "j", "k", amp.alias("amp"), F.log(amp / F.col("tau")).alias("shape"))


def block_probes(diag: DataFrame, tau: DataFrame, blocks: DataFrame) -> DataFrame:
    """Amplitude of a block of coordinates, sum K_kk / sum C_kk, and its ratio to tau."""
    b = diag.join(F.broadcast(blocks), "k").groupBy("variant", "s", "block").agg((F.sum("k_kk") / F.sum("c_kk")).alias("amp"))
    return b.join(tau, ["variant", "s"]).select("variant", "s", "block", "amp", (F.col("amp") / F.greatest("tau", F.lit(1e-12))).alias("shape"))


def shape_metrics(cells: DataFrame) -> DataFrame:
    """Root mean square of the log shape, and the effective support of the amplitudes: exp(entropy) / cells."""
    w = Window.partitionBy("variant", "s")
    p = F.col("amp") / F.sum("amp").over(w)
    return cells.filter("amp > 0").withColumn("p", p).groupBy("variant", "s").agg(F.sqrt(F.avg(F.col("shape") * F.col("shape"))).alias("shape_rms"), (F.exp(-F.sum(F.col("p") * F.log("p"))) / F.count("*")).alias("support"))


def shares(diag: DataFrame, blocks: DataFrame) -> DataFrame:
    """Share of each block in the trace of K(s)."""
    total = F.sum("k_kk").over(Window.partitionBy("variant", "s"))
    return diag.withColumn("f", F.col("k_kk") / total).join(F.broadcast(blocks), "k").groupBy("variant", "s", "block").agg(F.sum("f").alias("share"))


def mean_within(scores: DataFrame, w: DataFrame) -> DataFrame:
    """tau split into the part of the weighted mean score and the rest, with a diagonal reference."""
    c = scores.groupBy("variant", "k").agg(F.avg(F.col("psi") * F.col("psi")).alias("c_kk"))
    m = scores.join(w, ["variant", "t"]).groupBy("variant", "s", "k").agg(F.sum(F.col("w") * F.col("psi")).alias("mean"), F.sum(F.col("w") * F.col("psi") * F.col("psi")).alias("raw"))
    d = m.join(c, ["variant", "k"]).groupBy("variant", "s").agg(F.avg(F.col("raw") / F.col("c_kk")).alias("total"), F.avg(F.col("mean") * F.col("mean") / F.col("c_kk")).alias("mean_part"))
    return d.withColumn("within_part", F.col("total") - F.col("mean_part"))


def path_edges(places: DataFrame) -> DataFrame:
    """Edges between neighbouring months with conductance 1 / gap^2, the gap counted in months."""
    w = Window.partitionBy("variant").orderBy("date")
    gap = F.months_between("date", F.lag("date").over(w))
    return places.select("variant", F.lag("t").over(w).alias("a"), F.col("t").alias("b"), (1 / (gap * gap)).alias("conductance")).filter("a IS NOT NULL")


def median_bandwidth(features: DataFrame, names: list[str]) -> DataFrame:
    """Half-squared-distance scale of a feature blend: the median positive distance over all pairs of a variant."""
    return distances(features, names).filter("d > 0").groupBy("variant").agg(F.percentile("d", F.lit(0.5)).alias("h"))


def distances(features: DataFrame, names: list[str]) -> DataFrame:
    a = features.select("variant", F.col("t").alias("s"), *[F.col(n).alias(f"a_{n}") for n in names])
    b = features.select("variant", "t", *names)
    d2 = sum((F.col(f"a_{n}") - F.col(n)) * (F.col(f"a_{n}") - F.col(n)) for n in names)
    return a.join(b, "variant").select("variant", "s", "t", F.sqrt(d2).alias("d"))


def blended(w: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """w times exp(-d^2 / (2 h^2)) in feature distance, renormalised by row."""
    r = w.join(distances(features, names), ["variant", "s", "t"]).join(F.broadcast(median_bandwidth(features, names)), "variant").withColumn("r", F.col("w") * F.exp(-F.col("d") * F.col("d") / (2 * F.col("h") * F.col("h"))))
    total = F.sum("r").over(Window.partitionBy("variant", "s"))
    return r.select("variant", "s", "t", F.when(total > 0, F.col("r") / total).otherwise((F.col("s") == F.col("t")).cast("double")).alias("w"))
