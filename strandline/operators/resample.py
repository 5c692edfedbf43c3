"""Block resampling with draws as rows, and bands over draws."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def arithmetic_blocks(spark: SparkSession, n: int, length: int, draws: int) -> DataFrame:
    """(draw, pos, t) of circular blocks whose starts follow a fixed arithmetic rule, made in the executors:
    start = (draw * 7919 + block * 104729) mod n."""
    d = spark.range(draws).withColumnRenamed("id", "draw")
    p = d.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    start = (F.col("draw") * 7919 + F.floor(F.col("pos") / length) * 104729) % n
    return p.select("draw", "pos", ((start + F.col("pos") % length) % n).cast("long").alias("t"))


def seeded_blocks(spark: SparkSession, n: int, length: int, draws: int, seed: int) -> DataFrame:
    """(draw, pos, t) of circular blocks with random starts; a draw's starts depend on (seed, draw) alone, so draws are
    made where they are used and in any number."""

    def make(batches):
        for pdf in batches:
            for draw in pdf["id"]:
                starts = np.random.default_rng([seed, int(draw)]).integers(0, n, -(-n // length))
                t = ((starts[:, None] + np.arange(length)) % n).ravel()[:n]
                yield type(pdf)({"draw": np.full(n, draw, np.int64), "pos": np.arange(n), "t": t})

    return spark.range(draws).mapInPandas(make, "draw long, pos long, t long")


def draw_means(values: DataFrame, draws: DataFrame, key: list[str], value: str) -> DataFrame:
    """Mean of value over each draw's places."""
    return values.join(draws, "t").groupBy(*key, "draw").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def mean_interval(values: DataFrame, draws: DataFrame, key: list[str], value: str, level: float = 0.90) -> DataFrame:
    """The mean with its block-bootstrap percentile interval."""
    m = draw_means(values, draws, key, value)
    band = m.groupBy(*key).agg(F.percentile("mean", F.lit((1 - level) / 2)).alias("lo"), F.percentile("mean", F.lit((1 + level) / 2)).alias("hi"), F.avg((F.col("mean") > 0).cast("double")).alias("prob_positive"))
    return values.groupBy(*key).agg(F.avg(value).alias("mean")).join(band, key)


def path_draws(q: DataFrame, w: DataFrame, draws: DataFrame) -> DataFrame:
    """tau_b(s) = sum over pos of w(s, pos) q[t(b, pos)], with w keyed by the original places: dates stay fixed and
    scores are resampled. q(variant, t, q)."""
    picked = q.join(draws, "t").select("variant", "draw", F.col("pos").alias("t"), "q")
    return picked.join(w, ["variant", "t"]).groupBy("variant", "draw", "s").agg(F.sum(F.col("w") * F.col("q")).alias("tau"))


def pointwise_band(draws: DataFrame, level: float = 0.90) -> DataFrame:
    return draws.groupBy("variant", "s").agg(F.percentile("tau", F.lit((1 - level) / 2)).alias("lo"), F.percentile("tau", F.lit(0.5)).alias("mid"), F.percentile("tau", F.lit((1 + level) / 2)).alias("hi"), F.stddev_samp("tau").alias("sd"))


def simultaneous_band(draws: DataFrame, centre: DataFrame, level: float = 0.90, log: bool = True) -> DataFrame:
    """centre -+ crit * sd at every state, crit the level quantile over draws of the largest standardised deviation. sd is
    floored at a tenth of its median positive value; with `log` the band is made for ln tau and taken back."""
    x = F.log("tau") if log else F.col("tau")
    d = draws.select("variant", "draw", "s", x.alias("x"))
    c = centre.select("variant", "s", x.alias("c"))
    sd = d.groupBy("variant", "s").agg(F.stddev_samp("x").alias("sd0"))
    floor = sd.filter("sd0 > 0").groupBy("variant").agg((0.1 * F.percentile("sd0", F.lit(0.5))).alias("floor"))
    sd = sd.join(floor, "variant").select("variant", "s", F.greatest("sd0", "floor").alias("sd"))
    dev = d.join(c, ["variant", "s"]).join(sd, ["variant", "s"]).groupBy("variant", "draw").agg(F.max(F.abs(F.col("x") - F.col("c")) / F.col("sd")).alias("sup"))
    crit = dev.groupBy("variant").agg(F.percentile("sup", F.lit(level)).alias("crit"))
    j = c.join(sd, ["variant", "s"]).join(crit, "variant")
    lo, hi = F.col("c") - F.col("crit") * F.col("sd"), F.col("c") + F.col("crit") * F.col("sd")
    return j.select("variant", "s", (F.exp(lo) if log else lo).alias("lo"), (F.exp(hi) if log else hi).alias("hi"), "crit")


def episode_probability(draws: DataFrame, windows: DataFrame) -> DataFrame:
    """For each window (episode, lo, hi) of states: the share of draws whose peak over all states lies in it, and the
    mean rank, over draws, of the window's best state."""
    r = draws.withColumn("r", F.row_number().over(Window.partitionBy("variant", "draw").orderBy(F.col("tau").desc(), "s")))
    j = r.join(F.broadcast(windows), F.col("s").between(F.col("lo"), F.col("hi")))
    best = j.groupBy("variant", "draw", "episode").agg(F.min("r").alias("best"), F.max("tau").alias("peak"))
    return best.groupBy("variant", "episode").agg(F.avg((F.col("best") == 1).cast("double")).alias("prob_peak"), F.avg("best").alias("mean_rank"), F.percentile("peak", F.lit(0.5)).alias("median_peak"))


def membership(draws: DataFrame, k: int = 10) -> DataFrame:
    """Probability that a state is among the k largest of its draw."""
    r = draws.withColumn("r", F.row_number().over(Window.partitionBy("variant", "draw").orderBy(F.col("tau").desc(), "s")))
    return r.groupBy("variant", "s").agg(F.avg((F.col("r") <= k).cast("double")).alias("prob"), F.percentile("r", F.lit(0.05)).alias("rank_p05"), F.percentile("r", F.lit(0.95)).alias("rank_p95"))
