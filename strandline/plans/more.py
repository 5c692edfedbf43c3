"""Instrumented decompositions, state kernels, placebos, audits and sensitivity tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import calendar, compare, filters, graph, kernels, moments, resample, scores
from ..session import settled
from ..sources.synthetic import synthetic_scores
from .base import HORIZON, LAG, OUTCOMES, WIDTH, blocks, panel, psi, query, r, sql, weights
from .dense import chosen_half_lives, nested, vectors
from .etl import _IV
from .paths import _D, _path_draws, _vectors


def _iv(spark, sf):
    return scores.iv_scores(panel(spark, sf), OUTCOMES, "shock", "instrument", "control", HORIZON, LAG)


_IVT = _IV | {
    "ivc": "SELECT k, avg((rf+fs)*(rf+fs)) AS c FROM iv GROUP BY k",
    "ive": "SELECT t, avg((rf+fs)*(rf+fs)/c) AS e, avg(rf*rf/c) AS e_rf, avg(fs*fs/c) AS e_fs, avg(2*rf*fs/c) AS e_x FROM iv JOIN ivc USING (k) GROUP BY t",
    "ivd": "SELECT t, z*z/(q*q) AS a2 FROM (SELECT DISTINCT t, z, q FROM rr)",
    "ivf": "SELECT s, sum(w*e) AS tau, sum(w*a2) AS e_bar FROM w JOIN ive USING (t) JOIN ivd USING (t) GROUP BY s",
    "ivg": "SELECT s, tau, e_bar / avg(e_bar) OVER () AS exposure, tau / e_bar * avg(e_bar) OVER () AS residual FROM ivf",
    "ivp": "SELECT *, (rank() OVER (ORDER BY exposure) + (count(*) OVER (PARTITION BY exposure) - 1)/2.0)/count(*) OVER () AS pe, (rank() OVER (ORDER BY residual) + (count(*) OVER (PARTITION BY residual) - 1)/2.0)/count(*) OVER () AS pr FROM ivg",
}


def _energy(iv):
    c = iv.groupBy("variant", "k").agg(F.avg(F.col("psi") * F.col("psi")).alias("c"))
    j = iv.join(c, ["variant", "k"])
    part = lambda x: F.avg(x / F.col("c"))
    return j.groupBy("variant", "t").agg(part(F.col("psi") * F.col("psi")).alias("e"), part(F.col("psi_rf") * F.col("psi_rf")).alias("e_rf"), part(F.col("psi_fs") * F.col("psi_fs")).alias("e_fs"), part(2 * F.col("psi_rf") * F.col("psi_fs")).alias("e_x"))


@query(sql(f"SELECT s, {r('tau', digits=4)}, {r('exposure', digits=4)}, {r('residual', digits=4)}, {r('pe', digits=4)}, {r('pr', digits=4)}, CASE WHEN pe >= 0.75 AND pr >= 0.75 THEN 'mixed' WHEN pe >= 0.75 THEN 'exposure' WHEN pr >= 0.75 THEN 'residual' ELSE 'unclassified' END AS driver FROM ivp", **_IVT), digits=4)
def iv_driver_decomposition(spark, sf):
    """tau as smoothed exposure (z / q)^2 times the residual energy behind it, scaled to a mean exposure of one, with
    percentile ranks and the label of what drives a month."""
    iv = _iv(spark, sf)
    z = scores.exposures(panel(spark, sf), OUTCOMES, "shock", "instrument", "control", HORIZON, LAG)
    w = weights(psi(spark, sf))
    f = w.join(_energy(iv), ["variant", "t"]).join(z, ["variant", "t"]).groupBy("variant", "s").agg(F.sum(F.col("w") * F.col("e")).alias("tau"), F.sum(F.col("w") * F.col("a2")).alias("e_bar"))
    m = F.avg("e_bar").over(Window.partitionBy("variant"))
    g = f.select("variant", "s", "tau", (F.col("e_bar") / m).alias("exposure"), (F.col("tau") / F.col("e_bar") * m).alias("residual"))
    g = filters.percentile_rank(filters.percentile_rank(g, "exposure", ["variant"], "pe"), "residual", ["variant"], "pr")
    a, b = F.col("pe") >= 0.75, F.col("pr") >= 0.75
    return g.withColumn("driver", F.when(a & b, "mixed").when(a, "exposure").when(b, "residual").otherwise("unclassified")).drop("variant")


@query(sql(f"SELECT s, {r('sum(w*e)', 'tau', 4)}, {r('sum(w*e_rf)', 'tau_rf', 4)}, {r('sum(w*e_fs)', 'tau_fs', 4)}, {r('sum(w*e_x)', 'tau_cross', 4)} FROM w JOIN ive USING (t) GROUP BY s", **_IVT), digits=4)
def iv_trace_decomposition(spark, sf):
    """tau in its reduced-form, first-stage and cross parts, which add up."""
    j = weights(psi(spark, sf)).join(_energy(_iv(spark, sf)), ["variant", "t"])
    s = lambda c: F.sum(F.col("w") * F.col(c))
    return j.groupBy("variant", "s").agg(s("e").alias("tau"), s("e_rf").alias("tau_rf"), s("e_fs").alias("tau_fs"), s("e_x").alias("tau_cross")).drop("variant")


@query(sql(f"SELECT s, t, {r('r / sum(r) OVER (PARTITION BY s)', 'w')} FROM (SELECT a.t AS s, b.t AS t, exp(-pow((a.x-b.x)/0.5, 2)/2) AS r FROM z a, z b)", z="SELECT t, (ticket - avg(ticket) OVER ()) / stddev_pop(ticket) OVER () AS x FROM panel WHERE t IN (SELECT t FROM places)"))
def kernel_state_gaussian(spark, sf):
    """Weights by nearness in a one-dimensional state instead of time."""
    p = panel(spark, sf).join(moments.months(psi(spark, sf)).select("variant", "t"), ["variant", "t"], "left_semi")
    w = Window.partitionBy("variant")
    x = p.select("variant", "t", ((F.col("ticket") - F.avg("ticket").over(w)) / F.stddev_pop("ticket").over(w)).alias("x"))
    return moments.state_kernel(x, "x", 0.5).drop("variant")


@query(sql(f"SELECT a.t, {r('a.shock', 'shock')}, {r('b.shock', 'placebo')} FROM (SELECT t, shock, row_number() OVER (ORDER BY md5('17|' || t)) AS n FROM panel) a JOIN (SELECT shock, t + 1 AS n FROM panel) b USING (n)"))
def placebo_permuted(spark, sf):
    """A fixed permutation of the shocks, by the order of a keyed digest."""
    return calendar.permuted(panel(spark, sf).select("variant", "t", "shock"), "shock", 17, ["variant"]).drop("variant")


@query(sql("SELECT k, j, h, j >= 3 AS in_shares, h >= 1 AS in_later, j >= 3 AND h >= 1 AS in_shares_later, true AS in_full FROM (SELECT k, k % 5 AS j, k // 5 AS h FROM (SELECT unnest(range(20)) AS k))"))
def selector_audit(spark, sf):
    """Which coordinates each restricted surface includes."""
    b = blocks(spark)
    k = b.select("k").distinct()
    shares, later = b.filter("block = 'shares'").select("k", F.lit(True).alias("a")), b.filter("block = 'later'").select("k", F.lit(True).alias("b"))
    j = k.join(shares, "k", "left").join(later, "k", "left")
    a, l = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    return j.select("k", (F.col("k") % WIDTH).alias("j"), F.floor(F.col("k") / WIDTH).alias("h"), a.alias("in_shares"), l.alias("in_later"), (a & l).alias("in_shares_later"), F.lit(True).alias("in_full"))


#: (variant, shock, control, transform): how each variant of the scores is made.
VARIANTS = [("headline", "shock", "control", "raw"), ("no_control", "shock", None, "raw"), ("swapped", "control", "shock", "raw"), ("standardised", "shock", "control", "trace"), ("shifted_placebo", "shock_shifted", "control", "raw"), ("permuted_placebo", "placebo", "control", "raw"), ("orthogonalised", "shock_orth", None, "raw")]


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in v) + ")" for v in VARIANTS) + ') v(variant, shock, control, "transform")')
def variant_registry(spark, sf):
    return spark.createDataFrame(VARIANTS, "variant string, shock string, control string, transform string")


def variant_scores(spark, sf):
    """Scores of all registered variants in one table: one panel, each variant's columns picked, one plan keyed by variant."""
    p = panel(spark, sf)
    p = calendar.circular_shift(p, "shock", 7, ["variant"])
    p = p.join(calendar.permuted(p, "shock", 17, ["variant"]).select("variant", "t", "placebo"), ["variant", "t"])
    p = scores.orthogonalised(p, "shock", "control")
    picked = F.array(*[F.struct(F.lit(n).alias("variant"), F.col(s).alias("s"), (F.col(c) if c else F.lit(0.0)).alias("c")) for n, s, c, _ in VARIANTS])
    every = p.select("t", "n", "date", *OUTCOMES, F.explode(picked).alias("v")).select("v.variant", "t", "n", "date", *OUTCOMES, "v.s", "v.c")
    made = scores.fwl_scores(every, OUTCOMES, "s", "c", HORIZON, LAG)
    weight = scores.block_traces(made, WIDTH).select("variant", "j", "weight")
    trace = [n for n, *_, t in VARIANTS if t == "trace"]
    return made.join(weight, ["variant", "j"]).withColumn("psi", F.when(F.col("variant").isin(trace), F.col("psi") * F.col("weight")).otherwise(F.col("psi"))).drop("weight")


@query()
def variant_top_months(spark, sf):
    """Five largest months of every variant: the variants are rows of one plan."""
    s = variant_scores(spark, sf)
    tau = moments.diag_tau(s, moments.kernel(moments.months(s), "gaussian", 3.0)).select("variant", F.col("s").alias("t"), F.col("tau").alias("x"))
    return compare.top(tau, "x", ["variant"], 5)


@query(sql(f"SELECT rk AS rank, s, {r('total')}, {r('within_part / total', 'within_share')}, s IN (SELECT s FROM tau ORDER BY tau DESC, s LIMIT 5) AS in_top5 FROM (SELECT *, row_number() OVER (ORDER BY total DESC, s) AS rk FROM mw) WHERE rk <= 10", mw="SELECT s, avg(raw/c_kk) AS total, avg(raw/c_kk) - avg(m*m/c_kk) AS within_part FROM (SELECT s, k, sum(w*psi) AS m, sum(w*psi*psi) AS raw FROM psi JOIN w USING (t) GROUP BY s, k) JOIN cd USING (k) GROUP BY s"))
def top_spikes(spark, sf):
    """Ten largest months with the share of the within part, and whether the month is among the path's five largest."""
    p = psi(spark, sf)
    w = weights(p)
    ten = compare.top(moments.mean_within(p, w).withColumnRenamed("s", "t"), "total", ["variant"], 10)
    five = compare.top(moments.diag_tau(p, w).select("variant", F.col("s").alias("t"), F.col("tau").alias("x")), "x", ["variant"], 5).select("variant", "t", F.lit(True).alias("five"))
    return ten.join(five, ["variant", "t"], "left").select("rank", F.col("t").alias("s"), "total", (F.col("within_part") / F.col("total")).alias("within_share"), F.coalesce("five", F.lit(False)).alias("in_top5"))


@query(sql(f"SELECT s, {r('tau - crit*sd', 'lo')}, {r('tau + crit*sd', 'hi')}, {r('crit')} FROM ce JOIN sd USING (s), cr", **_D, s0="SELECT s, stddev_samp(tau) AS sd0 FROM dr GROUP BY s", sd="SELECT s, greatest(sd0, (SELECT 0.1*quantile_cont(sd0, 0.5) FROM s0 WHERE sd0 > 0)) AS sd FROM s0", cr="SELECT quantile_cont(sup, 0.9) AS crit FROM (SELECT draw, max(abs(dr.tau - ce.tau) / sd) AS sup FROM dr JOIN ce USING (s) JOIN sd USING (s) GROUP BY draw)"))
def simultaneous_band_level(spark, sf):
    d, c = _path_draws(spark, sf)
    return resample.simultaneous_band(d, c, log=False).drop("variant")


@query()
def psd_diagnostics(spark, sf):
    return kernels.psd_diagnostics(vectors(spark, sf)).drop("variant")


@query()
def surface_shape(spark, sf):
    return kernels.surface_shape(vectors(spark, sf), 4, WIDTH).drop("variant")


@query()
def severe_table(spark, sf):
    """For each threshold: median and largest count of severe directions, share of states with any, and the conditional
    median and 90th percentile of their capture."""
    c = kernels.severe_capture(vectors(spark, sf), (1.2, 1.5))
    return c.groupBy("threshold").agg(F.percentile("n_severe", F.lit(0.5)).alias("median_n"), F.max("n_severe").alias("max_n"), F.avg((F.col("n_severe") > 0).cast("double")).alias("share_any"), F.percentile("capture", F.lit(0.5)).alias("median_capture"), F.percentile("capture", F.lit(0.9)).alias("p90_capture"))


@query()
def eta_sensitivity(spark, sf):
    return kernels.eta_sensitivity(vectors(spark, sf), 0.08, (0.005, 0.02, 0.08, 0.3, 1.0)).drop("variant")


@query()
def structural_rank(spark, sf):
    return kernels.structural_rank(vectors(spark, sf)).drop("variant")


@query()
def nested_sensitivity(spark, sf):
    """Mean gain of the moving models under each covariance estimator and floor, and whether its sign is the primary's."""
    v = settled(vectors(spark, sf))
    tuned = chosen_half_lives(v)
    settings = {"primary": ("ledoit_wolf", 1e-8), "diagonal": ("diagonal", 1e-8), "add_floor": ("add_floor", 1e-4), "floor_1e-10": ("ledoit_wolf", 1e-10), "floor_1e-6": ("ledoit_wolf", 1e-6)}
    frames = {k: compare.pair_differences(nested(v, e, f, tuned), [("M1", "M0"), ("M3", "M0")]) for k, (e, f) in settings.items()}
    s = compare.union_named(frames, "setting").groupBy("setting", "pair").agg(F.avg("diff").alias("mean"), F.percentile("diff", F.lit(0.5)).alias("median"), F.avg((F.col("diff") > 0).cast("double")).alias("share_won"))
    first = s.filter("setting = 'primary'").select("pair", F.signum("mean").alias("sign0"))
    return s.join(first, "pair").withColumn("sign_differs", F.signum("mean") != F.col("sign0")).drop("sign0")


@query()
def graph_search(spark, sf):
    """Neighbours x density exponent x penalty by blocked cross-validation, as rows, and the best of each block."""
    v = _vectors(spark, sf)
    targets = v.select("block", F.col("id").alias("i"), F.element_at("v", 1).alias("y"))
    most = graph.knn_edges(v, 10)  # a shorter list is the beginning of a longer one
    near = {k: graph.affinities(most.filter(F.col("rank") <= k), k) for k in (6, 10)}
    # All settings are solved together, each as blocks of its own.
    named = lambda setting, df: df.withColumn("block", F.concat(F.lit(f"{setting}:"), F.col("block").cast("string")))
    settings = {f"k={k},alpha={a:g}": graph.density_normalised(near[k], a).select("block", "i", "j", "a") for k in (6, 10) for a in (0.0, 0.5)}
    aff = reduce(DataFrame.unionByName, [named(s, df) for s, df in settings.items()])
    wanted = reduce(DataFrame.unionByName, [named(s, targets) for s in settings])
    grid = graph.ridge_grid(graph.laplacian_eigen(aff, 4), wanted, [0.1, 1.0], 4)
    key = F.split("block", ":", 2)
    every = grid.select(key[1].cast(v.schema["block"].dataType).alias("block"), "lam", "cv_error", "edf", key[0].alias("setting"))
    return every.withColumn("best", F.row_number().over(Window.partitionBy("block").orderBy("cv_error", "setting", "lam")) == 1)


@query()
def synthetic_smoke(spark, sf):
    """The flagship path on made-up scores, whose burst must lead."""
    s = synthetic_scores(spark, 60, 3, 2, 9, variants=3)
    return compare.top(kernels.tau_resolvent(kernels.score_vectors(s)).select("variant", "t", F.col("tau").alias("x")), "x", ["variant"], 3)
